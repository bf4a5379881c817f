"""Records as HTML text for a notebook; one record at a time, on the driver."""

from __future__ import annotations

import json
from html import escape

from .operators.images import hue_of


def _failed(record: dict) -> str | None:
    return f'<pre class="error">{escape(record["exception"])}</pre>' if record.get("exception") else None


def show_text(document: dict) -> str:
    return _failed(document) or f"<pre>{escape(document['text'])}</pre>"


def show_json(value, indent: int = 2) -> str:
    return f"<pre>{escape(json.dumps(value, indent=indent, ensure_ascii=False, default=str))}</pre>"


def _table(head: list[str], rows: list[list]) -> str:
    cell = lambda tag, v: f"<{tag}>{escape(f'{v:.3f}' if isinstance(v, float) else str(v))}</{tag}>"
    line = lambda tag, row: f"<tr>{''.join(cell(tag, v) for v in row)}</tr>"
    return f"<table>{line('th', head)}{''.join(line('td', r) for r in rows)}</table>"


def show_ner(ner: dict, limit: int = 20) -> str:
    """A table of entities; a limit of 0 shows all."""
    fields = ["entity_group", "score", "word", "start", "end"]
    found = ner["entities"][: limit or None] if not ner.get("exception") else []
    return _failed(ner) or _table(fields, [[e[f] for f in fields] for e in found])


def show_boxes(output: dict, limit: int = 20) -> str:
    fields = ["text", "score", "x", "y", "width", "height", "angle"]
    return _failed(output) or _table(fields, [[b[f] for f in fields] for b in output["bboxes"][: limit or None]])


def visualize_ner(document: dict, ner: dict, labels: list[str] | None = None, show_labels: bool = False) -> str:
    """The text with its entities marked; of overlapping ones the first, then the surer."""
    failed = _failed(document) or _failed(ner)
    if failed:
        return failed
    text, out, at = document["text"], [], 0
    shown = [e for e in ner["entities"] if (not labels or e["entity_group"] in labels) and 0 <= e["start"] < e["end"] <= len(text)]
    for e in sorted(shown, key=lambda e: (e["start"], -e["score"])):
        if e["start"] < at:
            continue
        title = escape(f"{e['entity_group']} ({e['score']:.3f})")
        mark = f'<span title="{title}" style="background:hsl({hue_of(e["entity_group"])},70%,45%);color:#fff">{escape(text[e["start"] : e["end"]])}</span>'
        out += [escape(text[at : e["start"]]), mark, f"<sup>{escape(e['entity_group'])}</sup>" if show_labels else ""]
        at = e["end"]
    return f'<div style="white-space:pre-wrap">{"".join(out)}{escape(text[at:])}</div>'
