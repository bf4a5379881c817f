"""Words within the picture of a line, the words that were read shared out to them, and pictures packed on sheets."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import numpy as np

from .geometry import js_round

#: Least difference of brightness that holds ink, the share of a column's pixels that is noise, and the least gap in pixels.
CONTRAST, NOISE, LEAST_GAP = 32, 0.02, 2

Span = tuple[int, int, int, int]


def brightness(rgba: np.ndarray) -> np.ndarray:
    """Rec. 601 over white, not rounded."""
    alpha = rgba[..., 3].astype(float) / 255
    return alpha * (rgba[..., :3] @ np.array([0.299, 0.587, 0.114])) + (1 - alpha) * 255


def word_spans(rgba: np.ndarray, gap_ratio: float) -> list[Span]:
    """(x0, x1, y0, y1) of the words of a line: runs of inked columns, parted by gaps of a share of the height.

    Ink is darker than the middle between the lightest and the darkest pixel. A picture without contrast or gaps is one span.
    """
    height, width = rgba.shape[:2]
    whole = [(0, width, 0, height)]
    if width < 2 or not height:
        return whole
    light = brightness(rgba).astype(np.float32)
    if light.max() - light.min() < CONTRAST:
        return whole
    ink = light < (float(light.max()) + float(light.min())) / 2
    marked = np.flatnonzero(ink.sum(axis=0) > max(1, js_round(height * NOISE)))
    if not len(marked):
        return whole
    gap = max(LEAST_GAP, js_round(height * gap_ratio))
    out = []
    for run in np.split(marked, np.flatnonzero(np.diff(marked) > gap) + 1):
        x0, x1 = int(run[0]), int(run[-1]) + 1
        rows = np.flatnonzero(ink[:, x0:x1].any(axis=1))
        out.append((x0, x1, int(rows[0]), int(rows[-1]) + 1))
    return out


def align_spans(words: Sequence[str], spans: Sequence[Span]) -> list[tuple[Span, str]]:
    """Words paired with spans in order.

    Too many spans: those with the smallest gaps are joined, the first of equal ones. Too many words: each span gets
    words until its share of the characters, which is its share of the ink, is reached, and one at least.
    """
    if not spans or not words:
        return []
    gaps = np.array([b[0] - a[1] for a, b in zip(spans, spans[1:])])  # noqa: B905
    joined = set(np.argsort(gaps, kind="stable")[: max(0, len(spans) - len(words))].tolist())
    places: list[Span] = []
    for i, s in enumerate(spans):
        if i - 1 in joined:
            p = places.pop()
            s = (p[0], s[1], min(p[2], s[2]), max(p[3], s[3]))
        places.append(s)
    widths = [max(1, s[1] - s[0]) for s in places]
    letters = sum(map(len, words)) or 1
    out, at = [], 0
    for k, (place, width) in enumerate(zip(places, widths, strict=True)):
        later, share, end = len(places) - k - 1, width / sum(widths) * letters, at + 1
        while end < len(words) - later and (not later or sum(map(len, words[at:end])) < share):
            end += 1
        out.append((place, " ".join(words[at:end])))
        at = end
    return [(p, t) for p, t in out if t]


def pack_sheets(sizes: Sequence[tuple[int, int]], side: int, most_scale: float, gutter: int) -> list[list[dict]]:
    """Pictures (width, height) on square sheets: {item, scale, width, height, x, y}, tallest first, shelf below shelf.

    Each is scaled so that its longer side is the sheet's, but by no more than ``most_scale``.
    """
    pieces = []
    for item, (w, h) in enumerate(sizes):
        scale = min(side / w, side / h, most_scale)
        pieces.append({"item": item, "scale": scale, "width": max(1, int(w * scale)), "height": max(1, int(h * scale))})
    pieces.sort(key=lambda p: (-p["height"], -p["width"]))

    def rows(things: Sequence, size) -> list[list]:
        """Cut a sequence where the next thing would go beyond the side."""
        out: list[list] = []
        used = 0
        for t in things:
            if not out or used + size(t) > side:
                out.append([])
                used = 0
            out[-1].append(t)
            used += size(t) + gutter
        return out

    starts = lambda lengths: accumulate(lengths, lambda at, n: at + n + gutter, initial=0)
    shelves = rows(pieces, lambda p: p["width"])
    sheets = rows(shelves, lambda shelf: shelf[0]["height"])
    return [
        [{**p, "x": x, "y": y} for shelf, y in zip(sheet, starts([s[0]["height"] for s in sheet])) for p, x in zip(shelf, starts([p["width"] for p in shelf]))]  # noqa: B905
        for sheet in sheets
    ]
