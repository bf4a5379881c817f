"""Entities and their boxes: character maps, de-duplication, consistency over documents, merging of readings."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import identity
from ..functions.text import fold, fold_with_offsets, whole_word_places
from ..plans.stage import unused
from ..schemas import DOCUMENT, ENTITIES, arrow_type, ner
from ..sources.shared import saved
from .words import pieces

FOUND = arrow_type(ENTITIES)

# ---- positions -------------------------------------------------------------------------------------------------


def box_places(text: str, words: Sequence[str]) -> list[int]:
    """Where the characters of each box begin, or -1.

    Each box takes the first unclaimed place of its text at or after the last one, else the first unclaimed place.
    """
    taken = bytearray(len(text))

    def place(word: str, at: int) -> int:
        while (at := text.find(word, at)) >= 0:
            if taken.find(1, at, at + len(word)) < 0:
                return at
            at += 1
        return -1

    cursor, out = 0, []
    for word in words:
        at = -1
        if word:
            at = place(word, cursor)
            if at < 0:
                at = place(word, 0)
        if at >= 0:
            cursor = at + len(word)
            taken[at:cursor] = b"\1" * len(word)
        out.append(at)
    return out


def char_to_box(text: str, words: Sequence[str]) -> list[int]:
    """For each character the number of the box it belongs to, or -1."""
    owner = [-1] * len(text)
    for i, (at, word) in enumerate(zip(box_places(text, words), words, strict=True)):
        if at >= 0:
            owner[at : at + len(word)] = [i] * len(word)
    return owner


def boxes_in_range(owner: Sequence[int], start: int, end: int) -> list[int]:
    """Numbers of the boxes that a range of characters touches, in order, each once."""
    return list(dict.fromkeys(o for o in owner[max(0, start) : max(0, end)] if o >= 0))


# ---- de-duplication and readings --------------------------------------------------------------------------------


def dedupe(df: DataFrame, scope: list[str], key: list[str], score: str, pos: str) -> DataFrame:
    """The best-scored row of each key; of equals the first. Rows keep their columns."""
    w = Window.partitionBy(*scope, *key).orderBy(F.col(score).desc(), F.col(pos))
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def best_by_span(entities: Column) -> Column:
    """An array's best entity for each start, end and group, in the order of the first of each."""
    typed = entities.cast(ENTITIES)
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["entity_group"] == b["entity_group"])
    step = lambda kept, e: F.when(F.exists(kept, lambda k: same(k, e)), F.transform(kept, lambda k: F.when(same(k, e) & (e["score"] > k["score"]), e).otherwise(k))).otherwise(F.concat(kept, F.array(e)))
    return F.aggregate(typed, F.array().cast(ENTITIES), step)


def union_readings(records: list[Column]) -> Column:
    """Entities of several NER records, in their order; a missing record has none."""
    return F.flatten(F.array(*[F.coalesce(r["entities"], F.array()).cast(ENTITIES) for r in records]))


def merge_records(records: list[Column], dedupe_spans: bool = True) -> Column:
    """One NER record of several: an error only if every reading that there is failed."""
    failed = F.array_compact(F.array(*[F.when(r.isNotNull() & (r["exception"] != ""), r["exception"]) for r in records]))
    there = sum((F.when(r.isNotNull(), 1).otherwise(0) for r in records), F.lit(0))
    good = union_readings([F.when(F.coalesce(r["exception"], F.lit("")) == "", r) for r in records])
    found = best_by_span(good) if dedupe_spans else good
    ordered = F.array_sort(found, lambda a, b: _compare(a, b, ("start", "end", "entity_group")))
    all_failed = (there > 0) & (F.size(failed) == there)
    path = F.coalesce(*[r["path"] for r in records], F.lit("memory"))
    return F.when(all_failed, ner(None, path, F.array_join(failed, "; "))).otherwise(ner(ordered, path))


def _compare(a: Column, b: Column, fields: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for f in reversed(fields):
        out = F.when(a[f] < b[f], -1).when(a[f] > b[f], 1).otherwise(out)
    return out


def by_start_and_group(entities: Column) -> Column:
    return F.array_sort(entities, lambda a, b: _compare(a, b, ("start", "entity_group")))


def whitelist(entities: Column, keep: list[str], drop: list[str] | None = None) -> Column:
    """Entities of the groups to keep (all, if none is named) that are not to be dropped."""
    out = entities
    if keep:
        out = F.filter(out, lambda e: e["entity_group"].isin(*keep))
    return F.filter(out, lambda e: ~e["entity_group"].isin(*drop)) if drop else out


def document_delta(base: Column, merged: Column) -> Column:
    """The boxes of ``merged`` that ``base`` does not have; all of them if base is missing or failed.

    Boxes are told apart by identity strings made in the JVM; which are new is one pass with a set.
    """
    from ..functions.boxes import text_of
    from ..schemas import document

    usable = base.isNotNull() & (F.coalesce(base["exception"], F.lit("")) == "")
    known = F.when(usable, F.transform(base["bboxes"], identity))

    @F.pandas_udf("array<int>")
    def places(old: pd.Series, new: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(old, new, strict=True):
            seen = set(a) if a is not None else set()
            out.append([i for i, x in enumerate(b if b is not None else []) if x not in seen])
        return pd.Series(out)

    new = F.transform(places(known, F.transform(merged["bboxes"], identity)), lambda i: F.get(merged["bboxes"], i))
    made = document(text_of(new, "\n"), new, merged["path"], merged["type"])
    return F.when(F.coalesce(merged["exception"], F.lit("")) != "", document(path=merged["path"], exception=merged["exception"])).otherwise(made)


#: Boxes on each side of the place where a document was parted: more than an entity and what it is judged by take.
SEAM = 16


def seam(base: Column, rest: Column, width: int = SEAM) -> Column:
    """The last boxes of one part of a document and the first of the next as a document of their own, to be read as one."""

    @F.arrow_udf(DOCUMENT)
    def join(tails: pa.Array, heads: pa.Array) -> pa.Array:
        around = [(a or []) + (b or []) for a, b in zip(tails.to_pylist(), heads.to_pylist(), strict=True)]
        return pa.array([{"path": "memory", "text": " ".join(b["text"] for b in boxes), "type": "text", "bboxes": boxes, "exception": ""} for boxes in around], arrow_type(DOCUMENT))

    tail = F.slice(base["bboxes"], F.greatest(F.size(base["bboxes"]) - width, F.lit(0)) + 1, F.lit(width))
    return join(tail, F.slice(rest["bboxes"], 1, width))


def _place_of(b: dict) -> tuple:
    return (b["text"], *(math.floor(b[c] + 0.5) for c in ("x", "y", "width", "height")))


def settle_seam(df: DataFrame, readings: Sequence[str], seam_col: str, base: str, rest: str) -> DataFrame:
    """What two readings of a document's parts say where an entity lies across the seam, taken from the seam's own reading.

    Such an entity has the last box of the one part and the first of the other. The readings, which saw a part of it, lose
    what they found on its boxes; what the seam's reading found there goes to the first of them.
    """
    kind = f"struct<{','.join(f'r{i}:{ENTITIES}' for i in range(len(readings)))}>"

    @F.arrow_udf(kind)
    def settle(last: pa.Array, first: pa.Array, near: pa.Array, *found: pa.Array) -> pa.Array:
        made = []
        for a, b, here, *lists in zip(*(x.to_pylist() for x in (last, first, near, *found)), strict=True):
            places = lambda e: {_place_of(x) for x in e["boxes"]}
            ends = {_place_of(x) for x in (a, b) if x}
            across = set().union(*(p for p in map(places, here or []) if len(ends) == 2 and ends <= p))
            left = [None if kept is None else [e for e in kept if not places(e) & across] if across else kept for kept in lists]
            if across:
                left[0] = [*(left[0] or []), *(e for e in here if places(e) & across)]
            made.append({f"r{i}": v for i, v in enumerate(left)})
        return pa.array(made, arrow_type(kind))

    last, first = F.get(F.col(base)["bboxes"], F.size(F.col(base)["bboxes"]) - 1), F.get(F.col(rest)["bboxes"], F.lit(0))
    name = unused("__settled", df.columns)
    out = df.withColumn(name, settle(last, first, F.col(seam_col)["entities"], *[F.col(c)["entities"] for c in readings]))
    return out.withColumns({c: F.col(c).withField("entities", F.col(name)[f"r{i}"]) for i, c in enumerate(readings)}).drop(name)


def rebase_by_box(entities: DataFrame, boxes: DataFrame, scope: list[str], pos: str) -> DataFrame:
    """Spans of entities in another document, by their boxes.

    entities: scope, pos, word, start, end, box_ids array<string>. boxes: scope, box_id, lo, hi (of equal ids the last
    by lo holds), text. An entity takes the extent of its boxes that the document has, else the first place of its
    word, else it stays.
    """
    last = boxes.groupBy(*scope, "box_id").agg(F.max(F.struct("lo", "hi")).alias("at"))
    texts = boxes.groupBy(*scope).agg(F.first("text").alias("__text"))
    wide = entities.withColumn("box_id", F.explode_outer("box_ids"))
    found = wide.join(last, [*scope, "box_id"], "left").groupBy(*scope, pos).agg(F.min("at.lo").alias("__lo"), F.max("at.hi").alias("__hi"))
    joined = entities.join(found, [*scope, pos]).join(texts, scope, "left")
    at = F.nullif(F.instr("__text", F.col("word")), F.lit(0)) - 1
    start = F.coalesce("__lo", at, "start").cast("int")
    end = F.coalesce("__hi", at + F.length("word"), "end").cast("int")
    return joined.select(*[c for c in entities.columns if c not in ("start", "end", "box_ids")], start.alias("start"), end.alias("end"))


def extent_by_box(chars: DataFrame, scope: list[str]) -> DataFrame:
    """scope, box, lo, hi: the characters that belong to each box. chars: scope, pos, box."""
    return chars.where("box >= 0").groupBy(*scope, "box").agg(F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi"))


def box_extents(document: Column) -> Column:
    """array<struct<box,lo,hi>>: the boxes of a document that have characters of its text, and where these lie.

    An array for each document; a row for each character would be as many rows as the corpus has characters.
    """

    @F.arrow_udf("array<struct<box:int,lo:int,hi:int>>")
    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, words in (piece for batch in batches for piece in pieces(*batch)):
            made = []
            for text, own in zip(texts.to_pylist(), words.to_pylist(), strict=True):
                own = own or []
                made.append([{"box": i, "lo": at, "hi": at + len(w)} for i, (at, w) in enumerate(zip(box_places(text or "", own), own, strict=True)) if at >= 0])
            yield pa.array(made, arrow_type("array<struct<box:int,lo:int,hi:int>>"))

    return place(document["text"], F.transform(document["bboxes"], lambda b: b["text"]))


def rebase_entities(found: Sequence[dict], text: str, boxes: Sequence[dict]) -> list[dict]:
    """Entities with the offsets they have in another document: by their boxes, else by the first place of their word."""
    owner = char_to_box(text, [b["text"] for b in boxes])
    spans: dict[int, tuple[int, int]] = {}
    for i, o in enumerate(owner):
        if o >= 0:
            spans[o] = (spans.get(o, (i, i))[0], i + 1)
    number = {_place_of(b): i for i, b in enumerate(boxes)}
    out = []
    for e in found:
        at = [spans[n] for b in e["boxes"] if (n := number.get(_place_of(b))) in spans]
        if at:
            a, b = min(s for s, _ in at), max(t for _, t in at)
            out.append({**e, "start": a, "end": b, "word": e["word"] or text[a:b]})
        elif e["word"] and (a := text.find(e["word"])) >= 0:
            out.append({**e, "start": a, "end": a + len(e["word"])})
        else:
            out.append(dict(e))
    return out


def rebased(found: Column, document: Column) -> Column:
    """Entities moved to a document's offsets, as a column."""

    @F.pandas_udf(ENTITIES)
    def move(lists: pd.Series, texts: pd.Series, boxes: pd.Series) -> pd.Series:
        plain = lambda rows: [dict(r) for r in (rows if rows is not None else [])]
        return pd.Series([rebase_entities([{**e, "boxes": plain(e["boxes"])} for e in plain(found)], text or "", plain(near)) for found, text, near in zip(lists, texts, boxes, strict=True)])

    return move(found, document["text"], document["bboxes"])


# ---- greedy claims ----------------------------------------------------------------------------------------------


def claim(spans: Column) -> Column:
    """Spans (structs with start and end) in the order given, less those that overlap one kept before."""
    kind = "array<struct<start:int,end:int,tag:string>>"
    typed = F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["tag"].cast("string").alias("tag"))).cast(kind)
    step = lambda kept, s: F.when(F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(s)))
    return F.aggregate(typed, F.array().cast(kind), step)


def visible(spans: Column) -> Column:
    """Spans in the order given, less those that begin before the end of what is shown so far."""
    kind = "array<struct<start:int,end:int,tag:string>>"
    typed = F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["tag"].cast("string").alias("tag"))).cast(kind)
    zero = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("kept"))
    step = lambda acc, s: F.when(s["start"] < acc["end"], acc).otherwise(F.struct(s["end"].alias("end"), F.concat(acc["kept"], F.array(s)).alias("kept")))
    return F.aggregate(typed, zero, step)["kept"]


# ---- consistency over documents ---------------------------------------------------------------------------------


def vocabulary(entities: DataFrame, word: str = "word", group: str = "entity_group", score: str = "score", min_length: int = 3, min_score: float = 0.0, scope: list[str] | None = None) -> DataFrame:
    """phrase, label, score (the best), n: what each phrase was called. One row for each phrase and label."""
    scope = scope or []
    folded = entities.where(F.col(score) >= min_score).withColumn("phrase", fold(F.col(word))).where(F.length("phrase") >= min_length)
    return folded.groupBy(*scope, "phrase", F.col(group).alias("label")).agg(F.max(score).alias("score"), F.count(F.lit(1)).alias("n"))


def top_label(words: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The label of the best score, then of most occurrences, then the first in byte order."""
    w = Window.partitionBy(*(scope or []), "phrase").orderBy(F.col("score").desc(), F.col("n").desc(), F.col("label"))
    return words.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def propagate(text: str, words: Sequence[str], phrases: Sequence[tuple[str, list[tuple[str, float]]]], found: Sequence[dict], boxes: Sequence[dict] = (), override: bool = True) -> list[dict]:
    """Entities of one text made consistent with a vocabulary.

    words: the texts of the boxes. phrases: folded phrase and its (label, score) pairs. Longer phrases claim their
    whole-word places first (equally long ones in byte order). A claimed place takes the phrase's labels; where the
    model found the same span its own score stands for its own label, and without ``override`` its label too. Model
    entities that overlap nothing claimed stay.
    """
    if not text or not phrases:
        return []
    folded, places = fold_with_offsets(text)
    owner = char_to_box(text, words) if boxes else []
    by_span = {(e["start"], e["end"]): e for e in found}
    taken: list[tuple[int, int]] = []
    out: list[dict] = []
    for phrase, labels in sorted(phrases, key=lambda p: (-len(p[0]), p[0])):
        for at in whole_word_places(folded, phrase):
            if any(at < b and a < at + len(phrase) for a, b in taken):
                continue
            taken.append((at, at + len(phrase)))
            start, end = places[at], places[at + len(phrase) - 1] + 1
            own = by_span.get((start, end))
            base = {"word": text[start:end], "start": start, "end": end, "boxes": [boxes[i] for i in boxes_in_range(owner, start, end)] if boxes else []}
            if own is not None and not override:
                out.append({**own, **base, "source": own.get("source") or "model"})
                continue
            for label, score in labels:
                same = own is not None and own["entity_group"] == label
                out.append({"entity_group": label, "score": own["score"] if same else score, **base, "source": (own.get("source") or "model") if same else "propagated"})
    spans = [(e["start"], e["end"]) for e in out]
    out += [{**e, "source": e.get("source") or "model"} for e in found if not any(e["start"] < b and a < e["end"] for a, b in spans)]
    return sorted(out, key=lambda e: (e["start"], e["entity_group"]))


#: What the keys of phrases without a word begin with; no word does.
SIGNS = " "


def _pieces(folded: Column) -> Column:
    """The words of a folded text, each once."""
    return F.array_distinct(F.filter(F.split(folded, r"(?U)[^\p{L}\p{M}\p{N}]+"), lambda w: w != ""))


def _longest(words: Column) -> Column:
    """The longest word, the first of equal ones; null where there is none."""
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.get(ranked, 0)["w"]


def _runs_of_signs(folded: Column, size: int) -> Column:
    """Every run of so many characters that are no part of a word, each once, as the keys of phrases without a word."""
    found = F.regexp_extract_all(folded, F.lit(rf"(?U)(?=([^\p{{L}}\p{{M}}\p{{N}}]{{{size}}}))"), 1)
    return F.transform(F.array_distinct(found), lambda r: F.concat(F.lit(SIGNS), r))


def consistent(df: DataFrame, ner_col: str = "ner", text_col: str = "text", scope: list[str] | None = None, out: str | None = None, min_length: int = 3, min_score: float = 0.0, resolve_conflicts: bool = True, override: bool = True, row_scope: bool = False) -> DataFrame:
    """Make entities consistent: over all rows, within a scope of columns, or (``row_scope``) within each row.

    An entity stays without a phrase only if the vocabulary as a whole is not empty. The vocabulary is one aggregate. A
    row only needs the phrases that its text has: phrases are matched to rows by the longest word of each, an equi-join,
    and phrases without a word by their first signs, which few texts have. Neither side is broadcast by force.
    """
    out = out or ner_col
    # written once: both sides of the joins below must see the same row numbers
    base = saved(df.withColumn("__row", F.monotonically_increasing_id()), "consistency")
    scope = ["__row"] if row_scope else (scope or [])
    good = F.coalesce(F.col(f"{ner_col}.exception"), F.lit("")) == ""
    rows = base.where(good & F.col(ner_col).isNotNull()).select(*scope, F.explode(f"{ner_col}.entities").alias("e")).select(*scope, "e.*")
    words = vocabulary(rows, min_length=min_length, min_score=min_score, scope=scope)
    words = top_label(words, scope) if resolve_conflicts else words
    entry = words.groupBy(*scope, "phrase").agg(F.sort_array(F.collect_list(F.struct("label", "score"))).alias("labels"))
    signs = max(1, min(3, int(min_length)))
    entry = entry.withColumn("__key", F.coalesce(_longest(_pieces(F.col("phrase"))), F.concat(F.lit(SIGNS), F.substring("phrase", 1, signs))))
    own = base.select(*dict.fromkeys(["__row", *scope]), fold(F.col(f"{text_col}.text")).alias("__folded"))
    keys = F.array_union(_pieces(F.col("__folded")), _runs_of_signs(F.col("__folded"), signs))
    tokens = own.select("*", F.explode(keys).alias("__key")).drop("__folded")
    matched = tokens.join(entry, [*scope, "__key"]).groupBy("__row").agg(F.sort_array(F.collect_set(F.struct("phrase", "labels"))).alias("__phrases"))

    @F.arrow_udf(ENTITIES)
    def apply(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, boxes, entities, phrases in batches:
            made = []
            for i, (found, known) in enumerate(zip(entities.to_pylist(), phrases.to_pylist(), strict=True)):
                pairs = [(k["phrase"], [(x["label"], x["score"]) for x in k["labels"]]) for k in known or []]
                # only rows with a phrase need their text and boxes
                near = (boxes[i].as_py() or []) if pairs else []
                made.append(propagate((texts[i].as_py() or "") if pairs else "", [b["text"] for b in near], pairs, found or [], near, override))
            yield pa.array(made, FOUND)

    joined = base.join(matched, "__row", "left")
    fixed = apply(F.col(f"{text_col}.text"), F.col(f"{text_col}.bboxes"), F.col(f"{ner_col}.entities"), F.col("__phrases"))
    record = F.when(good, ner(fixed, F.col(f"{ner_col}.path"))).otherwise(F.col(ner_col))
    return joined.withColumn(out, record).drop("__row", "__phrases")


