"""Language identification of words and texts.

Each word's letters give a script; the scripts seen in training narrow the languages that the word can have, and a text
is searched only among the candidates of its words. A word's score for a language is the sum of the language's log
probabilities of the word's byte trigrams. A Viterbi pass over the words, with a penalty for each switch, labels spans;
the language with most letters in its spans is the text's.

Training counts trigrams in a sample of labelled rows: all rows whose hashed id falls under a threshold that makes about
``sample_rows`` rows of them (a documented bound). Everything else covers all rows and whole texts.

Defined results: null texts and texts without a letter (Unicode category L) are ``und`` with score 0 and no spans; with no training row
every text is ``und``; ties go to the language that sorts first; copies of a text get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_arrow, private

UNDETERMINED = "und"
#: Training rows to aim for; bounds the sample.
SAMPLE_ROWS = 12_000
#: Log probability that a change of language costs.
SWITCH_PENALTY = 12.0
#: A language is a candidate for a script that has this share of its training letters.
SCRIPT_SHARE = 0.005
BUCKETS = 1 << 16
#: Counts of a language that come to the driver as one row.
PACKED = 1 << 11
#: Words of one Viterbi block: longer texts are cut into blocks that are joined exactly.
BLOCK = 256
CHUNK_CHARS = 1_000_000
#: Languages up to which blocks of one text advance together; a block then holds a score for each pair of languages.
BLOCK_LANGS = 8
LETTER = regex.compile(r"\p{L}")

# First code points of script ranges, from the Unicode block list, and the script that begins there.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x30000, "Other"),
)


@dataclass
class Model:
    """langs sorted; weights (BUCKETS, langs) float32 log probabilities; scripts (script count, langs) booleans."""

    langs: list[str]
    weights: np.ndarray
    scripts: np.ndarray


def script_table() -> tuple[np.ndarray, np.ndarray, list[str]]:
    names = sorted({name for _, name in SCRIPTS})
    return np.array([first for first, _ in SCRIPTS]), np.array([names.index(name) for _, name in SCRIPTS]), names


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def letter_bytes() -> np.ndarray:
    """ASCII letters and all bytes beyond ASCII stand for themselves, everything else for a space."""
    table = np.full(256, 32, np.uint8)
    for b in range(256):
        if b >= 128 or chr(b).isalpha():
            table[b] = b
    return table


def words_of(texts: list[str]):
    """The texts' words: bytes (with spaces between), word starts and ends, and each word's text."""
    raw = [_lower(t).encode("utf-8", "replace") for t in texts]
    data = letter_bytes()[np.frombuffer(b"  " + b"  ".join(raw) + b"  ", np.uint8)]
    sizes = np.array([len(r) + 2 for r in raw], np.int64)
    firsts = 2 + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    inside = data != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    return data, starts, ends, np.searchsorted(firsts, starts, "right") - 1, firsts


def trigram_codes(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram around each byte."""
    a = data.astype(np.uint32)
    code = np.zeros(len(a), np.uint32)
    code[1:-1] = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    code *= np.uint32(2654435761)
    return code >> np.uint32(16)


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters whose first bytes are at the places given."""
    pad = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
    b0, b1, b2, b3 = (pad[at + i] & (0xFF if i == 0 else 0x3F) for i in range(4))
    return np.select(
        [b0 < 0x80, b0 < 0xE0, b0 < 0xF0],
        [b0, ((b0 & 0x1F) << 6) | b1, ((b0 & 0x0F) << 12) | (b1 << 6) | b2],
        ((b0 & 0x07) << 18) | (b1 << 12) | (b2 << 6) | b3,
    )


def word_scripts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each word's script: that of its last letter outside Latin, else Latin."""
    firsts, ids, names = script_table()
    out = np.full(len(starts), names.index("Latin"), np.int64)
    lead = np.flatnonzero(data >= 0xCD)  # U+0340 and up; below, all letters are Latin
    if len(lead):
        kind = ids[np.searchsorted(firsts, code_points(data, lead), "right") - 1]
        other = (kind != names.index("Latin")) & (kind != names.index("Other"))
        out[np.searchsorted(starts, lead[other], "right") - 1] = kind[other]
    return out


def word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(words, langs): log probabilities, and which languages the word's script leaves (all where it leaves none)."""
    if not len(starts):
        return np.zeros((0, len(model.langs)), np.float32), np.zeros((0, len(model.langs)), bool)
    inside = np.flatnonzero(data != 32)
    per_byte = model.weights[trigram_codes(data)[inside]]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
    scores = np.add.reduceat(per_byte, bounds, axis=0)
    allowed = model.scripts[word_scripts(data, starts)]
    allowed |= ~allowed.any(axis=1, keepdims=True)
    scores[~allowed] -= 1e6
    return scores, allowed


def best_labels(scores: np.ndarray, allowed: np.ndarray, owner: np.ndarray, n_texts: int, penalty: float) -> np.ndarray:
    """The best label of each word; texts of the same candidates are searched together, among these alone."""
    n, k = scores.shape
    out = np.zeros(n, np.int64)
    if not n:
        return out
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    sets, kind = np.unique(np.logical_or.reduceat(allowed, first, axis=0), axis=0, return_inverse=True)
    of_word = np.repeat(kind.ravel(), np.diff(np.concatenate([first, [n]])))
    for i, columns in enumerate(sets):
        at, langs = np.flatnonzero(of_word == i), np.flatnonzero(columns)
        if len(langs) == 1:
            out[at] = langs[0]
            continue
        block = BLOCK if len(langs) <= BLOCK_LANGS else max(1, len(at))
        out[at] = langs[viterbi(scores[np.ix_(at, langs)] if len(langs) < k else scores[at], owner[at], n_texts, penalty, block)]
    return out


def viterbi(scores: np.ndarray, owner: np.ndarray, n_texts: int, penalty: float, block: int = BLOCK) -> np.ndarray:
    """The best label of each word. owner: each word's text, ascending.

    Texts are cut into blocks; all blocks advance together, one word a step, from each possible label before the
    block. The blocks' transfer scores are then joined per text and the labels read backwards: an exact Viterbi pass.
    Where every text is one block, the label before it is free, and a word needs one score for each label, not a square.
    """
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    per_text = np.bincount(owner, minlength=n_texts)
    text_first = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    blocks_of = -(-per_text // block)
    total = int(blocks_of.sum())
    block_text = np.repeat(np.arange(n_texts), blocks_of)
    nth = np.arange(total) - np.repeat(np.concatenate([[0], np.cumsum(blocks_of)[:-1]]), blocks_of)
    first = text_first[block_text] + nth * block
    size = np.minimum(block, text_first[block_text] + per_text[block_text] - first)
    order = np.argsort(-size, kind="stable")
    first_o, size_o = first[order], size[order]
    longest = int(size_o[0])
    active = np.searchsorted(-size_o, -np.arange(longest), "left")  # blocks longer than t
    # value[b, e, l]: best score of block b up to the step, entered from label e, now at label l
    kind = np.int8 if k < 128 else np.int32
    enter = np.where(np.eye(k, dtype=bool), 0.0, -penalty) if int(blocks_of.max()) > 1 else np.zeros((1, k))
    value = enter.astype(np.float64)[None].repeat(total, 0)
    value += scores[first_o][:, None, :]
    back = np.zeros((n, len(enter), k), kind)
    labels = np.arange(k, dtype=kind)
    for t in range(1, longest):
        a = active[t]
        v = value[:a]
        best = v.argmax(axis=2)
        top = np.take_along_axis(v, best[..., None], 2) - penalty
        stay = v >= top
        back[first_o[:a] + t] = np.where(stay, labels, best[..., None])
        value[:a] = np.where(stay, v, top) + scores[first_o[:a] + t][:, None, :]
    whole = np.empty_like(value)
    whole[order] = value
    # join the blocks of each text; all texts advance together, one block a step
    text_block = np.concatenate([[0], np.cumsum(blocks_of)[:-1]])
    most = int(blocks_of.max())
    came = np.zeros((total, k), kind)
    state = np.zeros((n_texts, k))
    has = np.flatnonzero(blocks_of > 0)
    # before a text's first word any label is free, so the best entry is the first word's own label
    state[has] = whole[text_block[has]].max(axis=1)
    came[text_block[has]] = whole[text_block[has]].argmax(axis=1)
    for j in range(1, most):
        on = np.flatnonzero(blocks_of > j)
        b = text_block[on] + j
        cand = state[on][:, :, None] + whole[b]
        came[b] = cand.argmax(axis=1)
        state[on] = cand.max(axis=1)
    exit_label = np.zeros(total, np.int64)
    enter_label = np.zeros(total, np.int64)
    final = state.argmax(axis=1)
    for j in range(most - 1, -1, -1):
        on = np.flatnonzero(blocks_of > j)
        b = text_block[on] + j
        last = blocks_of[on] == j + 1
        exit_label[b] = np.where(last, final[on], exit_label[b])
        enter_label[b] = came[b, exit_label[b]]
        if j:
            exit_label[b - 1] = enter_label[b]
    out = np.zeros(n, np.int64)
    now, entered = exit_label[order].copy(), enter_label[order]
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = first_o[:a] + t
        out[at] = now[:a]
        if t:
            now[:a] = back[at, entered[:a], now[:a]]
    return out


def label_words(texts: list[str], model: Model, penalty: float = SWITCH_PENALTY):
    """data, starts, ends, owner, firsts and labels of the words of the texts."""
    data, starts, ends, owner, firsts = words_of(texts)
    labels = best_labels(*word_scores(data, starts, ends, model), owner, len(texts), penalty)
    return data, starts, ends, owner, firsts, labels


def predict_texts(texts: list, model: Model, penalty: float = SWITCH_PENALTY) -> tuple[list[str], list[float]]:
    """Each text's language and the share of its letters in spans of that language."""
    if not model.langs:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    k = len(model.langs)
    plain = [t or "" for t in texts]
    _, starts, ends, owner, _, labels = label_words(plain, model, penalty)
    weight = np.bincount(owner * k + labels, weights=ends - starts, minlength=k * len(plain)).reshape(-1, k)
    best, total = weight.argmax(axis=1), weight.sum(axis=1)
    lettered = [bool(LETTER.search(t)) for t in plain]
    langs = [model.langs[b] if ok and n else UNDETERMINED for b, n, ok in zip(best, total, lettered, strict=True)]
    scores = [float(w / n) if ok and n else 0.0 for w, n, ok in zip(weight.max(axis=1), total, lettered, strict=True)]
    return langs, scores


def spans_of(text: str, model: Model, penalty: float = SWITCH_PENALTY) -> list[tuple[int, int, str]]:
    """Half-open character ranges of one text and their languages, joined where neighbours agree."""
    if not text or not model.langs or not LETTER.search(text):
        return []
    data, starts, ends, _, firsts, labels = label_words([text], model, penalty)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    zero = chars[firsts[0]]
    change = np.flatnonzero(np.diff(labels)) + 1
    begin, stop = np.concatenate([[0], change]), np.concatenate([change, [len(labels)]]) - 1
    return [(int(chars[starts[a]] - zero), int(chars[ends[b]] - zero), model.langs[labels[a]]) for a, b in zip(begin, stop, strict=True)] if len(labels) else []


def fit(df: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows where ``usable`` holds and lang and text are not null."""
    rows = df.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = rows.count()
    if not n:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((1, 0), bool))
    part = rows.where(F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1 << 20)) < max(1, round((1 << 20) * min(1.0, sample_rows / n))))
    counted = map_arrow(part.select(F.col(lang).alias("lang"), F.col(text).alias("text")), _count_batches, "lang string, feature int, n double")
    # for each language a number of rows of a fixed size come back, however many rows are counted
    summed = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).withColumn("part", F.floor(F.col("feature") / PACKED))
    got = summed.groupBy("lang", "part").applyInArrow(_pack_counts, "lang string, part long, counts binary").collect()
    langs = sorted({r.lang for r in got})
    counts = np.zeros((-(-(BUCKETS + len(script_table()[2])) // PACKED) * PACKED, len(langs)))
    for r in got:
        counts[r.part * PACKED : (r.part + 1) * PACKED, langs.index(r.lang)] = np.frombuffer(r.counts, "<f4")
    counts = counts[: BUCKETS + len(script_table()[2])]
    grams, letters = counts[:BUCKETS], counts[BUCKETS:]
    smooth = grams + 0.5
    weights = np.log(smooth / smooth.sum(axis=0))
    return Model(langs, weights.astype(np.float32), letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1))


def _pack_counts(rows: pa.Table) -> pa.Table:
    """Some of one language's counts as one array of 32-bit numbers."""
    counts = np.zeros(PACKED, "<f4")
    counts[rows.column("feature").to_numpy() % PACKED] = rows.column("n").to_numpy()
    return pa.table({"lang": rows.column("lang")[:1], "part": rows.column("part")[:1], "counts": pa.array([counts.tobytes()], pa.binary())})


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram and script counts of a task's rows, by language."""
    counts: dict[str, np.ndarray] = {}
    n_scripts = len(script_table()[2])
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in dict.fromkeys(langs):
            own = [t for x, t in zip(langs, texts, strict=True) if x == lang]
            held = counts.setdefault(lang, np.zeros(BUCKETS + n_scripts))
            for a, b in by_bytes(own, CHUNK_CHARS):
                data, starts, ends, _, _ = words_of(own[a:b])
                held[:BUCKETS] += np.bincount(trigram_codes(data)[data != 32], minlength=BUCKETS)
                if len(starts):
                    held[BUCKETS:] += np.bincount(word_scripts(data, starts), weights=ends - starts, minlength=n_scripts)
    for lang, held in counts.items():
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(held[at], pa.float64())], names=["lang", "feature", "n"])


def predict(df: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score", spans: str | None = None, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Add the predicted language and score, and on request the spans; columns of those names are replaced."""
    new = {lang_pred, score, spans} - {None}
    (own_text,) = private(df, "text")
    base = df.select(*[c for c in df.columns if c not in new], F.col(text).alias(own_text))
    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.scripts))  # bounded by langs x BUCKETS
    kept = [f for f in base.schema.fields if f.name != own_text]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + f"`{lang_pred}` string, `{score}` double" + (f", `{spans}` array<struct<start:int,end:int,lang:string>>" if spans else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            langs, scores = [], []
            for a, b in by_bytes(texts, CHUNK_CHARS):
                x, y = predict_texts(texts[a:b], own, penalty)
                langs += x
                scores += y
            cols = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            if spans:
                found = [[{"start": a, "end": b, "lang": x} for a, b, x in spans_of(t, own, penalty)] for t in texts]
                cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], lang_pred, score, *([spans] if spans else [])])

    return map_arrow(base, run, schema)
