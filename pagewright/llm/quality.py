"""Text quality by a factorisation machine.

Inputs of a score: hashed words (as written, with the signs attached to them), statistics of the text's structure, and
metadata (the declared length). Each is a feature with a weight and a low-rank vector; a pair of features interacts by
the product of their vectors, and the sum over all pairs takes linear time:
``1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.

The model is fitted on the driver on a sample of labelled rows: those whose hashed id falls under a threshold that
makes about ``sample_rows`` of them, or fewer if their features would take more than about ``sample_bytes``: documented
bounds. Every row is scored, by its whole text.

Defined results: null and empty texts are scored from their statistics alone; null labels are not learnt from, and of
several labels of one id the highest counts; without labelled rows every score is 0.5; equal texts with equal metadata
get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_arrow, private, saved

#: Labelled rows to aim for; bounds the sample that comes to the driver.
SAMPLE_ROWS = 6_000
#: Bytes of features that the sample has at most, about; where its texts are long, fewer rows of it are used.
SAMPLE_BYTES = 160_000_000
WORD_BITS = 14
BINS = 16
RANK = 8
EPOCHS = 12
CHUNK_CHARS = 1_000_000
#: Weight of one statistic's feature; a text's word features have unit length together.
STAT_VALUE = 0.35

STATS = ("bytes", "words", "word_length", "upper", "digits", "signs", "beyond_ascii", "spaces", "lines", "distinct", "ends_in_sign", "bars", "sign_runs", "declared", "declared_differs")


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray


def n_features() -> int:
    return (1 << WORD_BITS) + BINS * len(STATS)


def byte_classes() -> np.ndarray:
    """(256, 7): upper case, digits, signs, beyond ASCII, white space, line ends, bars."""
    out = np.zeros((256, 7), bool)
    for b in range(256):
        c = chr(b)
        space = b == 32 or 9 <= b <= 13
        out[b] = (b < 128 and c.isupper(), b < 128 and c.isdigit(), 32 < b < 127 and not c.isalnum(), b >= 128, space, b == 10, c == "|")
    return out


def hash_table() -> np.ndarray:
    """A random 32-bit number for each byte at each of 32 places of a word."""
    return np.random.default_rng(20_011).integers(0, 1 << 32, (32, 256), np.uint32)


def features(texts: list[str], declared: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values, and the first entry of each text (one more than texts)."""
    n = len(texts)
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    firsts = 1 + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    classes = byte_classes()
    kinds = classes[data]
    space = kinds[:, 4]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    owner = np.searchsorted(firsts, starts, "right") - 1
    # words: tabulation hash, counted within each text
    inside = np.flatnonzero(~space)
    lengths = ends - starts
    bounds = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    place = np.minimum(np.arange(len(inside)) - np.repeat(bounds, lengths), 31)
    hashed = np.add.reduceat(hash_table()[place, data[inside]], bounds, dtype=np.uint32) if len(starts) else np.zeros(0, np.uint32)
    bucket = ((hashed * np.uint32(2654435761)) >> np.uint32(32 - WORD_BITS)).astype(np.int64)
    key, count = np.unique((owner << WORD_BITS) | bucket, return_counts=True)
    of, word = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(of, weights=value**2, minlength=n))
    value = value / norm[of] if len(of) else value.astype(float)
    # statistics
    running = np.concatenate([np.zeros((1, kinds.shape[1]), np.int64), np.cumsum(kinds, axis=0, dtype=np.int64)])
    total = running[firsts + sizes] - running[firsts]
    words = np.bincount(owner, minlength=n)
    distinct = np.bincount(of, minlength=n)
    some = np.maximum(sizes, 1)
    sign = classes[:, 2]
    ends_in_sign = np.bincount(owner, weights=sign[data[ends - 1]], minlength=n) if len(starts) else np.zeros(n)
    ends_in_two = np.bincount(owner, weights=sign[data[ends - 1]] & sign[data[ends - 2]], minlength=n) if len(starts) else np.zeros(n)
    said = np.array([-1 if d is None else int(d) for d in declared], np.int64)
    actual = np.array([len(t) for t in texts], np.int64)
    scale = lambda x: np.minimum(np.log2(np.maximum(x, 0) + 1), BINS - 1)
    share = lambda x: np.sqrt(np.clip(x, 0, 1)) * (BINS - 1)
    many = np.maximum(words, 1)
    columns = [
        scale(sizes), scale(words), np.minimum(sizes / many, BINS - 1), share(total[:, 0] / some), share(total[:, 1] / some), share(total[:, 2] / some),
        share(total[:, 3] / some), share(total[:, 4] / some), share(8 * total[:, 5] / some), (BINS - 1) * distinct / many, (BINS - 1) * ends_in_sign / many,
        share(total[:, 6] / many), (BINS - 1) * ends_in_two / many, np.where(said < 0, BINS - 1, scale(said)), np.where(said < 0, 2, said != actual),
    ]
    stats = np.clip(np.stack(columns, axis=1).astype(np.int64), 0, BINS - 1) + BINS * np.arange(len(STATS)) + (1 << WORD_BITS)
    # merge, text by text
    all_of = np.concatenate([of, np.repeat(np.arange(n), len(STATS))])
    order = np.argsort(all_of, kind="stable")
    number = np.concatenate([word, stats.ravel()])[order]
    values = np.concatenate([value, np.full(stats.size, STAT_VALUE)])[order]
    return number, values, np.concatenate([[0], np.cumsum(distinct + len(STATS))])


def margin(m: Machine, number: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The machine's sum for each text, in time linear in its features."""
    at = first[:-1]
    scaled = m.vectors[number] * value[:, None]
    total = np.add.reduceat(scaled, at, axis=0)
    squares = np.add.reduceat((scaled**2).sum(axis=1), at)
    return m.bias + np.add.reduceat(m.weights[number] * value, at) + 0.5 * ((total**2).sum(axis=1) - squares)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(number: np.ndarray, value: np.ndarray, first: np.ndarray, y: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.15, decay: float = 2e-4, batch: int = 128, seed: int = 7) -> Machine:
    """Logistic loss, small batches, one adaptive step size for each parameter."""
    rng = np.random.default_rng(seed)
    size = n_features()
    prior = (y.sum() + 1) / (len(y) + 2)
    m = Machine(float(np.log(prior / (1 - prior))), np.zeros(size), rng.normal(0, 0.05, (size, rank)))
    seen_w, seen_v, seen_b = np.full(size, 1e-2), np.full((size, rank), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), batch):
            rows = order[a : a + batch]
            counts = first[rows + 1] - first[rows]
            own = np.concatenate([[0], np.cumsum(counts)])
            at = np.repeat(first[rows] - own[:-1], counts) + np.arange(own[-1])
            num, val = number[at], value[at]
            doc = np.repeat(np.arange(len(rows)), counts)
            error = (sigmoid(margin(m, num, val, own)) - y[rows]) / len(rows) * 16
            scaled = m.vectors[num] * val[:, None]
            total = np.add.reduceat(scaled, own[:-1], axis=0)
            used, back = np.unique(num, return_inverse=True)
            step = (error[doc] * val)[:, None] * np.concatenate([np.ones((len(num), 1)), total[doc] - scaled], axis=1)
            grad = np.stack([np.bincount(back, weights=step[:, i], minlength=len(used)) for i in range(rank + 1)], axis=1)
            gw = grad[:, 0] + decay * m.weights[used]
            gv = grad[:, 1:] + decay * m.vectors[used]
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            m.weights[used] -= rate * gw / np.sqrt(seen_w[used])
            m.vectors[used] -= 0.3 * rate * gv / np.sqrt(seen_v[used])
            gb = float(error.sum())
            seen_b += gb**2
            m.bias -= rate * gb / np.sqrt(seen_b)
    return m


def score_texts(m: Machine | None, texts: list, declared: list) -> np.ndarray:
    if m is None:
        return np.full(len(texts), 0.5)
    return sigmoid(margin(m, *features([t or "" for t in texts], declared))) if texts else np.zeros(0)


def _declared(declared: str | None) -> Column:
    return F.col(declared).cast("long") if declared else F.lit(None).cast("long")


def _threshold(doc_id: Column, share: float) -> Column:
    """Whether a hashed id falls under a threshold that about this share of all ids meets."""
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(1 << 20)) < max(1, round((1 << 20) * min(1.0, share)))


def fit(df: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", declared: str | None = "n_chars", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Machine | None:
    """Learn from labelled rows where ``usable`` (over the id) holds."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & usable).groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.max(label).alias("y"))
    n = known.count()
    if not n:
        return None
    part = known.where(_threshold(F.col("id"), sample_rows / n))
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), _declared(declared).alias("declared")).join(F.broadcast(part), "id")  # about sample_rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, said = [t or "" for t in batch.column(1).to_pylist()], batch.column(2).to_pylist()
            ids, y = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for a, b in by_bytes(texts, CHUNK_CHARS):
                number, value, first = features(texts[a:b], said[a:b])
                cut = [(number[i:j].astype("<i4").tobytes(), value[i:j].astype("<f4").tobytes()) for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array([int(v > 0) for v in y[a:b]], pa.int32()), pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary())], names=["id", "y", "number", "value"])

    # the sample is written, so that its size is known before it comes to the driver
    made = saved(map_arrow(rows.select("id", "text", "declared", "y"), run, "id long, y int, number binary, value binary"), "quality-sample")
    size = made.agg(F.sum(F.octet_length("number") + F.octet_length("value"))).first()[0] or 0
    if size > sample_bytes:
        made = made.where(_threshold(F.col("id"), sample_rows / n * sample_bytes / size))
    got = sorted(made.collect())
    if not got:
        return None
    number = np.frombuffer(b"".join(bytes(r.number) for r in got), "<i4").astype(np.int64)
    value = np.frombuffer(b"".join(bytes(r.value) for r in got), "<f4").astype(float)
    first = np.concatenate([[0], np.cumsum([len(r.number) // 4 for r in got])])
    return train(number, value, first, np.array([r.y for r in got], float))


def score(df: DataFrame, machine: Machine | None, text: str = "text", declared: str | None = "n_chars", out: str = "score") -> DataFrame:
    """Add the probability of a good text; a column of that name is replaced."""
    kept = [c for c in df.columns if c != out]
    base = df.select(*kept, *[c.alias(n) for c, n in zip((F.col(text), _declared(declared)), private(df, "text", "declared"), strict=True)])
    shared = df.sparkSession.sparkContext.broadcast(None if machine is None else (machine.bias, machine.weights, machine.vectors))  # fixed size
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept) + f"`{out}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if shared.value is None else Machine(*shared.value)
        for batch in batches:
            texts, said = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            scores = [score_texts(own, texts[a:b], said[a:b]) for a, b in by_bytes(texts, CHUNK_CHARS)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())], names=[*batch.schema.names[:-2], out])

    return map_arrow(base, run, schema)
