"""N-gram Jaccard join: documents whose sets of five-word shingles are similar enough, and the classes they form.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case. A set holds the distinct 5-word shingles
as 64-bit hashes; with fewer words it holds the whole sequence; without words it is empty and linked with nothing. Two
sets link when 100 * intersection >= 80 * union.

Equal sets are one class, known by a 128-bit digest, from the first step on: only one document of them is compared.

Blocks. In any one order of shingles, two sets that link share one of the first ``n - ceil(0.8 n) + 1`` of each. The
order is by frequency, rare first, taken from a sketch of counts over all documents (sized by their bytes, up to 16
million counters), then by hash: what a third of all documents share comes last and makes no block. Sets that share such
a shingle are a block. Blocks of more than ``block`` sets are cut into parts, and each pair of parts is a task's work;
shingles that the sketch shows to be frequent never meet in one place.

Index. Shingles are hashed into groups, the counts of a set's groups are a point, and in each block an R-tree over the
points bounds the overlap with all sets below a node by the sum of the smaller coordinates. Pairs whose bound allows a
link become candidates; what is joined already needs no further pair, so that a group of near copies gives about one
candidate a document. Candidates form loose components.

Verification. Each loose component is compared in one place, by the same index and then exactly, on the sets made again
from the texts. Components of more than ``TILE`` sets are cut into tiles, and each pair of tiles is compared in a task
of its own.

Defined results: rows without doc_id have their set counted, a null component and no links; copies and rows that share
an id share what links they have; texts of any length are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .common import by_bytes, map_arrow, private, saved
from .graph import components

WORDS = 5
SIMILAR = 80
#: Sets that are compared in one place at most.
TILE = 2_000
#: Sets of one part of a block.
BLOCK = 500
#: Keys of blocks of several parts (16 bytes each) that are broadcast at most, else they are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Bytes of text for each counter of the sketch.
SKETCH_BYTES = 256
#: A shingle is taken for frequent from this count on, and from this many times the mean of the sketch's counters.
FREQUENT, ABOVE_MEAN = 100_000, 16
#: Rows (28 bytes each) that say where a text is compared; no more than these are broadcast, else the texts are shuffled.
BROADCAST_PLACES = 250_000
CHUNK_CHARS = 1_000_000
LEAF = 16
#: The largest count in a group that the index tells from others.
MOST = 65_535


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_table() -> tuple[np.ndarray, np.ndarray]:
    """For each byte, a random odd number (A-Z as a-z), and whether it separates words."""
    values = np.random.default_rng(5_003).integers(0, 1 << 63, 256, np.uint64) | np.uint64(1)
    values[65:91] = values[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return values, space


def shingle_sets(texts: list) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    values, space = byte_table()
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    firsts = 1 + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    blank = space[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    lengths = ends - starts
    bounds = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(int(lengths.sum())) - np.repeat(bounds, lengths)
    powers = np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    word = np.add.reduceat(values[data[~blank]] * powers[place], bounds)
    word = _mix(word + lengths.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    first_word = np.searchsorted(starts, firsts)
    last_word = np.searchsorted(starts, firsts + sizes)
    factors = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
    grams = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        grams += word[k : k + len(grams)] * factors[k]
    grams = _mix(grams)
    out = []
    for a, b in zip(first_word.tolist(), last_word.tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            few = (word[a:b] * np.array(factors[: b - a])).sum(keepdims=True) + np.uint64(b - a)
            out.append(_mix(few))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_keys(shingles: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first: a rank of frequency above 58 bits of hash."""
    n = len(shingles)
    take = n - -(-SIMILAR * n // 100) + 1
    rank = ranks[sketch.slots(shingles, len(ranks).bit_length() - 1)].astype(np.uint64)
    keys = (rank << np.uint64(58)) | (_mix(shingles) >> np.uint64(6))
    return np.partition(keys, take - 1)[:take]


def digest(shingles: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(shingles.astype("<u8").tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def group_counts(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of 16 to 256 groups (a power of two, about a sixth of the set's size); MOST stands for more too."""
    groups = int(np.clip(1 << int(np.ceil(np.log2(max(1, len(shingles) / 6)))), 16, 256))
    return np.minimum(np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups), MOST).astype("<u2")


def unbounded(counts: np.ndarray) -> np.ndarray:
    """Counts in 64 bits, with a bound that no count reaches for those that were clipped."""
    wide = counts.astype(np.int64)
    wide[counts == MOST] = 1 << 40
    return wide


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Counts in fewer groups: groups whose numbers agree in the low bits are added up."""
    return counts.reshape(-1, groups).sum(axis=0)


class CountTree:
    """An R-tree over count vectors, packed bottom-up in the order of set sizes."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, fan: int = LEAF):
        self.order = np.lexsort((counts.argmax(axis=1), sizes))
        self.counts, self.sizes, self.fan = counts[self.order], sizes[self.order], fan
        self.levels = []  # from the leaves up: the largest count in each coordinate, the smallest size
        high, low = self.counts, self.sizes
        while len(high) > fan:
            cuts = np.arange(0, len(high), fan)
            high, low = np.maximum.reduceat(high, cuts, axis=0), np.minimum.reduceat(low, cuts)
            self.levels.append((high, low))

    def query(self, point: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the points that may link with the one given."""
        at = np.arange(len(self.levels[-1][1]) if self.levels else len(self.sizes))
        for level in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[level]
            at = at[may_link(point, size, high[at], low[at])]
            below = len(self.levels[level - 1][1]) if level else len(self.sizes)
            at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
            at = at[at < below]
        return self.order[at[may_link(point, size, self.counts[at], self.sizes[at])]]


def may_link(point: np.ndarray, size: int, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Linked sets share 4/9 of the sum of their sizes at least (at 80 of 100); summed minima bound what they share."""
    most = np.minimum(counts, point).sum(axis=-1, dtype=np.int64)
    return (100 + SIMILAR) * most >= SIMILAR * (size + sizes)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    shared = int((large[at] == small).sum())
    return 100 * shared >= SIMILAR * (len(a) + len(b) - shared)


def classes(points: list[np.ndarray], sizes: np.ndarray, check, sides: np.ndarray | None = None) -> np.ndarray:
    """For each set the first set of its class, by pairs that the counts allow and ``check`` confirms.

    points: counts by group. Sets are compared with those of as many groups, and with those of twice as many, folded:
    sizes of linked sets differ by a quarter at most. sides: compare only sets of different sides (0 is on both).
    """
    label = np.arange(len(points))
    level = np.array([len(p) for p in points])
    for groups in np.unique(level).tolist():
        own = np.flatnonzero((level == groups) & (sizes > 0))
        if not len(own):
            continue
        guests = np.flatnonzero((level == 2 * groups) & (SIMILAR * sizes <= 100 * sizes[own].max()))
        at = np.sort(np.concatenate([own, guests]))
        counts = np.stack([folded(unbounded(points[i]), groups) for i in at.tolist()])
        size, guest = sizes[at], level[at] != groups
        tree = CountTree(counts, size) if len(at) > 2 * LEAF else None
        for i in range(1, len(at)):
            if tree is not None:
                found = tree.query(counts[i], int(size[i]))
                found = found[found < i]
            else:
                found = np.flatnonzero(may_link(counts[i], int(size[i]), counts[:i], size[:i]))
            found = found[label[at[found]] != label[at[i]]]
            if guest[i]:
                found = found[~guest[found]]
            if sides is not None and sides[at[i]]:
                found = found[sides[at[found]] != sides[at[i]]]
            for j in at[found].tolist():
                if label[j] != label[at[i]] and check(int(at[i]), j):
                    a, b = sorted((label[j], label[at[i]]))
                    label[label == b] = a
    return label


def frequency_sketch(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Ranks of shingles' occurrences over all documents, and the rank from which on a shingle is frequent."""
    bits = sketch.bits_for(sketch.text_bytes(df, text), SKETCH_BYTES)
    ranks, total = sketch.frequency_ranks(df, text, shingle_sets, bits)
    return ranks, int(np.ceil(np.log2(max(FREQUENT, ABOVE_MEAN * total / len(ranks)))))


SET = np.dtype([("doc", "<i8"), ("known", "u1"), ("rest", "<i8"), ("size", "<i8")])


def set_rows(df: DataFrame, doc_id: str, text: str, ranks: np.ndarray, frequent: int) -> DataFrame:
    """Rows of three kinds: kind, meet, key, mark, about.

    0: a document; mark is the first half of its set's digest, about holds its id, the other half, the size and the
    counts. 1: a key that the set with the mark has; 2: such a key that is frequent. Rows of kind 1 that share a key have
    the same ``meet``, those of other kinds do not.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, 0
        names = ["kind", "meet", "key", "mark", "about"]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in by_bytes(texts, CHUNK_CHARS):
                sets = shingle_sets(texts[a:b])
                marks = [digest(s) for s in sets]
                about = []
                for doc, s, m in zip(ids[a:b], sets, marks, strict=True):
                    head = np.array([(doc or 0, doc is not None, m[1], len(s))], SET)
                    about.append(head.tobytes() + group_counts(s).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b - a, np.int8)), pa.array(np.arange(seen, seen + b - a)), pa.nulls(b - a, pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array(about, pa.binary())], names=names)
                seen += b - a
                # equal sets of a chunk have equal keys: they are sent once
                once = {m: s for m, s in zip(marks, sets, strict=True) if len(s)}
                found = [prefix_keys(s, table) for s in once.values()]
                if found:
                    key = np.concatenate(found)
                    owner = np.repeat(np.array([m[0] for m in once], np.int64), [len(f) for f in found])
                    often = key >> np.uint64(58) >= frequent
                    meet = np.where(often, _mix(key ^ owner.view(np.uint64)), key).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array((1 + often).astype(np.int8)), pa.array(meet), pa.array(key.view(np.int64)), pa.array(owner), pa.nulls(len(key), pa.binary())], names=names)

    return map_arrow(df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")), run, "kind byte, meet long, key long, mark long, about binary")


def _open_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = [np.frombuffer(x, SET, 1)[0] for x in batch.column(1).to_pylist()]
        points = [x[SET.itemsize :] for x in batch.column(1).to_pylist()]
        docs = [int(h["doc"]) if h["known"] else None for h in heads]
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), batch.column(0), pa.array([int(h["rest"]) for h in heads], pa.int64()), pa.array([int(h["size"]) for h in heads], pa.int64()), pa.array(points, pa.binary())], names=["doc_id", "mark", "rest", "n", "point"])


def pair_may_link(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> bool:
    """What the index says of two sets alone: their sizes first, then the summed minima of their counts."""
    if 100 * min(size_a, size_b) < SIMILAR * max(size_a, size_b):
        return False
    if max(size_a, size_b) >= MOST:
        a, b = unbounded(a), unbounded(b)
    if len(a) > len(b):
        a, b = b, a
    if len(a) < len(b):
        b = b.reshape(-1, len(a)).sum(axis=0)
    return (100 + SIMILAR) * int(np.minimum(a, b).sum()) >= SIMILAR * (size_a + size_b)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and parts: key, low, high, side, mark, n, point. Links sets that the index can't tell apart."""
    out_a: list[int] = []
    out_b: list[int] = []
    now, rows = None, {}

    def done() -> None:
        if len(rows) == 2:
            (a, (side_a, n_a, point_a)), (b, (side_b, n_b, point_b)) = rows.items()
            if (side_a != side_b or not side_a) and pair_may_link(np.frombuffer(point_a, "<u2"), np.frombuffer(point_b, "<u2"), n_a, n_b):
                out_a.append(max(a, b))
                out_b.append(min(a, b))
        elif len(rows) > 2:
            marks = sorted(rows)
            points = [np.frombuffer(rows[m][2], "<u2") for m in marks]
            label = classes(points, np.array([rows[m][1] for m in marks], np.int64), lambda i, j: True, np.array([rows[m][0] for m in marks]))
            for i, j in enumerate(label.tolist()):
                if i != j:
                    out_a.append(marks[i])
                    out_b.append(marks[j])

    def send() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
        out_a.clear()
        out_b.clear()
        return made

    for batch in batches:
        for key, low, high, side, mark, n, point in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, low, high) != now:
                done()
                now, rows = (key, low, high), {}
            rows[mark] = (side, n, point)
        if out_a:
            yield send()
    done()
    if out_a:
        yield send()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile: tile, side, doc_id, mark, text. Gives links of documents to the first of their class."""
    now, rows = None, []

    def done() -> pa.RecordBatch:
        rows.sort(key=lambda r: r[1])
        sets: list[np.ndarray] = []
        for a, b in by_bytes([r[3] for r in rows], CHUNK_CHARS):
            sets += shingle_sets([r[3] for r in rows[a:b]])
        keep = [i for i, s in enumerate(sets) if digest(s)[0] == rows[i][2]]  # an id with several texts
        own = [sets[i] for i in keep]
        label = classes([group_counts(x) for x in own], np.array([len(x) for x in own], np.int64), lambda i, j: linked(own[i], own[j]), np.array([rows[i][0] for i in keep]))
        pairs = [(rows[keep[i]][1], rows[keep[j]][1]) for i, j in enumerate(label.tolist()) if i != j]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for tile, *row in zip(*columns, strict=True):
            if tile != now:
                if len(rows) > 1:
                    yield done()
                now, rows = tile, []
            rows.append(tuple(row))
    if len(rows) > 1:
        yield done()


def in_pairs_of_parts(df: DataFrame, of: str, parts: Column) -> DataFrame:
    """Rows with low, high and side: each row once for each part that its own part is to be compared with.

    Parts are compared within themselves where a part meets itself (side 0), and across in each pair of parts.
    """
    own = df.withColumn("own", F.pmod(F.xxhash64(of), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return own.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).withColumn("side", side.cast("int")).drop("own", "other")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: int = TILE, broadcast_places: int = BROADCAST_PLACES, block: int = BLOCK, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, the document itself included)."""
    rows = set_rows(df, doc_id, text, *frequency_sketch(df, text))
    # keys that only one set has end in the window
    w = Window.partitionBy("kind", "meet")
    found = saved(rows.withColumn("lo", F.min("mark").over(w)).withColumn("hi", F.max("mark").over(w)).where("kind <> 1 or lo < hi").select("kind", "key", "mark", "about"), "sets")
    docs = map_arrow(found.where("kind = 0").select("mark", "about"), _open_sets, "doc_id long, mark long, rest long, n long, point binary")
    points = docs.where("n > 0").groupBy("mark").agg(F.first(F.struct("n", "point")).alias("s")).select("mark", "s.*")
    keys = found.where("kind > 0").select("key", "mark").distinct()
    large = saved(keys.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > block).select("key", F.ceil(F.col("sets") / block).cast("int").alias("parts")), "large")
    few = large.count() <= broadcast_keys
    cut = in_pairs_of_parts(keys.join(F.broadcast(large) if few else large, "key", "left"), "mark", F.coalesce("parts", F.lit(1)))
    blocks = cut.join(points, "mark").select("key", "low", "high", "side", "mark", "n", "point")
    tiles = ("key", "low", "high")
    near = map_arrow(blocks.repartition(*tiles).sortWithinPartitions(*tiles), _block_links, "a long, b long")
    loose = components(near)
    docs = docs.drop("point")
    firsts = saved(docs.where("n > 0 and doc_id is not null").groupBy("mark", "rest").agg(F.min("doc_id").alias("first")), "classes")
    members = saved(firsts.join(loose, F.col("mark") == F.col("node")).select(F.col("label").alias("comp"), F.col("first").alias("doc"), "mark"), "members")
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    # few sets: one place. Many: parts, and a place for each pair of parts
    placed = in_pairs_of_parts(members.join(sizes, "comp"), "doc", F.ceil(F.col("members") / tile).cast("int"))
    placed = placed.select(F.xxhash64("comp", "low", "high").alias("tile"), "side", "doc", "mark")
    texts = df.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    placed = saved(placed, "places")
    few = placed.count() <= broadcast_places
    rows = texts.join(F.broadcast(placed) if few else placed.hint("shuffle_hash"), "doc").select("tile", "side", "doc", "mark", "text")
    links = map_arrow(rows.repartition("tile").sortWithinPartitions("tile"), _compare, "a long, b long")
    strict = components(links).select(F.col("node").alias("first"), F.col("label"))
    named = firsts.join(strict, "first", "left").select("mark", "rest", F.coalesce("label", "first").alias("component_id"))
    joined = docs.join(named, ["mark", "rest"], "left")
    whole = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), whole).alias("component_id"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose id is the smallest of its class; columns as they were. Rows without id stay; rows that share an id
    are one document and stay or go together."""
    (gone,) = private(df, "gone")
    copies = near_duplicates(df, doc_id, text).where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return df.join(copies, F.col(doc_id).cast("long") == F.col(gone), "left_anti")
