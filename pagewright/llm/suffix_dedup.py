"""Removal of passages that an earlier document has, by suffix arrays.

Every byte covered by a 50-byte string that also starts in a document with a smaller id is removed. Strings are bytes of
UTF-8, never cross documents, and are judged on the input.

0. Of equal texts only the row with the smallest id is looked at further: the others are covered whole.
1. Each 50-byte window picks one 20-byte gram in it: the rarest by a sketch of counts over all documents, of these the
   one of smallest hash (the leftmost of equal ones). Equal windows pick equal grams, so only windows whose gram occurs
   in several documents can be shared; and a gram that very many documents have is picked only by windows that hold
   nothing rarer, which are the inner windows of a passage that all of them share and are sent once by each task. Tasks
   send the grams' hashes packed, each at most once where a task has it in several documents, and learn which are shared.
2. The windows that picked a shared gram are cut out as segments; equal segments of a task are sent once, with the
   smallest id that has them, to the gram's bucket; each place of a segment is sent as a few bytes.
   What is found out about documents returns packed, a few rows from each task.
3. A bucket's segments are put in suffix order in two stages: suffixes that are not larger than their successor are
   sorted directly, all others follow from these by one scan over the buckets of first bytes. Neighbours in that order
   that share 50 bytes form classes; the smallest id of a class decides which places are covered.
4. Covered ranges return to their documents, which drop the bytes.

Hashes only choose what is compared: a shared hash costs work and changes nothing, as segments are compared by bytes.
What is found returns to rows by their id and a 64-bit hash of id and text, or by 128 bits of hash where they have no id;
equal texts are known by 128 bits of hash and their length.

Defined results: null texts are empty; texts under 50 bytes keep everything; rows that share an id never remove each
other's text; a null id counts as the largest id there is; repeated rows get equal results. Buckets are sized by the
bytes of text, up to 16 million of them (100 TB); beyond, they grow.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import map_arrow, private

LENGTH = 50
GRAM = 20
#: Bytes that are worked on at once; longer texts are cut into pieces that overlap by a window.
PIECE = 1 << 19
PLACE_BITS = 21
#: Text bytes for each bucket of segments, and buckets of segments that share one of grams; both bound what a task holds.
BUCKET_BYTES = 6_000_000
GRAM_BUCKETS = 4
#: Grams that a task holds before it sends them.
HELD = 700_000
#: Bytes of text for each counter of the sketch.
SKETCH_BYTES = 1024
SALTS = 16
NO_ID = 2**63 - 1
KEY_BYTES = 5


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the gram that starts at each byte (only whole grams)."""
    table = np.random.default_rng(4_177).integers(0, 1 << 63, 256, np.uint64) | np.uint64(1)
    level, step, base = table[data], 1, 0x9E3779B97F4A7C15
    out, have = None, 0
    while True:
        if size & step:
            if out is None:
                out, have = level, step
            else:
                n = len(level) - have
                out = out[:n] * np.uint64(base) + level[have : have + n]
                have += step
        if step * 2 > size:
            return _mix(out)
        level = level[: len(level) - step] * np.uint64(base) + level[step:]
        base = base * base % (1 << 64)
        step *= 2


def runs_of_windows(data: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and gram hash of each run of windows that pick one gram."""
    if len(data) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64)
    hashes = gram_hashes(data)
    # six bits of rank, 37 of another hash, the place
    rank = ranks[sketch.slots(hashes, len(ranks).bit_length() - 1)].astype(np.uint64) << np.uint64(58)
    other = (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(6 + PLACE_BITS) << np.uint64(PLACE_BITS)
    picked = rank | other | np.arange(len(hashes), dtype=np.uint64)
    width, span = 1, LENGTH - GRAM + 1
    while width * 2 <= span:
        picked = np.minimum(picked[:-width], picked[width:])
        width *= 2
    if width < span:
        picked = np.minimum(picked[: width - span], picked[span - width :])
    place = (picked & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return first, np.diff(np.concatenate([first, [len(place)]])), hashes[place[first]]


def pieces(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Overlapping pieces of a text: every window lies whole in exactly one."""
    at = 0
    while len(raw) - at >= LENGTH:
        yield at, raw[at : at + PIECE + LENGTH - 1]
        at += PIECE


def all_grams(texts: list) -> Iterator[np.ndarray]:
    """The hashes of all grams of texts that hold a window, and some across their borders."""
    joined = b"".join([r for r in ((t or "").encode("utf-8", "surrogatepass") for t in texts) if len(r) >= LENGTH])
    for at in range(0, max(0, len(joined) - GRAM + 1), PIECE):
        yield gram_hashes(np.frombuffer(joined[at : at + PIECE + GRAM - 1], np.uint8))


def runs_of_texts(raw: list[bytes], ranks: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text with a window: its number, the place of the piece, and the piece's runs.

    Short texts are joined and worked on together; windows across their borders are dropped.
    """
    group: list[int] = []
    size = 0

    def together() -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        joined = np.frombuffer(b"".join(raw[i] for i in group), np.uint8)
        first, count, key = runs_of_windows(joined, ranks)
        stop = first + count
        at = 0
        for i in group:
            end = at + len(raw[i])
            a, b = np.searchsorted(stop, at, "right"), np.searchsorted(first, end - LENGTH, "right")
            f, s = np.maximum(first[a:b], at), np.minimum(stop[a:b], end - LENGTH + 1)
            yield i, 0, f - at, s - f, key[a:b]
            at = end

    for i, r in enumerate(raw):
        if len(r) < LENGTH:
            continue
        if len(r) > PIECE // 2:
            for at, piece in pieces(r):
                yield i, at, *runs_of_windows(np.frombuffer(piece, np.uint8), ranks)
            continue
        if size + len(r) > PIECE:
            yield from together()
            group, size = [], 0
        group.append(i)
        size += len(r)
    if group:
        yield from together()


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key & np.uint64(0xFFFFFF)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def short_key(key: np.ndarray) -> np.ndarray:
    """40 bits besides those that choose the bucket."""
    return key >> np.uint64(24)


def _pack(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _open(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _pack_owned(keys: np.ndarray, owner: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> bytes:
    """Keys in the order of their owners, with each owner's document id and row key (two numbers) once."""
    own, count = np.unique(owner, return_counts=True)
    head = _squeeze(np.concatenate([ids[own], *rows[own].T, count]).astype("<i8").tobytes())
    return np.array([len(head)], "<i8").tobytes() + head + _pack(keys)


def _unpack_owned(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, each key's owner by number, and the owners' ids and row keys."""
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    ids, a, b, count = np.frombuffer(_open(raw[8 : 8 + n]), "<i8").reshape(4, -1)
    return _unpack(raw[8 + n :]), np.repeat(np.arange(len(ids)), count), ids, np.stack([a, b], axis=1)


def _several(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries' keys more than one id has, and which entry is the first of its key with the smallest id."""
    order = np.lexsort((ids, key))
    k, d = key[order], ids[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(k)]]) - 1
    many = (d[last] != d[first])[np.cumsum(new) - 1]
    shared, lead = np.empty(len(k), bool), np.zeros(len(k), bool)
    shared[order] = many
    lead[order[first]] = True
    return shared, lead


def _cuts(*columns: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of rows with equal values begin and end."""
    n = len(columns[0])
    if not n:
        return [], []
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new).tolist()
    return first, [*first[1:], n]


class Mail:
    """Pieces of bytes for documents, packed by a few parts of the documents, so that each task sends few rows."""

    def __init__(self, parts: int, limit: int = 12_000_000):
        self.parts, self.limit, self.held = parts, limit, 0
        self.rows: list[np.ndarray] = []
        self.pieces: list[bytes] = []

    def add(self, rows: np.ndarray, pieces: list[bytes]) -> None:
        """rows: the keys of the rows that the pieces are for, two numbers each."""
        self.rows.append(np.asarray(rows, np.int64).reshape(-1, 2))
        self.pieces += pieces
        self.held += sum(map(len, pieces)) + 60 * len(pieces)

    def batches(self, force: bool = False) -> Iterator[pa.RecordBatch]:
        if not self.rows or (self.held < self.limit and not force):
            return
        rows = np.concatenate(self.rows)
        for part, which in _groups(rows[:, 0] % self.parts):
            own = [self.pieces[i] for i in which.tolist()]
            raw = rows[which].T.astype("<i8").tobytes() + np.array([len(x) for x in own], "<i4").tobytes() + b"".join(own)
            blob = np.array([len(own)], "<i8").tobytes() + _squeeze(raw)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])
        self.rows, self.pieces, self.held = [], [], 0


def read_mail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part: a row (a, b, found) with all pieces for each row key."""
    for _, blobs in _by_bucket(batches):
        found: dict[tuple[int, int], list[bytes]] = {}
        for (blob,) in blobs:
            n, raw = int(np.frombuffer(blob[:8], "<i8")[0]), _open(blob[8:])
            sizes = np.frombuffer(raw[16 * n : 20 * n], "<i4")
            ends = (20 * n + np.cumsum(sizes)).tolist()
            for a, b, size, end in zip(*np.frombuffer(raw[: 16 * n], "<i8").reshape(2, -1).tolist(), sizes.tolist(), ends, strict=True):
                found.setdefault((a, b), []).append(raw[end - size : end])
        rows = list(found)
        for at in range(0, len(rows), 5_000):
            part = rows[at : at + 5_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([found[r] for r in part], pa.list_(pa.binary()))], names=["a", "b", "found"])


def _flags(owner: np.ndarray, bucket: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each owner and bucket its shared keys, behind the number of the bucket; and the owners, by number."""
    order = np.lexsort((bucket, owner))
    owner, bucket, key = owner[order], bucket[order], key[order]
    first, end = _cuts(owner, bucket)
    raw, heads = _pack(key), bucket[first].astype("<i4").tobytes()
    return owner[first], [heads[4 * n : 4 * n + 4] + raw[a * KEY_BYTES : b * KEY_BYTES] for n, (a, b) in enumerate(zip(first, end, strict=True))]


def send_grams(buckets: int, parts: int, ranks, names: tuple[str, ...]):
    """names: the columns that hold id, text, both parts of the row key, and whether the row's text is an earlier row's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        ids: list[int] = []
        rows: list[tuple[int, int]] = []
        held = 0

        def send() -> Iterator[pa.RecordBatch]:
            key, owner, id_of, row_of = np.concatenate(keys), np.concatenate(owners), np.array(ids, np.int64), np.array(rows, np.int64).reshape(-1, 2)
            bucket, key = bucket_of(key, buckets) // GRAM_BUCKETS, short_key(key)
            shared, lead = _several(key | (bucket.astype(np.uint64) << np.uint64(40)), id_of[owner])
            if shared.any():
                mail = Mail(parts)
                whom, what = _flags(owner[shared], bucket[shared], key[shared])
                mail.add(row_of[whom], what)
                for batch in mail.batches(force=True):
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - batch.column(0)[0].as_py()], pa.int32()), batch.column(1)], names=["bucket", "blob"])
            keep = ~shared | lead
            key, owner, bucket = key[keep], owner[keep], bucket[keep]
            order = np.lexsort((owner, bucket))
            key, owner, bucket = key[order], owner[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
            for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
                blob = _pack_owned(key[a:b], owner[a:b], id_of, row_of)
                yield pa.RecordBatch.from_arrays([pa.array([bucket[a]], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            batch_ids, texts, first_keys, second_keys, copied = (batch.column(c).to_pylist() for c in names)
            raw = [b"" if c or t is None else t.encode("utf-8", "surrogatepass") for t, c in zip(texts, copied, strict=True)]
            last = -1
            for i, _, _, _, key in runs_of_texts(raw, ranks.value):
                if i != last:
                    ids.append(batch_ids[i])
                    rows.append((first_keys[i], second_keys[i]))
                    last = i
                keys.append(key)
                owners.append(np.full(len(key), len(ids) - 1))
                held += len(key)
                if held > HELD:
                    yield from send()
                    keys, owners, ids, rows, held, last = [], [], [], [], 0, -1
        if held:
            yield from send()

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Rows of one bucket after the other; rows come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for bucket, *row in zip(*columns, strict=True):
            if bucket != now:
                if held:
                    yield now, held
                now, held = bucket, []
            held.append(row)
    if held:
        yield now, held


def find_shared(parts: int):
    """Buckets of grams to mail about those that several documents have; mail (under negative numbers) passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mail = Mail(parts)
        for bucket, rows in _by_bucket(batches):
            if bucket < 0:
                for (blob,) in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - bucket], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])
                continue
            got = [_unpack_owned(blob) for (blob,) in rows]
            before = np.concatenate([[0], np.cumsum([len(g[2]) for g in got])])
            key, owner = np.concatenate([g[0] for g in got]), np.concatenate([g[1] + b for g, b in zip(got, before, strict=False)])
            ids, row = np.concatenate([g[2] for g in got]), np.concatenate([g[3] for g in got])
            shared, _ = _several(key, ids[owner])
            if shared.any():
                whom, what = _flags(owner[shared], np.full(int(shared.sum()), bucket), key[shared])
                mail.add(row[whom], what)
            yield from mail.batches()
        yield from mail.batches(force=True)

    return run


SEGMENT = np.dtype([("id", "<i8"), ("size", "<u2")])
#: A place names its segment by the number that the segment has in the sending task's list for the bucket.
PLACE = np.dtype([("segment", "<u4"), ("row", "<u4"), ("at", "<u4"), ("count", "u1")])


def _columns(table: np.ndarray) -> bytes:
    """A structured array column by column, which compresses better."""
    return b"".join(np.ascontiguousarray(table[f]).tobytes() for f in table.dtype.names)


def _table(raw: bytes, kind: np.dtype, n: int) -> tuple[np.ndarray, int]:
    out, at = np.zeros(n, kind), 0
    for f in kind.names:
        size = n * kind[f].itemsize
        out[f] = np.frombuffer(raw[at : at + size], kind[f])
        at += size
    return out, at


class Segments:
    """Distinct segments of a task and the places that have them, until they are sent."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.bodies: list[bytes] = []
        self.buckets: list[int] = []
        self.least: list[int] = []
        self.places: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        self.owners: list[tuple[int, int, int]] = []
        self.held = 0

    def add(self, raw: bytes, row: tuple[int, int], doc: int, at: np.ndarray, count: np.ndarray, bucket: np.ndarray) -> None:
        index, found = self.index, []
        for a, e, b in zip(at.tolist(), (at + count + (LENGTH - 1)).tolist(), bucket.tolist(), strict=True):
            body = raw[a:e]
            n = index.get(body)
            if n is None:
                n = index[body] = len(self.bodies)
                self.bodies.append(body)
                self.buckets.append(b)
                self.least.append(doc)
                self.held += e - a + 250
            elif doc < self.least[n]:
                self.least[n] = doc
            found.append(n)
        self.places.append((np.array(found, np.int64), at, count, len(self.owners)))
        self.owners.append((*row, doc))
        self.held += 24 * len(found)

    def batches(self) -> Iterator[pa.RecordBatch]:
        send = uuid.uuid4().bytes
        buckets, least = np.array(self.buckets, np.int64), np.array(self.least, np.int64)
        sizes = np.array([len(b) for b in self.bodies], np.int64)
        number = np.zeros(len(self.bodies), np.int64)
        for bucket, which in _groups(buckets):
            number[which] = np.arange(len(which))
            head = np.zeros(len(which), SEGMENT)
            head["id"], head["size"] = least[which], sizes[which]
            body = b"".join([self.bodies[i] for i in which.tolist()])
            yield _part(bucket, 0, send, len(head), _columns(head) + body)
        who = np.array(self.owners, np.int64).reshape(-1, 3)
        segment = np.concatenate([p[0] for p in self.places])
        rows = np.zeros(len(segment), PLACE)
        rows["segment"], rows["at"], rows["count"] = number[segment], np.concatenate([p[1] for p in self.places]), np.concatenate([p[2] for p in self.places])
        owner = np.repeat([p[3] for p in self.places], [len(p[0]) for p in self.places])
        for bucket, which in _groups(buckets[segment]):
            own, back = np.unique(owner[which], return_inverse=True)
            part = rows[which]
            part["row"] = back
            part["at"] = np.diff(part["at"], prepend=np.uint32(0))  # steps, modulo 2^32: a periodic text has equal ones
            yield _part(bucket, 1, send, len(part), _columns(part) + who[own].T.astype("<i8").tobytes())


def _groups(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct value and where it is, in order."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    cut = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(ranked)], strict=True):
        yield int(ranked[a]), order[a:b]


def _part(bucket: int, kind: int, send: bytes, n: int, raw: bytes) -> pa.RecordBatch:
    blob = send + np.array([n], "<i8").tobytes() + _squeeze(raw)
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int8()), pa.array([blob], pa.binary())], names=["bucket", "kind", "blob"])


def cut_segments(buckets: int, ranks, names: tuple[str, ...]):
    """names: the columns that hold id, text, both parts of the row key, and flags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Segments()
        for batch in batches:
            ids, texts, first_keys, second_keys, flags = (batch.column(c).to_pylist() for c in names)
            on = [i for i, f in enumerate(flags) if f]
            raw = [(texts[i] or "").encode("utf-8", "surrogatepass") for i in on]
            wanted = [np.concatenate([_unpack(f[4:]) | (np.uint64(int.from_bytes(f[:4], "little")) << np.uint64(40)) for f in flags[i]]) for i in on]
            for n, at, first, count, key in runs_of_texts(raw, ranks.value):
                bucket = bucket_of(key, buckets)
                hit = np.isin(short_key(key) | ((bucket // GRAM_BUCKETS).astype(np.uint64) << np.uint64(40)), wanted[n])
                if hit.any():
                    held.add(raw[n], (first_keys[on[n]], second_keys[on[n]]), ids[on[n]], first[hit] + at, count[hit], bucket[hit])
                if held.held > 25_000_000:
                    yield from held.batches()
                    held = Segments()
        if held.places:
            yield from held.batches()

    return run


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number that sorts like them; zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(text)
    two = (padded[:-1] << np.uint64(8)) | padded[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return ((four[:-4] << np.uint64(32)) | four[4:])[:n]


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int = LENGTH + 6, words: np.ndarray | None = None) -> np.ndarray:
    """The places marked in ``wanted``, ordered by the ``depth`` bytes (a multiple of 8) from each on, at least.

    Stage one sorts the suffixes that begin with a byte not larger than the next. Stage two scans the first bytes in
    order: a suffix that begins with a larger byte than its successor comes in its successor's order, before all
    directly sorted suffixes of the same first byte.
    """
    n = len(text)
    words = eight_bytes(text) if words is None else words
    after = np.concatenate([text[1:], np.zeros(1, np.uint8)]) if n else text
    induced = text > after
    need = wanted.copy()
    edge = need & induced
    while edge.any():  # bytes fall strictly along a chain, so at most 255 rounds
        edge = np.concatenate([[False], edge[:-1]]) & ~need
        need |= edge
        edge &= induced
    direct = np.flatnonzero(need & ~induced)
    padded = np.concatenate([words, np.zeros(depth, np.uint64)])
    direct = direct[np.lexsort([padded[direct + 8 * k] for k in range(depth // 8 - 1, -1, -1)])]
    border = np.searchsorted(text[direct], np.arange(257))
    last = np.flatnonzero((need & induced)[-1:]) + n - 1  # the text's last byte has no successor: it is its own seed
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    if len(last):
        pending[text[n - 1]].append(last)
    out = []
    for c in range(256):
        bucket = np.concatenate([*pending[c], direct[border[c] : border[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[need[before] & (text[before] > c)]
        if len(before):
            chars = text[before]
            order = np.argsort(chars, kind="stable")
            before, chars = before[order], chars[order]
            cut = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
            for a, b in zip(cut, [*cut[1:], len(before)], strict=True):
                pending[chars[a]].append(before[a:b])
    order = np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(words: np.ndarray, order: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """For each place in suffix order but the first, the bytes shared with the place before, up to ``limit``."""
    padded = np.concatenate([words, np.zeros(limit + 8, np.uint64)])
    out = np.zeros(max(0, len(order) - 1), np.int64)
    going = np.arange(len(out))
    for at in range(0, limit, 8):
        differ = padded[order[going] + at] ^ padded[order[going + 1] + at]
        same = differ == 0
        rest = going[~same]
        d = differ[~same]
        bits = np.floor(np.log2((d >> np.uint64(11)).astype(np.float64), where=(d >> np.uint64(11)) > 0, out=np.full(len(d), -1.0))) + 11
        bits = np.where(bits < 11, np.floor(np.log2(np.maximum(d & np.uint64(0x7FF), 1).astype(np.float64))), bits)
        out[rest] = at + (63 - bits.astype(np.int64)) // 8
        going = going[same]
    out[going] = limit
    return np.minimum(out, limit)


def smallest_ids(bodies: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each segment the smallest id that has the same bytes; and each segment's first window."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    counts = sizes - LENGTH + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    text = np.frombuffer(b"".join(bodies), np.uint8)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.repeat(start - first[:-1], counts) + np.arange(first[-1])
    wanted = np.zeros(len(text), bool)
    wanted[place] = True
    words = eight_bytes(text)
    order = suffix_order(text, wanted, words=words)
    number = np.zeros(len(text), np.int64)
    number[place] = np.arange(len(place))
    of = number[order]
    owner = np.repeat(ids, counts)[of]
    new = np.flatnonzero(np.concatenate([[True], common_prefixes(words, order) < LENGTH]))
    least = np.minimum.reduceat(owner, new)
    out = np.empty(len(place), np.int64)
    out[of] = np.repeat(least, np.diff(np.concatenate([new, [len(of)]])))
    return out, first


def _join_segments(blobs: list[bytes]) -> tuple[list[bytes], np.ndarray, dict[bytes, np.ndarray]]:
    """Distinct segments by their bytes, their smallest ids, and for each sender the numbers of the segments it sent."""
    index: dict[bytes, int] = {}
    least: list[int] = []
    sent: dict[bytes, np.ndarray] = {}
    for blob in blobs:
        n, raw = int(np.frombuffer(blob[16:24], "<i8")[0]), _open(blob[24:])
        head, at = _table(raw, SEGMENT, n)
        numbers = []
        for doc, size in zip(head["id"].tolist(), head["size"].tolist(), strict=True):
            body = raw[at : at + size]
            at += size
            k = index.setdefault(body, len(least))
            if k == len(least):
                least.append(doc)
            elif doc < least[k]:
                least[k] = doc
            numbers.append(k)
        sent[blob[:16]] = np.array(numbers, np.int64)
    return list(index), np.array(least, np.int64), sent


def _covered(blob: bytes, sent: dict[bytes, np.ndarray], least: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Ranges of windows, by document, that an earlier document has."""
    raw = _open(blob[24:])
    places, at = _table(raw, PLACE, int(np.frombuffer(blob[16:24], "<i8")[0]))
    places["at"] = np.cumsum(places["at"], dtype=np.uint32)
    who = np.frombuffer(raw[at:], "<i8").reshape(3, -1)
    segment = sent[blob[:16]][places["segment"]]
    count = places["count"].astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(count)])
    window = np.repeat(first[segment] - begin[:-1], count) + np.arange(begin[-1])
    owner = np.repeat(places["row"], count).astype(np.int64)
    gone = least[window] < who[2, owner]
    at = (np.repeat(places["at"].astype(np.int64) - begin[:-1], count) + np.arange(begin[-1]))[gone]
    owner = owner[gone]
    rank = np.lexsort((at, owner))
    at, owner = at[rank], owner[rank]
    if not len(at):
        return np.zeros((0, 2), np.int64), []
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)]))
    stop = np.concatenate([new[1:], [len(at)]]) - 1
    ranges = np.stack([at[new], at[stop] + LENGTH], axis=1).astype("<u4")
    cut, ends = _cuts(owner[new])
    return who[:2, owner[new][cut]].T, [ranges[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]


def find_covered(parts: int):
    """Rows come sorted by bucket and kind: all segments of a bucket, then its places, which are only streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready, blobs, mail = None, None, [], Mail(parts)
        for batch in batches:
            for bucket, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    now, ready, blobs = bucket, None, []
                if kind == 0:
                    blobs.append(blob)
                    continue
                if ready is None:
                    bodies, ids, sent = _join_segments(blobs)
                    ready, blobs = (sent, *smallest_ids(bodies, ids)), []
                    del bodies
                mail.add(*_covered(blob, *ready))
                yield from mail.batches()
        yield from mail.batches(force=True)

    return run


def keep_bytes(raw: bytes, ranges: list[bytes] | None, copied: bool | None = None) -> tuple[bytes, int, int]:
    """What is left, the number of bytes removed, and the number of removed runs."""
    if copied:
        return b"", len(raw), 1
    if not ranges:
        return raw, 0, 0
    pairs = np.frombuffer(b"".join(ranges), "<u4").reshape(-1, 2).astype(np.int64)
    step = np.zeros(len(raw) + 1, np.int64)
    np.add.at(step, pairs[:, 0], 1)
    np.add.at(step, pairs[:, 1], -1)
    gone = np.cumsum(step[:-1]) > 0
    runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def later_copies(rows: DataFrame) -> DataFrame:
    """Of rows (id, body, a, b), the keys (a, b) of those whose whole text a row with a smaller id has.

    Only hashes travel. The smallest id of each repeated text is sent to ``SALTS`` places, so that the rows of a text
    that very many have are dealt over as many tasks.
    """
    long = rows.where(F.octet_length("body") >= LENGTH)
    known = long.select("id", "a", "b", F.xxhash64("body").alias("x"), F.xxhash64(F.lit(1), "body").alias("y"), F.octet_length("body").alias("n"))
    first = known.groupBy("x", "y", "n").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = known.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["x", "y", "n", "salt"])
    return met.where("id > first").select("a", "b").distinct()


def covered_ranges(df: DataFrame, doc_id: str, text: str, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, str, str]:
    """The rows with two columns more: their covered ranges, array<binary>, and whether they are covered whole; and these columns' names."""
    size = sketch.text_bytes(df, text)
    buckets = parts = min(1 << 24, max(16, -(-size // bucket_bytes)))
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(sketch.frequency_ranks(df, text, all_grams, sketch.bits_for(size, SKETCH_BYTES))[0])  # 16 MB at most
    id_name, key_a, key_b, mail_a, mail_b, ranges, flags, copied = private(df, "id", "a", "b", "c", "d", "ranges", "flags", "copied")
    known, body = F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit(""))
    number = F.coalesce(known, F.lit(NO_ID))
    own = df.withColumns({key_a: F.xxhash64(known, body), key_b: F.coalesce(known, F.xxhash64(F.lit(1), body))})
    copies = later_copies(own.select(number.alias("id"), body.alias("body"), F.col(key_a).alias("a"), F.col(key_b).alias("b")))

    def mailed(rows: DataFrame, name: str) -> DataFrame:
        read = map_arrow(rows.repartition("part").sortWithinPartitions("part"), read_mail, "a long, b long, found array<binary>")
        return read.withColumnRenamed("found", name)

    def with_found(rows: DataFrame, found: DataFrame) -> DataFrame:
        # left joins of whole rows only, by one key, so that one shuffle of the texts serves all of them
        met = (F.col(key_a) == F.col(mail_a)) & (F.col(key_b) == F.col(mail_b))
        return rows.join(found.withColumnsRenamed({"a": mail_a, "b": mail_b}).hint("shuffle_hash"), met, "left").drop(mail_a, mail_b)

    told = with_found(own, copies.withColumn(copied, F.lit(True))).withColumn(id_name, number)
    grams = map_arrow(told, send_grams(buckets, parts, ranks, (id_name, text, key_a, key_b, copied)), "bucket int, blob binary")
    shared = map_arrow(grams.repartition("bucket").sortWithinPartitions("bucket"), find_shared(parts), "part int, blob binary")
    flagged = with_found(own, mailed(shared, flags)).withColumn(id_name, number)
    segments = map_arrow(flagged, cut_segments(buckets, ranks, (id_name, text, key_a, key_b, flags)), "bucket int, kind byte, blob binary")
    covered = map_arrow(segments.repartition("bucket").sortWithinPartitions("bucket", "kind"), find_covered(parts), "part int, blob binary")
    done = with_found(with_found(own, copies.withColumn(copied, F.lit(True))), mailed(covered, ranges))
    return done.drop(key_a, key_b), ranges, copied


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    joined, *names = covered_ranges(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", **sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, found, copied in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                kept, removed, spans = keep_bytes(raw, found, copied)
                out.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(joined.select("doc_id", "text", *names), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None, **sizes) -> DataFrame:
    """The rows with repeated passages cut from their texts; null texts stay null, split characters are dropped.

    ``n_chars`` names a column to set to the new length. All other columns and their order stay.
    """
    joined, *names = covered_ranges(df, doc_id, text, **sizes)
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = {c: batch.column(c) for c in columns}
            found = zip(kept[text].to_pylist(), *(batch.column(c).to_pylist() for c in names), strict=True)
            texts = [keep_bytes(t.encode("utf-8", "surrogatepass"), r, c)[0].decode("utf-8", "ignore") if (r or c) and t else t for t, r, c in found]
            kept[text] = pa.array(texts, pa.string())
            if n_chars is not None:
                kept[n_chars] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(kept[n_chars].type)
            yield pa.RecordBatch.from_arrays([kept[c] for c in columns], names=columns)

    return map_arrow(joined.select(*columns, *names), run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields))
