"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file gives the vocabulary; the merge list is derived from the ranks once on the driver and the finished
tokenizer (a few MB, fixed by the vocabulary file) is broadcast as JSON. A byte is shown to the library as one
printable character (the byte-to-character table); decoding maps the characters of a token back to bytes, by one lookup
for all tokens of a chunk, and those bytes give each token's character range, split characters included.

Texts are cut into the pre-tokenizer's pieces, and the library encodes each piece once for as long as a worker keeps it:
given whole texts it takes half as long again.

Defined results: null and empty texts have no tokens; special tokens' strings are ordinary text; texts of any
length are encoded whole; rows are independent, so ties, copies and extra columns change nothing.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, map_arrow, private, worker_cache

#: Characters given to the library at once; bounds a worker's memory.
CHUNK_CHARS = 1_000_000
#: The owner of what workers keep between tasks.
KEEPS = "bpe"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte.

    Printable Latin-1 bytes stand for themselves; the others, in order, for the characters from U+0100 on.
    """
    own = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
    rest = iter(range(256, 512))
    own_set = set(own)
    return [chr(b) if b in own_set else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _last_merge(token: bytes, ranks: dict[bytes, int], below: int) -> tuple[bytes, bytes] | None:
    """The two parts that the ranks lower than the token's own leave of it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], below))
        if ranks.get(parts[best] + parts[best + 1], below) >= below:
            return None
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """A byte-level BPE tokenizer in the library's JSON form, for a vocabulary given by ranks."""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    chars = byte_chars()
    shown = {token: "".join(chars[b] for b in token) for token in ranks}
    pairs = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1 and (pair := _last_merge(token, ranks, rank)):
            pairs.append((shown[pair[0]], shown[pair[1]]))
    made = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=pairs, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    made.decoder = decoders.ByteLevel()
    return made.to_str()


def token_bytes(vocab: dict[str, int]) -> list[bytes]:
    """The bytes of each id: the byte table reversed."""
    back = {c: b for b, c in enumerate(byte_chars())}
    table = [b""] * (max(vocab.values(), default=-1) + 1)
    for shown, i in vocab.items():
        table[i] = bytes(back[c] for c in shown)
    return table


def decode_bytes(ids, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def decode_all(ids: np.ndarray, table: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many tokens in one array, and where each token's begin (one more than tokens)."""
    taken = table.take(pa.array(ids, pa.int32()))
    ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1]
    return np.frombuffer(taken.buffers()[2] or b"", np.uint8), ends


def character_ranges(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(tokens, 2): the characters, counted over all of the bytes, that each token has a part of, half-open.

    Tokens that share a split character have it both in their ranges.
    """
    begun = np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)
    if not len(begun):
        return np.zeros((0, 2), np.int64)
    return np.stack([begun[ends[:-1]] - 1, begun[ends[1:] - 1]], axis=1)


def decode_pieces(ids, table: list[bytes]) -> list[str]:
    """The text that each token completes.

    A character split over tokens appears with the token that brings its last byte; bytes that can be no
    character become U+FFFD. The pieces joined are the whole text.
    """
    import codecs

    reader = codecs.getincrementaldecoder("utf-8")(errors="replace")
    out = [reader.decode(table[i]) for i in ids]
    tail = reader.decode(b"", True)
    if out:
        out[-1] += tail
    return out


def _load(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    cache = worker_cache()
    key = (KEEPS, hash(text))
    if key not in cache:
        made = Pieces(text)
        cache[key] = (pa.array(token_bytes(made.whole.get_vocab()), pa.binary()), made)
    return cache[key]


#: Characters beyond Cyrillic, and those that are white space in one regex library alone: such texts are not cut here.
UNUSUAL = r"[^\x00-\x1b\x20-\x84\x86-\u052f]"
#: The pieces that a byte-level pre-tokenizer cuts a text into, as the public vocabulary files give it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker keeps; beyond this many it starts anew.
KEPT_PIECES = 250_000


class Pieces:
    """Encodes texts by their pieces: the library encodes each piece that is not known yet, once."""

    def __init__(self, text: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_str(text)
        self.single = Tokenizer(self.whole.model)  # one model in memory for both
        self.single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.unusual, self.cut = regex.compile(UNUSUAL).search, regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        odd = [i for i, t in enumerate(texts) if self.unusual(t)]
        for i, e in zip(odd, self.whole.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        cut = [(i, self.cut(t)) for i, t in enumerate(texts) if out[i] is None]
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        new = list({p for _, pieces in cut for p in pieces if p not in self.known})
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            for p, e in zip(part, self.single.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[p] = np.array(e.ids, "<u4").tobytes()
        for i, pieces in cut:
            out[i] = b"".join(map(self.known.__getitem__, pieces))
        return out


def broadcast_tokenizer(spark: SparkSession, path: str):
    """The tokenizer of a rank file, broadcast; a session builds it once for each file."""
    cache = worker_cache()
    key = ("bpe-json", path, os.path.getmtime(path))
    if key not in cache:
        cache[key] = tokenizer_json(read_ranks(path))
    return spark.sparkContext.broadcast(cache[key])


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """Add token ids, and on request each token's character range, to the rows.

    ids: array<int>; offsets: array<struct<start:int,end:int>>, half-open, in characters. Tokens that share a split
    character have the same range. Columns of those names are replaced.
    """
    shared = broadcast_tokenizer(df.sparkSession, vocabulary)
    new = {ids, offsets} - {None}
    (own,) = private(df, "text")
    base = df.select(*[c for c in df.columns if c not in new], F.col(text).alias(own))
    fields = [f for f in base.schema.fields if f.name != own]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + (", " if fields else "") + f"`{ids}` array<int>" + (f", `{offsets}` array<struct<start:int,end:int>>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, pieces = _load(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            got, spans = [], []
            for first, last in by_bytes(texts, CHUNK_CHARS):
                for made, found in encoded(texts[first:last], pieces, table):
                    got.append(made.astype(np.int32))
                    if offsets:
                        spans.append([{"start": a, "end": b} for a, b in found.tolist()])
            cols = [*keep, pa.array(got, pa.list_(pa.int32()))]
            if offsets:
                cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], ids, *([offsets] if offsets else [])])

    return map_arrow(base, run, schema, KEEPS)


def encoded(texts: list[str], pieces: Pieces, table: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its ids and, read from the bytes that these decode to, the tokens' character ranges."""
    made = [np.frombuffer(x, "<u4") for x in pieces.encode(texts)]
    data, ends = decode_all(np.concatenate([*made, np.zeros(0, "<u4")]), table)
    ranges = character_ranges(data, ends)
    at = 0
    for ids in made:
        own = ranges[at : at + len(ids)]
        yield ids, own - own[0, 0] if len(own) else own
        at += len(ids)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded", pieces: str | None = None) -> DataFrame:
    """Add the text of an id array, and on request what each token completes of it (see ``decode_pieces``).

    Null ids give null, ids that the vocabulary lacks fail, bytes that are no UTF-8 give U+FFFD.
    """
    shared = broadcast_tokenizer(df.sparkSession, vocabulary)
    base = df.select(*[c for c in df.columns if c not in (text, ids, pieces)], ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + f", `{text}` string" + (f", `{pieces}` array<string>" if pieces else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _ = _load(shared.value)
        known = table.to_pylist() if pieces else None
        for batch in batches:
            rows = batch.column(batch.num_columns - 1).to_pylist()
            out = [None if r is None else decode_all(np.array(r, np.int32), table)[0].tobytes().decode("utf-8", "replace") for r in rows]
            cols = [*batch.columns, pa.array(out, pa.string())]
            if pieces:
                cols.append(pa.array([None if r is None else decode_pieces(r, known) for r in rows], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, text, *([pieces] if pieces else [])])

    return map_arrow(base, run, schema, KEEPS)


def digests(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass; returns digests instead of the arrays.

    key, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 (bytes made from the ids),
    offsets_crc32 (the tokens' character ranges as little-endian 32-bit pairs).
    """
    shared = broadcast_tokenizer(df.sparkSession, vocabulary)
    base = df.select(F.col(key), F.col(text).alias("text" if key != "text" else "body"))
    kind = base.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, pieces = _load(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = []
            for a, b in by_bytes(texts, CHUNK_CHARS):
                made = pieces.encode(texts[a:b])
                data, ends = decode_all(np.frombuffer(b"".join(made), "<u4"), table)
                ranges = character_ranges(data, ends)
                at = 0
                for ids in made:
                    n = len(ids) // 4
                    own = ranges[at : at + n]
                    where = (own - own[0, 0] if n else own).astype("<i4")
                    out.append((n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data[ends[at] : ends[at + n]].tobytes()).hexdigest(), zlib.crc32(where.tobytes())))
                    at += n
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]], names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "offsets_crc32"])

    return map_arrow(base, run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_crc32 long", KEEPS)
