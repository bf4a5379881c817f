"""Media payloads in tar shards, addressed by content; rows carry digest, shard, offset and length.

A payload is stored losslessly as a grey 8-bit PNG image of 64 columns. Each task appends what it stores to tar files of
its own in the folder that all executors share, once for each digest it meets; a digest's smallest location is the one
that all rows use. A task that runs again writes new files under new names, so that no row ever points to a file that
a lost attempt left unfinished. Metadata comes from the first 33 bytes of a payload, read by range.

Defined results: null texts are empty and store 64 zero bytes; equal payloads have equal digests and one location in
the result; a repeated row is a row of its own; an empty table stores nothing.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, saved, workspace

WIDTH = 64
#: Bytes after which a task begins another tar file.
SHARD_BYTES = 64 << 20
#: Digests whose location a task remembers.
KNOWN = 500_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of signature and header chunk: all that metadata needs.
HEADER_BYTES = 33
#: Bytes of a tar file that one task reads.
READ_BYTES = 16 << 20
#: Digests of more rows than this are joined by broadcast; where there would be more than HOT_DIGESTS of them, the limit
#: rises with the number of rows, so that no more than HOT_DIGESTS (some 300 bytes each) can pass it.
HOT_ROWS, HOT_DIGESTS = 1_000, 50_000
# Names of file systems that Spark's readers use, and what Arrow calls the same.
ALIASES = {"s3a://": "s3://", "s3n://": "s3://", "dbfs:/": "file:///dbfs/"}


def pad(raw: bytes, unit: int = WIDTH) -> bytes:
    """Zero bytes up to a positive multiple of the unit."""
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image whose samples are the payload's bytes, row by row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 1)) + _chunk(b"IEND", b"")


def read_header(raw: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first bytes."""
    if len(raw) < HEADER_BYTES or raw[:8] != SIGNATURE or raw[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", raw[16:25])
    return width, height, bits


def from_png(raw: bytes) -> bytes:
    """The samples of an image that ``to_png`` made."""
    width, height, bits = read_header(raw)
    if bits != 8 or raw[25] != 0:
        raise ValueError("not an 8-bit grey image")
    at, data = HEADER_BYTES, []
    while at < len(raw):
        (n,) = struct.unpack(">I", raw[at : at + 4])
        if raw[at + 4 : at + 8] == b"IDAT":
            data.append(raw[at + 8 : at + 8 + n])
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered row")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, sum and sum of squares of the samples, and how many values occur."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    values = np.arange(256)
    return f"rows={len(payload) // WIDTH};sum={int(counts @ values)};squares={int(counts @ values**2)};values={int((counts > 0).sum())}"


class TarShards:
    """Appends payloads to tar files in a folder of any file system that Arrow opens."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(_uri(folder))
        self.files.create_dir(self.root, recursive=True)
        self.out, self.name, self.at = None, "", 0

    def add(self, digest: str, body: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.files.open_output_stream(f"{self.root}/{self.name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(body)
        head = info.tobuf(tarfile.GNU_FORMAT)
        self.out.write(head + body + b"\0" * (-len(body) % tarfile.BLOCKSIZE))
        place = (self.name, self.at + len(head), len(body))
        self.at += len(head) + len(body) + (-len(body) % tarfile.BLOCKSIZE)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None


class RangeReader:
    """Reads ranges of tar files, one open file at a time."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.files.open_input_file(f"{self.root}/{name}")
        return self.file.read_at(length, offset)


def _uri(folder: str) -> str:
    """The folder's address as Arrow writes it."""
    for spark_name, arrow_name in ALIASES.items():
        if folder.startswith(spark_name):
            folder = arrow_name + folder[len(spark_name) :]
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def store(df: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length of each row's payload; the payloads go to the folder."""
    folder = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, known = TarShards(folder), {}
        try:
            for batch in batches:
                out = []
                for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    body = to_png(pad(raw))
                    digest = hashlib.sha256(body).hexdigest()
                    if digest not in known:
                        if len(known) > KNOWN:
                            known.clear()
                        known[digest] = shards.add(digest, body)
                    out.append((doc, len(raw), digest, *known[digest]))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            shards.close()

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # written at once, so that a payload is stored by one successful task only
    return saved(map_arrow(rows, run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long"), "media-rows")


def payloads(rows: DataFrame) -> DataFrame:
    """digest, shard, offset, length: one location for each digest, dealt so that a task reads neighbours in order."""
    least = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    return least.repartition(F.col("shard"), F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("shard", "offset")


def metadata(places: DataFrame, folder: str) -> DataFrame:
    """Add width, height, bits and media_type, read from the payloads' headers alone."""
    folder = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(folder)
        for batch in batches:
            got = [read_header(reader.read(s, o, min(n, HEADER_BYTES))) for s, o, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True)]
            new = [pa.array([g[i] for g in got], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new, pa.array(["image/png"] * len(got), pa.string())], names=[*batch.schema.names, "width", "height", "bits", "media_type"])

    return map_arrow(places, run, "digest string, shard string, offset long, length long, width int, height int, bits int, media_type string")


def features(places: DataFrame, folder: str) -> DataFrame:
    """digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: from the bytes read back."""
    folder = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(folder)
        for batch in batches:
            out = []
            for digest, s, o, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                body = reader.read(s, o, n)
                payload = from_png(body)
                out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(body), hashlib.sha256(body).hexdigest(), feature(payload)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_arrow(places, run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _join_by_digest(rows: DataFrame, about: DataFrame) -> DataFrame:
    """Rows with what is known about their payload; payloads that very many rows share come to the rows instead."""
    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    least = max(HOT_ROWS, rows.count() // HOT_DIGESTS)
    often = saved(counts.where(F.col("n") > least).select("digest"), "often")
    if often.isEmpty():
        return rows.join(about, "digest")
    hot, few = F.broadcast(often), F.broadcast(about.join(F.broadcast(often), "digest", "left_semi"))
    return rows.join(hot, "digest", "left_anti").join(about, "digest").unionByName(rows.join(hot, "digest", "left_semi").join(few, "digest"))


def stored_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Store every text, read all payloads back, and return their measures and places for each row."""
    folder = folder or workspace(df.sparkSession, "media")
    rows = store(df, folder, doc_id, text)
    places = payloads(rows)
    known = metadata(places, folder)
    measured = features(known.select("digest", "shard", "offset", "length"), folder)
    # both come from the same places; joined by digest they are one small row for each payload
    about = measured.join(known, "digest")
    joined = _join_by_digest(rows.select("doc_id", "n_bytes", "digest"), about)
    return joined.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length", "width", "height")
