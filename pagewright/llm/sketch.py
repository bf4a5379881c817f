"""How often hashes occur over all rows, in a table of a size that is fixed before.

Each task counts into an array of its own and sends it in compressed parts; parts are added up in two rounds, as a
stream, so that no task holds more than one part. What comes back is a byte for each counter: the logarithm of its count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_arrow

#: The table has no more than 16 million counters (16 MB as they come back).
LEAST_BITS, MOST_BITS = 16, 24
PART = 1 << 14
#: Groups of tasks whose parts are added up apart in the first round.
LANES = 4
CHUNK_CHARS = 400_000
NAMES = ["part", "lane", "counts"]
SCHEMA = "part int, lane int, counts binary"


def text_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(text).cast("long")).alias("n")).first().n or 0


def bits_for(size: int, bytes_each: int) -> int:
    """About one counter for so many bytes of text, as a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, round(log2(max(1, size / bytes_each)))))


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _row(part: int, lane: int, counts: np.ndarray) -> pa.RecordBatch:
    blob = zstandard.ZstdCompressor(level=1).compress(counts.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([lane], pa.int32()), pa.array([blob], pa.binary())], names=NAMES)


def _count(hashes: Callable[[list], Iterator[np.ndarray]], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, seen = np.zeros(1 << bits, np.int32), False
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in by_bytes(texts, CHUNK_CHARS):
                for found in hashes(texts[a:b]):
                    np.add.at(held, slots(found, bits), np.int32(1))
                    seen |= bool(len(found))
        lane = TaskContext.get().partitionId() % LANES
        for k in range(0, len(held) if seen else 0, PART):
            yield _row(k // PART, lane, held[k : k + PART])

    return run


def _add(wide: bool):
    """Rows come sorted by part and lane; counts are 32-bit numbers in the first round, 64-bit ones in the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0, np.int64)
        for batch in batches:
            for part, lane, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64 if wide else np.int32)
                if (part, lane) != now:
                    if now is not None:
                        yield _row(*now, total)
                    now, total = (part, lane), np.zeros(len(counts), np.int64)
                total = total + counts
        if now is not None:
            yield _row(*now, total)

    return run


def frequency_ranks(df: DataFrame, text: str, hashes: Callable[[list], Iterator[np.ndarray]], bits: int) -> tuple[np.ndarray, int]:
    """For each of ``1 << bits`` counters the logarithm of the occurrences of the hashes that begin with its bits; and all
    occurrences. ``hashes`` gives a list of texts' 64-bit hashes, in arrays."""
    order = ("part", "lane")
    rows = map_arrow(df.select(text), _count(hashes, bits), SCHEMA)
    lanes = map_arrow(rows.repartition(*order).sortWithinPartitions(*order), _add(False), SCHEMA)
    whole = map_arrow(lanes.withColumn("lane", F.lit(0)).repartition(*order).sortWithinPartitions(*order), _add(True), SCHEMA)

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64) for x in batch.column(2).to_pylist()]
            made = [np.log2(c + 1.0).astype(np.uint8).tobytes() for c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(c.sum()) for c in found], pa.int64()), pa.array(made, pa.binary())], names=["part", "n", "ranks"])

    out, total = np.zeros(1 << bits, np.uint8), 0
    for r in map_arrow(whole, ranks, "part int, n long, ranks binary").collect():  # a byte for each counter
        found = np.frombuffer(r.ranks, np.uint8)
        out[r.part * PART : r.part * PART + len(found)] = found
        total += r.n
    return out, total
