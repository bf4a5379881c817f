"""Shared helpers: shared-folder tables, Arrow workers, per-worker caches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import ship
from pagewright.sources.shared import saved, shared_dir, workspace

__all__ = ["by_bytes", "documents", "fold", "held_out", "map_arrow", "private", "saved", "shared_dir", "worker_cache", "workspace"]

HELD_OUT_REMAINDER = 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows that a worker takes out of an Arrow batch at once; bounds what it holds besides the batch.
SLICE_ROWS = 512


def give_back() -> None:
    """Return memory that is free within the worker to the system: workers live on from stage to stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sliced(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(keeps)
        yield from fn(batch.slice(a, SLICE_ROWS) for batch in batches for a in range(0, batch.num_rows, SLICE_ROWS))
        give_back()

    return run


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: str = "") -> DataFrame:
    """``mapInArrow`` whose code the executors have. keeps: the owner of what ``fn`` leaves in ``worker_cache``."""
    ship(df.sparkSession)
    return df.mapInArrow(sliced(fn, keeps), schema)


def private(df: DataFrame, *names: str) -> list[str]:
    """The names, behind as many underscores as no column of the frame begins with (columns differ by more than case)."""
    taken, mark = {c.lower() for c in df.columns}, "__"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return [mark + n for n in names]


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, across tasks. Keys are tuples that begin with their owner's name."""
    return sys.modules.setdefault("_pagewright_worker_cache", types.ModuleType("_pagewright_worker_cache")).__dict__


def drop_others(owner: str) -> None:
    """Drop what other owners keep in this worker: all idle workers take turns, and each would hold a tokenizer for good."""
    cache = worker_cache()
    for key in [k for k in cache if isinstance(k, tuple) and k[0] != owner]:
        del cache[key]


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(fold(doc_id) == HELD_OUT_REMAINDER, F.lit(False))


def by_bytes(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
