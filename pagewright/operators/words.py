"""Words with offsets, and documents whose boxes are their words. Both are made row by row; nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BOXES, document

PLACED = "array<struct<word:string,start:int>>"
#: Bytes of text that a worker takes apart at once; an Arrow batch can hold far more, and its words take some 50 times its room.
PIECE = 1 << 20


def pieces(texts: pa.Array, *others: pa.Array, most: int = PIECE) -> Iterator[tuple[pa.Array, ...]]:
    """The arrays cut at the same rows, so that a piece has so many bytes of text or one row."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield tuple(a.slice(at, stop - at) for a in (texts, *others))
        at = stop


def _split(texts: pa.Array, separator: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts, the first word of each text (one more than texts), and each word's place in its text."""
    lists = [[] if t is None else t.split(separator) for t in texts.to_pylist()]
    words = [w for ws in lists for w in ws]
    sizes = np.array([len(ws) for ws in lists], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + len(separator))])
    return pa.array(words, pa.string()), first, ends[:-1] - np.repeat(ends[first[:-1]], sizes)


def placed_words(text: Column, separator: str = " ") -> Column:
    """array<struct<word,start>>: the words between single separators, with their places; a null text has none."""

    @F.arrow_udf(PLACED)
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (texts,) in (piece for batch in batches for piece in pieces(batch)):
            words, first, starts = _split(texts, separator)
            cells = pa.StructArray.from_arrays([words, pa.array(starts, pa.int32())], ["word", "start"])
            yield pa.ListArray.from_arrays(pa.array(first, pa.int32()), cells)

    return place(text)


def word_offsets(df: DataFrame, key: str, text: str, separator: str = " ") -> DataFrame:
    """key, pos, word, start: words between single separators, with their places in the text."""
    cells = df.select(F.col(key), F.posexplode(placed_words(F.col(text), separator)).alias("pos", "cell"))
    return cells.select(key, "pos", "cell.word", "cell.start")


def word_boxes(text: Column, unit: float = 10.0) -> Column:
    """One box for each word that is not empty; a character is a unit wide and high."""

    @F.arrow_udf(BOXES)
    def boxes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (texts,) in (piece for batch in batches for piece in pieces(batch)):
            words, first, starts = _split(texts, " ")
            sizes = np.array(pa.compute.utf8_length(words).to_numpy(zero_copy_only=False), np.int64)
            some = np.flatnonzero(sizes)
            bounds = np.concatenate([[0], np.cumsum(sizes > 0)])[first]
            number = lambda values: pa.array(np.asarray(values, float), pa.float64())
            size, none = sizes[some], np.zeros(len(some))
            columns = [words.take(pa.array(some)), number(none + 1), number(starts[some] * unit), number(none), number(size * unit), number(none + unit), number(none)]
            cells = pa.StructArray.from_arrays(columns, ["text", "score", "x", "y", "width", "height", "angle"])
            yield pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), cells)

    return boxes(text)


def as_document(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, document: the text and one box for each of its words that is not empty, row by row; no row is lost or mixed
    with another, whatever its key."""
    return df.select(F.col(key), document(F.coalesce(F.col(text), F.lit("")), word_boxes(F.col(text))).alias("document"))
