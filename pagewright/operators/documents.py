"""Documents as records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import document


def merge(own: Column, other: Column) -> Column:
    """Both documents as one: the other's text and boxes first, the first error there is."""
    text = F.concat(other["text"], F.lit("\n"), own["text"])
    error = F.when(own["exception"] != "", own["exception"]).otherwise(other["exception"])
    return document(text, F.concat(other["bboxes"], own["bboxes"]), own["path"], own["type"], error)
