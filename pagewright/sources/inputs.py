"""Rows from files, bytes and rows, and content kept beside wide rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

CONTENT_REF = "contentRef"


def to_rows(spark: SparkSession, source, pattern: str | None = None) -> DataFrame:
    """content and path for a path or URI (a folder, with a name pattern) or for bytes; a DataFrame or rows as they are."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, (bytes, bytearray, memoryview)):
        return spark.createDataFrame([(bytes(source), "memory")], "content binary, path string")
    if isinstance(source, str):
        reader = spark.read.format("binaryFile")
        return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(source).select("content", "path")
    if isinstance(source, (dict, Row)):
        source = [source]
    return spark.createDataFrame([r if isinstance(r, Row) else Row(**r) for r in source])


def stream_files(spark: SparkSession, folder: str, per_batch: int = 64, pattern: str | None = None) -> DataFrame:
    """Files as a stream of rows with content and path; so many files make a batch."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder).select("content", "path")


def with_content(rows: DataFrame, contents: DataFrame, ref: str = CONTENT_REF, key: str = "key") -> DataFrame:
    """Rows with the content that their key names, joined late so that it stays off the wide rows. Unknown keys raise."""
    joined = rows.join(contents.select(F.col(key).alias(ref), "content"), ref, "left")
    missing = F.raise_error(F.concat(F.lit("unknown content "), F.coalesce(F.col(ref), F.lit("null")))).cast("binary")
    return joined.withColumn("content", F.when(F.col(ref).isNull() | F.col("content").isNotNull(), F.col("content")).otherwise(missing))
