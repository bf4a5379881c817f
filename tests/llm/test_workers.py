import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.llm import bpe
from pagewright.llm.common import map_arrow, worker_cache
from pagewright.llm.queries import vocabulary


def owners(batches):
    """For each batch, whose entries the worker's cache holds."""
    for _ in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sorted({k[0] for k in worker_cache() if isinstance(k, tuple)})], pa.list_(pa.string()))], names=["held"])


def held(df, *keeps):
    return {o for r in map_arrow(df, owners, "held array<string>", *keeps).collect() for o in r.held}


def test_workers_drop_what_another_operator_kept(spark):
    df = spark.range(64).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text")).repartition(16)
    for _ in range(2):
        bpe.encode(df, vocabulary()).collect()
    assert held(df) == set()


def test_workers_keep_what_their_operator_left(spark):
    df = spark.range(64).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text")).repartition(16)
    bpe.encode(df, vocabulary()).collect()
    assert held(df, bpe.KEEPS) == {bpe.KEEPS}
