"""Page-by-page runs: a stream's batches walk the whole chain on their own and give the rows that a batch run gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.errors import ConfigError
from ..plans.stage import Pipeline, Run


def run_pages(pipeline: Pipeline, stream: DataFrame, target: str, checkpoint: str, run: Run | None = None, on_batch: Callable[[int, DataFrame], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """Write the pipeline's rows of each batch below ``target`` as Parquet.

    A batch has a folder of its own that a repeated attempt overwrites, so that every row is there once. Stages that
    need all rows of a run can't work page by page and are refused.
    """
    waiting = pipeline.plan(run)["barriers"]
    if waiting:
        raise ConfigError(f"stages that see all rows can't run page by page: {waiting}")

    def write(batch: DataFrame, number: int) -> None:
        pipeline.transform(batch, run).write.mode("overwrite").parquet(f"{target}/batch={number}")
        if on_batch is not None:
            on_batch(number, batch.sparkSession.read.parquet(f"{target}/batch={number}"))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
