"""Runs arriving as a stream: each batch is appended and compared with the latest earlier run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def watch(runs: DataFrame, store: str, checkpoint: str, compare: Callable[[DataFrame, DataFrame], DataFrame], changes: str) -> StreamingQuery:
    """Starts a query that writes ``compare(now, before)`` of each batch to ``changes``.

    A batch's snapshot lies in a folder of its number, so that a batch that is run again replaces itself.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        now = spark.read.parquet(f"{store}/batch={number}")
        before = spark.read.parquet(f"{store}/batch={number - 1}") if number else now.limit(0)
        compare(now, before).write.mode("overwrite").parquet(f"{changes}/batch={number}")

    return runs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
