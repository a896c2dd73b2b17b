"""Sliding rate limits of a stream of hits: accepted times are a key's state, which expires with the window."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: The state store that keeps variables of more than one kind.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "accepted"


class Limit(StatefulProcessor):
    """Accepts a key's hits while fewer than ``most`` were accepted in the ``window`` of seconds before them.

    The state of a key is the list of its accepted times, ``most`` at most. A timer is set for the moment at which the last of
    them leaves the window; when the watermark passes it, the list is cleared and the key is gone from the state.
    """

    def __init__(self, key: str, kind: type, most: int, window: int):
        self.key, self.kind, self.most, self.window = key, kind, most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getListState(STATE, "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        times = sorted(t for part in rows for t in part["at"].tolist())  # of one key in one micro-batch
        live = [row[0] for row in self.accepted.get()] if self.accepted.exists() else []
        answers = []
        for at in times:
            live = [t for t in live if t > at - self.window]
            free = len(live) < self.most
            answers.append((at, free, 0 if free else max(1, live[0] + self.window - at)))
            if free:
                live.append(at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if live:
            self.accepted.put([(t,) for t in live])
            self.handle.registerTimer((live[-1] + self.window) * 1000)
        else:
            self.accepted.clear()
        made = pd.DataFrame(answers, columns=["at", "accepted", "wait"])
        made.insert(0, self.key, pd.Series([key[0]] * len(made), dtype=object if self.kind is str else None))
        yield made

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.accepted.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def limited_stream(hits: DataFrame, key: str, time: str, most: int, window: int = 3600, late: str = "0 seconds") -> DataFrame:
    """key, at, accepted, wait of the hits of a stream (``time`` is a timestamp): the streaming form of ``limits.rate_limited``.

    Hits of a micro-batch are taken in order of time; those that come later than ``late`` behind the latest hit of earlier micro-batches are
    dropped by the watermark, as are hits without a time. Keys without an accepted hit in the window hold no state.
    """
    kind = hits.schema[key].dataType.simpleString()
    rows = hits.where(F.col(time).isNotNull()).select(F.col(key), F.col(time).alias("time"), F.unix_seconds(time).alias("at")).withWatermark("time", late)
    processor = Limit(key, str if kind == "string" else int, most, window)
    columns = f"`{key}` {kind}, at bigint, accepted boolean, wait bigint"
    return rows.groupBy(key).transformWithStateInPandas(processor, columns, outputMode="Append", timeMode="EventTime")


def run_limited(spark: SparkSession, hits: DataFrame, key: str, time: str, folder: str, most: int, window: int = 3600, late: str = "0 seconds") -> StreamingQuery:
    """Take all hits that are there, in as many micro-batches as the source makes, and end; started again on the same ``folder`` it goes on."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, STORE)
    try:  # a query keeps the settings with which it was started
        made = limited_stream(hits, key, time, most, window, late)
        return made.writeStream.format("parquet").option("path", f"{folder}/answers").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def live_keys(spark: SparkSession, folder: str) -> DataFrame:
    """key, at: the state that is left after the last micro-batch."""
    return spark.read.format("statestore").option("stateVarName", STATE).option("flattenCollectionTypes", "true").load(f"{folder}/progress")
