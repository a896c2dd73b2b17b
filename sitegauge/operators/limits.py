"""Sliding rate limits as an ordered fold: hits that are refused don't count."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decide(batches: Iterator[pa.RecordBatch], most: int, window: int) -> Iterator[pa.RecordBatch]:
    """Accepted and wait of each row of a task's batches, which are sorted by key and time."""
    key, live = object(), deque()  # the accepted hits of the current key within the window, ``most`` at most
    for batch in batches:
        accepted, waits = [], []
        for own, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if own != key:
                key, live = own, deque()
            while live and at is not None and live[0] <= at - window:
                live.popleft()
            free = at is not None and len(live) < most
            accepted.append(None if at is None else free)
            waits.append(None if at is None else 0 if free else max(1, live[0] + window - at))
            if free:
                live.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted, pa.bool_()), pa.array(waits, pa.int64())], names=[*batch.schema.names, "accepted", "wait"])


def rate_limited(hits: DataFrame, key: str, seconds: str, most: int, window: int = 3600) -> DataFrame:
    """key, at, accepted, wait for every hit (``seconds`` since the epoch) of each key in order of time.

    Hits are dealt by key and sorted; a task streams its rows and holds the last ``most`` accepted times of one
    key, whatever a key's number of hits. All of a key's hits pass through one task, as each depends on those
    before. A hit without a time is neither accepted nor refused (null); a null key is a key like others.
    """
    kind = hits.schema[key].dataType.simpleString()
    rows = hits.select(F.col(key), F.col(seconds).cast("bigint").alias("at")).repartition(key).sortWithinPartitions(key, "at")
    return rows.mapInArrow(partial(decide, most=most, window=window), f"`{key}` {kind}, at bigint, accepted boolean, wait bigint")
