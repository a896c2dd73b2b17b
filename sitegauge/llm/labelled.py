"""The bounded sample of labelled documents that classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier is fitted on at most, those of the smallest hashes of their ids.
TRAIN_ROWS = 12_000


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id as text leaves 2 by 4; a null id is held out."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 4 == 2, F.lit(True))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents that are not held out.

    Labels that are null or of no document don't count; of several labels of an id the highest holds, and
    of several texts of an id the first in order, so that repeated rows don't weigh more.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sample = (
        known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )  # at most `rows` ids, so it may be sent to every executor
    return docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
