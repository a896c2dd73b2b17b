"""Operator 11: hard negatives by blocked matrix products of anchors with all candidates."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegauge.llm.common import scratch, write_out
from sitegauge.sources.tables import read_table

#: Components are taken as whole numbers of 1 / SCALE.
SCALE = 256
#: Positives of an anchor, negatives of an anchor and positive, and the per cent of the positive's score that a negative's has at least.
POSITIVES, NEGATIVES, FLOOR = 5, 5, 80
#: Bytes of anchors that one pass broadcasts on average; anchors and candidates of one product.
PASS_BYTES, ANCHOR_ROWS, CANDIDATE_ROWS = 16 << 20, 256, 2048
#: Below this doubles hold sums of products exactly, in any order; a score beyond a long is clamped.
EXACT = 1 << 53
MOST = (1 << 63) - 1
LEAST = -MOST


def finite(vector: str) -> Column:
    """Whether the vector is there and has no null or non-finite component."""
    return F.coalesce(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors of an Arrow column as rows of whole numbers, shorter ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def reach(rows: np.ndarray) -> int:
    """The largest absolute component."""
    return max(abs(int(rows.min(initial=0))), abs(int(rows.max(initial=0))))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``: one matrix product of doubles where these are exact."""
    if reach(a) * reach(b) * max(1, a.shape[1]) < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    wide = a.astype(object) @ b.T.astype(object)
    return np.clip(wide, LEAST + 1, MOST).astype(np.int64)


class Best:
    """The ``k`` highest scores of each slot with the rows that have them; of equal scores, those seen first.

    Rows come in order of their ids, so that a row which only equals the last of a full slot never enters it.
    """

    def __init__(self, floor: np.ndarray, k: int):
        self.k, n = k, len(floor)
        self.score = np.repeat(floor[:, None], k, axis=1)
        self.row = np.full((n, k), -1, dtype=np.int64)
        self.id = np.full((n, k), -1, dtype=np.int64)

    def least(self) -> np.ndarray:
        """What a score has to exceed to enter each slot."""
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, row: np.ndarray, ids: np.ndarray) -> None:
        """Take scores above ``least``, in the order of rows."""
        used = np.unique(slot)
        held = np.repeat(used, self.k)
        slots, scores = np.concatenate([held, slot]), np.concatenate([self.score[used].reshape(-1), score])
        rows, names = np.concatenate([self.row[used].reshape(-1), row]), np.concatenate([self.id[used].reshape(-1), ids])
        free = np.concatenate([self.row[used].reshape(-1) < 0, np.zeros(len(slot), dtype=bool)])
        order = np.lexsort((np.arange(len(slots)), free, -scores, slots))
        first = np.searchsorted(slots[order], used)
        best = order[(first[:, None] + np.arange(self.k)).reshape(-1)].reshape(len(used), self.k)
        self.score[used], self.row[used], self.id[used] = scores[best], rows[best], names[best]

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """(slot, place in the slot) of what the slots hold."""
        return np.nonzero(self.row >= 0)


class Anchors:
    """A pass's anchors: row keys in order, labels, and vectors."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(rows)
        self.rows, self.labels, self.vectors = rows[order], labels[order], vectors[order]


def compared(batches, width: int, anchors: Anchors, slots: Best, each: int, same: bool, ceiling: np.ndarray | None):
    """Fill ``slots`` (``each`` of them an anchor) from the candidates of one task, in order of ids."""
    for batch in batches:
        rows, ids, labels = (batch.column(n).to_numpy() for n in ("row", "id", "label"))
        for c in range(0, batch.num_rows, CANDIDATE_ROWS):
            part = slice(c, min(batch.num_rows, c + CANDIDATE_ROWS))
            vectors = matrix(batch.column("vector")[part], width)
            for a in range(0, len(anchors.rows), ANCHOR_ROWS):
                own = slice(a, min(len(anchors.rows), a + ANCHOR_ROWS))
                score = products(anchors.vectors[own], vectors)
                wrong = (anchors.labels[own, None] == labels[None, part]) != same
                if same:  # an anchor is no positive of its own
                    wrong |= anchors.rows[own, None] == rows[None, part]
                score[wrong] = LEAST
                for e in range(each):
                    slot = np.arange(own.start, own.stop) * each + e
                    over = score > slots.least()[slot][:, None]
                    if ceiling is not None:
                        over &= score <= ceiling[slot][:, None]
                    r, k = np.nonzero(over)
                    if len(r):
                        slots.add(slot[r], score[r, k], rows[part][k], ids[part][k])
    slot, place = slots.found()
    anchor, e = slot // each, slot % each
    columns = (anchors.rows[anchor], e.astype(np.int32), slots.row[slot, place], slots.id[slot, place], slots.score[slot, place])
    for a in range(0, len(slot), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 10_000]) for x in columns], names=["anchor", "slot", "row", "id", "score"])


FOUND = "anchor long, slot int, row long, id long, score long"


def first_of_all(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor and slot over all tasks, numbered from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def one_pass(candidates: DataFrame, anchors: Anchors, width: int, positives: int, negatives: int, floor: int) -> DataFrame:
    """(anchor, positive, positive_rank, positive_score, negative, rank, negative_score) of the anchors."""
    spark = candidates.sparkSession
    shared: Broadcast[Anchors] = spark.sparkContext.broadcast(anchors)
    ordered = candidates.sortWithinPartitions("id", "row")
    many = len(anchors.rows)

    def near(batches):
        yield from compared(batches, width, shared.value, Best(np.full(many, LEAST), positives), 1, True, None)

    best = write_out(first_of_all(ordered.mapInArrow(near, FOUND), positives))
    known = best.select("anchor", "rank", "score").toPandas()  # positives of the anchors of one pass
    slot = np.searchsorted(anchors.rows, known["anchor"].to_numpy()) * positives + known["rank"].to_numpy() - 1
    low, high = np.full(many * positives, MOST), np.full(many * positives, LEAST)
    high[slot] = known["score"].to_numpy()
    low[slot] = [-(-int(s) * floor // 100) - 1 for s in known["score"]]  # scores are whole: above this is at or above the floor
    windows = spark.sparkContext.broadcast((low, high))

    def hard(batches):
        low, high = windows.value
        yield from compared(batches, width, shared.value, Best(low.copy(), negatives), positives, False, high)

    worst = first_of_all(ordered.mapInArrow(hard, FOUND), negatives).select(
        "anchor", (F.col("slot") + 1).alias("positive_rank"), F.col("id").alias("negative"), "rank", F.col("score").alias("negative_score")
    )
    pairs = best.select("anchor", F.col("id").alias("positive"), F.col("rank").alias("positive_rank"), F.col("score").alias("positive_score"))
    out = write_out(pairs.join(worst, ["anchor", "positive_rank"]))
    shared.unpersist()
    windows.unpersist()
    return out


def hard_negatives(
    df: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    floor: int = FLOOR,
    scale: int = SCALE,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x), and a score is the inner product of two such vectors, by matrix products of
    blocks in doubles, which are exact below 2^53; larger ones are summed in whole numbers, and a score beyond a long is
    clamped to its range. Rows for which ``anchor`` holds are anchors. The positives of an anchor are its first
    ``positives`` other rows of its label by score, then by id; for each of them the first ``negatives`` rows
    of other labels with floor per cent to 100 per cent of the positive's score are returned (none for a
    negative score). Rows with a null id, label or vector, or with a null or non-finite component, take no
    part. A shorter vector counts as filled up with zeros. Repeated rows are rows like others, each with its own
    result as an anchor, and a positive or negative of its own. An empty table gives an empty result.

    Anchors are broadcast in passes of about ``pass_bytes``; each pass reads the candidates twice, and every task keeps only the
    best of each anchor, so that labels need no grouping and no hot label makes a large task.
    """
    with scratch(df.sparkSession):
        return write_out(mined(df, anchor, vec_id, vector, label, positives, negatives, floor, scale, pass_bytes), outlive=True)


def mined(df, anchor, vec_id, vector, label, positives, negatives, floor, scale, pass_bytes) -> DataFrame:
    whole = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * scale))
    taking = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & finite(vector)
    own = df.where(taking).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor")
    )
    rows = write_out(own.withColumn("row", F.monotonically_increasing_id()))
    some = rows.agg(F.max(F.size("vector")), F.count_if("anchor"), F.sum(F.when(F.col("anchor"), F.size("vector").cast("long")))).first()
    width, passes = some[0] or 0, max(1, ceil(8 * (some[2] or 0) / pass_bytes))
    candidates, out = rows.select("row", "id", "label", "vector"), []
    for k in range(passes):
        chosen = rows.where(F.col("anchor") & (F.pmod(F.xxhash64("row"), F.lit(passes)) == k))
        part = chosen.select("row", "label", "vector").toArrow()  # about pass_bytes
        anchors = Anchors(part["row"].to_numpy(), part["label"].to_numpy(), matrix(part["vector"].combine_chunks(), width))
        if len(anchors.rows):
            out.append(one_pass(candidates, anchors, width, positives, negatives, floor))
    ids = rows.where("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    if not out:
        names = "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long"
        return df.sparkSession.createDataFrame([], names)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.join(ids, "anchor").select(
        "anchor_id", F.col("positive").alias("positive_id"), "positive_rank", "rank", F.col("negative").alias("negative_id"), "positive_score", "negative_score"
    )


ORACLE = """
WITH usable AS (
  SELECT row_number() OVER () AS row_no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row_no AS anchor, a.vec_id AS anchor_id, b.row_no AS other, b.vec_id AS other_id, a.label = b.label AS alike,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.row_no <> b.row_no),
positives AS (SELECT * FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id, other) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other_id, n.other) AS INTEGER) AS rank,
  n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.alike AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has the next label."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
