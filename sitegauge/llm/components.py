"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import scratch, write_out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, for nodes 0 to n - 1 and links a-b held by one task."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while True:  # shorten paths to the roots
            up = label[label]
            if (up == label).all():
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``: root is the smallest node reachable.

    In each round every node hooks onto its smallest neighbour, hooks are shortened to their roots, and
    links are rewritten between roots, until none is left; that takes a number of rounds that grows with
    the logarithm of the nodes. Joins are of links with one row per node, so that a node with very many
    links can be split. All rounds go through durable files.
    """
    with scratch(links.sparkSession):
        return write_out(contracted(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")), outlive=True)


def contracted(ends: DataFrame) -> DataFrame:
    ends = write_out(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not ends.isEmpty():
        both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = write_out(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("__m")).select("node", F.least("node", "__m").alias("root")))
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("__up"))
            higher = up.select(F.col("root").alias("__up"), F.col("__up").alias("__top"))
            jumped = hooks.join(up, "root").join(higher, "__up")
            jumped = write_out(jumped.select("node", F.col("__top").alias("root"), (F.col("__top") != F.col("__up")).alias("moved")))
            hooks = jumped.drop("moved")
            if not jumped.where("moved").limit(1).count():
                break
        rounds.append(hooks)
        roots_a = hooks.select(F.col("node").alias("a"), F.col("root").alias("__a"))
        roots_b = hooks.select(F.col("node").alias("b"), F.col("root").alias("__b"))
        rest = ends.join(roots_a, "a").join(roots_b, "b").where("__a <> __b")
        ends = write_out(rest.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")).distinct())
    if not rounds:
        return ends.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[-1]
    for hooks in reversed(rounds[:-1]):  # a root of this round is a node of the next, unless it was done
        later = out.select(F.col("node").alias("root"), F.col("root").alias("__later"))
        out = hooks.join(later, "root", "left").select("node", F.coalesce("__later", "root").alias("root"))
    return out
