"""Hard negatives against all pairs in whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, positives=5, negatives=5, floor=80, scale=256):
    use = [(i, [math.floor(x * scale) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(use):
        if i % 10:
            continue
        dot = [max(-hn.MOST, min(hn.MOST, sum(p * q for p, q in zip(v, w)))) for _, w, _ in use]
        near = sorted((-dot[b], use[b][0], b) for b in range(len(use)) if b != a and use[b][2] == y)[:positives]
        for rank, (s, j, _) in enumerate(near, 1):
            hard = sorted((-dot[b], use[b][0]) for b in range(len(use)) if use[b][2] != y and floor * -s <= 100 * dot[b] <= 100 * -s)[:negatives]
            out += [(i, j, rank, k, n, -s, -t) for k, (t, n) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect())


def vectors(n=300, width=6, kinds=4, seed=1):
    rng = random.Random(seed)
    middle = [rng.gauss(0, 1) for _ in range(width)]
    return [(i, [m + rng.gauss(0, 0.6) for m in middle], rng.randrange(kinds)) for i in range(n)]


def test_all_pairs(spark):
    rows = vectors()
    assert mined(spark, rows) == plain(rows) != []


def test_other_parameters_and_several_passes(spark):
    rows = vectors(seed=2)
    got = mined(spark, rows, positives=3, negatives=2, floor=95, scale=16, pass_bytes=200)
    assert got == plain(rows, 3, 2, 95, 16) != []


def test_ties_repeats_and_a_hot_vector(spark):
    rows = vectors(60) + [(i, [1.0] * 6, i % 2) for i in range(60, 460)] + [(100, [1.0] * 6, 0)] * 3
    assert mined(spark, rows) == plain(rows)


def test_odd_rows_take_no_part(spark):
    rows = vectors(80) + [(100, None, 1), (110, [1.0, None], 1), (120, [math.nan, 1.0], 1), (None, [1.0] * 6, 1), (130, [1.0], None), (140, [math.inf], 2)]
    rows += [(150, [], 1), (160, [1.0], 1), (170, [2.0] * 9, 2), (181, [0.0] * 6, 2)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(10, [1.0], 1), (20, None, 1)]) == []


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(i, [float(2**24 + i), 2.0**20, 1 / 256 * (i % 5)], i % 2) for i in range(40)]
    assert mined(spark, rows) == plain(rows) != []
    far = [(i, [1e200 if i % 3 else 2.0**40], i % 2) for i in range(30)]
    got = mined(spark, far)
    assert got and max(r[5] for r in got) == hn.MOST


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, v, y, 1, 2, 3) for i, v, y in vectors(40)], SCHEMA + ", row int, ID int, Anchor int")
    assert hn.hard_negatives(df, F.col("vec_id") % 10 == 0).count() == len(plain(vectors(40)))


def test_products_choose_a_way_that_is_exact():
    a, b = np.array([[3, -2]]), np.array([[5, 7], [1 << 40, 1]])
    assert hn.products(a, b[:1]).tolist() == [[1]]
    assert hn.products(a * (1 << 20), b).tolist() == [[1 << 20, (3 << 60) - (2 << 20)]]


@pytest.mark.parametrize("k", [1, 3])
def test_best_keeps_the_first_of_equal_scores(k):
    best = hn.Best(np.array([0, 0]), k)
    best.add(np.array([0, 0, 0, 1]), np.array([5, 7, 7, 1]), np.array([10, 11, 12, 13]), np.array([0, 1, 2, 3]))
    assert best.row[0].tolist() == [11, 12, 10][:k] and best.row[1, 0] == 13 and best.least().tolist() == [[7, 5][k > 1], 0 if k > 1 else 1]
