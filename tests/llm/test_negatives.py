"""Hard negatives against brute force: where cells prune, where they can't, and odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.llm import negatives
from trellis.llm.negatives import LONG

ROWS = "vec_id long, embedding array<double>, label int"


def table(spark, x, labels):
    return spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, labels, strict=True))], ROWS).repartition(5)


def brute(x, labels, every, positives, most):
    whole = [[int(v) for v in r] for r in np.floor(256 * np.asarray(x, float))]
    score = lambda a, b: max(-LONG, min(LONG, sum(p * q for p, q in zip(whole[a], whole[b], strict=True))))
    out = []
    for a in range(0, len(x), every):
        s = {b: score(a, b) for b in range(len(x)) if b != a}
        best = sorted(s, key=lambda b: (-s[b], b))
        for p in [b for b in best if labels[b] == labels[a]][:positives]:
            fits = [b for b in best if labels[b] != labels[a] and 50 * s[p] <= 100 * s[b] <= 95 * s[p]][:most]
            out += [(a, p, r + 1, b, s[p], s[b]) for r, b in enumerate(fits)]
    return sorted(out)


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, width)) * 3
    of = rng.integers(0, 12, n)
    x = centre[of] + rng.normal(size=(n, width)) * 0.2
    return x, np.where(rng.random(n) < 0.3, rng.integers(0, 5, n), of % 5)


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies", "lengths"])
def test_as_brute_force(spark, kind):
    """copies: a third of all rows are one vector, so that many ties and one hot cell meet; a label that two rows have."""
    rng = np.random.default_rng(3)
    x, labels = clustered(600, 10, 1) if kind == "clusters" else (rng.normal(size=(600, 10)), rng.integers(0, 4, 600))
    if kind == "copies":
        x[::3], labels[:100:50] = x[0], 99
    if kind == "lengths":
        x *= np.exp(rng.normal(size=(600, 1)) * 2)
    got = negatives.hard_negatives(table(spark, x, labels), F.col("vec_id") % 10 == 0, 5, 3, per_pivot=20, zone_rows=60, group_rows=9)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute(x, labels, 10, 5, 3)


def test_bounds_hold_back_most_candidates_of_clusters(spark):
    """And none that an anchor needs: each anchor reaches every row of the score it looks for."""
    x, labels = clustered(3000, 10, 2)
    whole = np.floor(256 * x)
    rows = table(spark, x, labels).select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"), (F.col("vec_id") % 20 == 0).alias("anchor"))
    cells, _, _, _ = negatives._cells(rows, 10, 30, 200, 50)
    cell, away = cells.of_candidates(whole)
    s = whole[::20] @ whole.T
    least = np.sort(s, axis=1)[:, -6]
    low, high = cells.reach(whole[::20], least)
    reached = (away >= low[:, cell]) & (away <= high[:, cell])
    assert reached[s >= least[:, None]].all() and reached.mean() < 0.25


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (1, None, 1), (2, [float("nan"), 1.0], 1), (3, [1.0, None], 1), (4, [], 2), (5, [0.0, 0.0], 1), (6, [1.0, 2.0], 1), (None, [1.0, 1.0], 1),
        (7, [3.0, 0.7], 2), (6, [1.0, 2.0], 1), (8, [1.0, 1.5], None), (9, [1.0, 1.5], 3), (10, [float("inf"), 1.0], 2), (9, [1.0, 1.5], 4),
    ]
    df = spark.createDataFrame(rows, ROWS)
    got = negatives.hard_negatives(df.withColumn("cell", F.lit(1)).withColumn("anchor", F.lit("x")), F.col("vec_id") == 0, 5, 3).collect()
    one = 256**2
    assert sorted(map(tuple, got)) == [(0, 5, 1, 4, 0, 0), (0, 6, 1, 7, 5 * one, 256 * 768 + 512 * 179), (0, 6, 2, 9, 5 * one, 4 * one)]


def test_no_rows_and_no_anchors(spark):
    df = table(spark, np.ones((5, 2)), [1, 1, 2, 2, 2])
    assert negatives.hard_negatives(df, F.lit(False), 5, 3).count() == 0
    assert negatives.hard_negatives(df.limit(0), F.lit(True), 5, 3).count() == 0
    assert negatives.hard_negatives(df, F.lit(None).cast("boolean"), 5, 3).count() == 0
    assert negatives.hard_negatives(df.where("label = 1"), F.lit(True), 5, 3).count() == 0


@pytest.mark.parametrize("size", [1e6, 1e18, 1e200])
def test_scores_beyond_doubles_and_longs(spark, size):
    x = np.random.default_rng(5).normal(size=(60, 3)) * size
    labels = np.arange(60) % 3
    got = negatives.hard_negatives(table(spark, x, labels), F.col("vec_id") % 6 == 0, 4, 3, per_pivot=10, zone_rows=20, group_rows=4)
    assert sorted(map(tuple, got.collect())) == brute(x, labels, 6, 4, 3)
