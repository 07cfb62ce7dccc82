"""Whitening against a full eigendecomposition, exact sums, and the range finder's own ways."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.llm import whitening

VECTORS = "vec_id long, embedding array<double>"


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS).repartition(5)


def brute(x, k):
    """Rows (id, component) -> (deviation, whitened up to sign, explained)."""
    whole = np.floor(1024 * x) + 100_000
    n, sums = len(whole), [sum(map(int, c)) for c in whole.T]
    off = whole - np.array(sums) / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in whole]
    return deviation, off @ vectors / np.sqrt(values), values / np.trace(off.T @ off / n)


def check(found, x, k):
    deviation, white, share = brute(x, k)
    rows = found.collect()
    assert len(rows) == len(x) * k
    got = np.zeros((len(x), k))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (len(x), deviation[r.vec_id])
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    for c in range(k):
        sign = np.sign(got[:, c] @ white[:, c])
        assert np.abs(got[:, c] - sign * white[:, c]).max() < 1e-6, c


@pytest.mark.parametrize("falls", [1.0, 0.5])
def test_components_are_those_of_the_covariance(spark, falls):
    """A flat spectrum, where the range must grow, and one that falls, where it needn't."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 40)) * 4 * falls ** np.arange(40) + 3
    df = table(spark, x)
    check(whitening.whiten(df, 8), x, 8)
    assert whitening.fit(df, 8).grown == (falls == 1.0)


def test_fewer_dimensions_than_components(spark):
    x = np.random.default_rng(2).normal(size=(60, 3))
    check(whitening.whiten(table(spark, x), 8), x, 3)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, []), (6, [float("-inf"), 0.0]), (None, [1.0, 1.0]), (7, [3.0]), (1, [1.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).withColumn("n", F.lit("x")).withColumn("v", F.lit("y")), 8).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, c) for i in (0, 1, 1, 5, 7) for c in (1, 2))
    assert {r.n for r in got} == {5}
    by = {(r.vec_id, r.component): r for r in got}
    whole = [[101024, 102048], [101024, 101024], [100000, 100000], [103072, 100000], [101024, 102048]]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    assert by[5, 1].deviation == sum((5 * a - s) ** 2 for a, s in zip(whole[2], sums, strict=True))


def test_no_spread(spark):
    """Empty tables, one row, equal rows, empty vectors: nothing to whiten. A dimension alike in all rows is left out."""
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, []), (2, [])], [(1, None)]):
        df = spark.createDataFrame(rows, VECTORS)
        got = whitening.whiten(df, 8)
        assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0]) for i in range(9)], VECTORS), 8).collect()
    assert {r.component for r in got} == {1} and len(got) == 9


def test_deviations_are_exact_beyond_doubles(spark):
    x = np.array([[0.0, 3e5], [2e5, 1.0], [-1e5, 7.0]])
    got = {r.vec_id: r.deviation for r in whitening.whiten(table(spark, x), 1).collect()}
    want = brute(x, 1)[0]
    assert max(want) > 2**53 and got == dict(enumerate(min(w, whitening.LONG) for w in want))
    huge = {r.vec_id: r.deviation for r in whitening.whiten(table(spark, x * 1e8), 1).collect()}
    assert set(huge.values()) == {whitening.LONG}


def test_partitions_change_nothing(spark):
    x = np.random.default_rng(4).normal(size=(300, 20))
    one, many = (whitening.fit(table(spark, x).repartition(p), 8) for p in (1, 30))
    assert one.sums == many.sums and np.abs(one.vectors - many.vectors).max() < 1e-9
