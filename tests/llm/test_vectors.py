"""Exact top-k against brute force, and recall of the nearest neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trellis.llm import hnsw, topk

VECTORS = "vec_id long, embedding array<float>, rank int"


def table(spark, n=700, width=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[5] = x[6] = x[7]  # ties
    x[n // 2 :] = x[n // 2 :] * 0.01
    return x, spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)


def brute(scores, ids, query, k):
    order = sorted((i for i in ids if i != query), key=lambda i: (-scores[i], i))[:k]
    return [(query, r + 1, i, scores[i]) for r, i in enumerate(order)]


def test_top_k_is_exact(spark):
    x, df = table(spark)
    whole = np.floor(1024 * x.astype(float))
    found = topk.top_k(df, F.col("vec_id") % 7 == 0, 10, shard_rows=200, block_rows=30)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    want = [r for q in range(0, len(x), 7) for r in brute((whole @ whole[q]).astype(int), range(len(x)), q, 10)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_nearest_finds_nine_in_ten(spark):
    x, df = table(spark, 3000, 24, 1)
    found = hnsw.nearest(df, F.col("vec_id") % 20 == 0, 20, shard_rows=1500)
    got = {}
    for q, r, i, s in found.collect():
        got.setdefault(q, []).append((r, i, s))
    wide = x.astype(float)
    hits = total = 0
    for q in range(0, len(x), 20):
        want = {i for _, _, i, _ in brute(wide @ wide[q], range(len(x)), q, 20)}
        rows = sorted(got[q])
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert all(abs(s - wide[i] @ wide[q]) < 1e-9 for _, i, s in rows) and all(i != q for _, i, _ in rows)
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        hits, total = hits + len(want & {i for _, i, _ in rows}), total + 20
    assert hits / total >= 0.9


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [float("nan"), 1.0], 1), (3, [1.0, None], 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [1.0, 2.0], 1), (7, [float("inf"), 0.0], 1), (None, [1.0, 1.0], 1), (8, [3.0], 1), (6, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, VECTORS)
    exact = topk.top_k(df, F.col("vec_id") == 0, 10).collect()
    assert [(r.vec_id, r.score) for r in exact] == [(6, 5 * 1024**2), (8, 3 * 1024**2), (4, 0), (5, 0)]
    near = hnsw.nearest(df, F.col("vec_id") == 0, 20).collect()
    assert [(r.vec_id, r.score) for r in near] == [(6, 5.0), (8, 3.0)]


def test_empty_tables_and_no_queries(spark):
    _, df = table(spark, 20)
    for some in (df.limit(0), df):
        assert topk.top_k(some, F.lit(False), 5).count() == 0
        assert hnsw.nearest(some, F.lit(False), 5).count() == 0


def test_equal_vectors_beyond_k(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0], 0) for i in range(60)] + [(99, [0.5, 0.5], 0)], VECTORS)
    near = hnsw.nearest(df, F.col("vec_id") == 3, 5).collect()
    assert [r.vec_id for r in near] == [0, 1, 2, 4, 5]
