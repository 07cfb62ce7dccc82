"""Exact top-k search by inner product of integer vectors.

Within a shard the candidates are sorted by length, longest first, and gone through in chunks. All
vectors are turned by the corpus's singular vectors, so that the first few coordinates hold most of
an inner product; the rest is bounded by the product of the residual lengths (Cauchy-Schwarz). Only
pairs whose bound reaches the query's k-th score so far are computed in full, in integers; when not
even the lengths can reach it, the query is done. Bounds are in doubles with a margin above their
error, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.deploy import ship
from trellis.llm.vectors import by_blocks, dealt, matrix, pairs_to_best, ranked, rows_within, usable

SHARD_ROWS, BLOCK_ROWS = 16_384, 2_048
CHUNK, HEAD, SCALE = 1_024, 16, 1024.0
#: So many coordinates, the first, are turned; the others count among what is bounded.
TURNED = 512


def _integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors)


def singular_vectors(rows: DataFrame, vector: str, width: int) -> np.ndarray:
    """The directions of most length first, of the first TURNED coordinates at most; from the sum of outer products
    over all rows."""
    wide = min(width, TURNED)

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide, wide))
        step = rows_within(SHARD_ROWS, width)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.column(0).slice(at, step)
                table = pa.table({"id": pa.array(range(len(part)), pa.int64()), "v": part})
                x = _integers(matrix(table, "id", "v", width)[1])
                x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1))[:, :wide]
                total += x.T @ x
        i, j = np.divmod(np.arange(wide * wide), wide)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    sums = rows.select(vector).mapInArrow(outer, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    gram = np.zeros((wide, wide))
    gram[sums["i"], sums["j"]] = sums["v"]
    return np.linalg.eigh(gram)[1][:, ::-1]


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query number, id and integer score of each query's k best of the shard; vectors hold integers."""
    order = np.argsort(-np.linalg.norm(vectors, axis=1), kind="stable")
    ids, vectors = ids[order], vectors[order]
    length, q_length = np.linalg.norm(vectors, axis=1), np.linalg.norm(queries, axis=1)
    head, q_head = (vectors[:, : len(turn)] @ turn[:, :HEAD], queries[:, : len(turn)] @ turn[:, :HEAD])
    rest, q_rest = (np.sqrt(np.maximum(n**2 - (h**2).sum(1), 0)) for n, h in ((length, head), (q_length, q_head)))
    # in doubles sums of integers under 2**53 are exact; beyond, Python's integers are
    exact = float(length.max(initial=0)) * float(q_length.max(initial=0)) < 2**53
    least = np.full(len(queries), -np.inf)
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64 if exact else object)]
    for at in range(0, len(ids), CHUNK):
        part = slice(at, at + CHUNK)
        bound = q_length * length[at]
        alive = np.flatnonzero(bound + 1e-9 * bound + 1e-3 >= least)
        if not len(alive):
            break
        margin = 1e-9 * q_length[alive, None] * length[None, part] + 1e-3
        upper = q_head[alive] @ head[part].T + np.outer(q_rest[alive], rest[part]) + margin
        may = (upper >= least[alive, None]) & (query_ids[alive, None] != ids[None, part])
        q, c = np.nonzero(may)
        if not len(q):
            continue
        if not exact:
            scores = np.array([sum(int(a) * int(b) for a, b in zip(queries[alive[i]], vectors[at + j], strict=True)) for i, j in zip(q, c, strict=True)], object)
            scores = np.clip(scores, -(2**63), 2**63 - 1)
        elif len(q) * 8 > may.size:
            scores = (queries[alive] @ vectors[part].T)[q, c].astype(np.int64)
        else:
            scores = np.concatenate([np.einsum("ij,ij->i", queries[alive[q[i : i + 65536]]], vectors[at + c[i : i + 65536]]) for i in range(0, len(q), 65536)]).astype(np.int64)
        q = alive[q]
        good = scores >= least[q]
        every = [np.concatenate([old, new]) for old, new in zip(best, (q[good], ids[at + c[good]], scores[good]), strict=True)]
        keep = pairs_to_best(*every, k)
        best = [x[keep] for x in every]
        count = np.bincount(best[0], minlength=len(queries))
        full = np.flatnonzero(count >= k)
        least[full] = best[2][np.cumsum(count)[full] - 1].astype(float)
    return best[0], best[1], best[2]


def top_k(rows: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id long, rank int, vec_id long, score long: for each row that is_query holds for, the k other
    rows with the highest inner product of floor(1024 * x), ties to the smaller id; all, if fewer.

    Rows with a null id, and vectors that are null or hold null or non-finite components, take no
    part; an empty vector scores 0. Of rows that repeat an id the least vector counts. Vectors shorter than the longest are
    taken to end in zeros. Scores beyond a long stop at its ends. Without queries, or in an empty
    table, there are no rows. Only the id and the vector are read."""
    ship(rows.sparkSession)
    rows = rows.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    total, asked, width = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("v"))).first()
    width = width or 1
    shards, blocks = max(1, -(-total // rows_within(shard_rows, width))), max(1, -(-asked // rows_within(block_rows, width)))
    turn = singular_vectors(rows, "v", width)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, vectors = matrix(left, "id", "v", width)
        query_ids, queries = matrix(right, "id", "v", width)
        q, c, s = search_shard(ids, _integers(vectors), query_ids, _integers(queries), turn, k)
        return pa.table({"query_id": pa.array(query_ids[q], pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(s.tolist() if s.dtype == object else s, pa.int64())})

    candidates = rows.select("id", "v", dealt("id", shards, 1).alias("shard"))
    found = by_blocks(candidates, rows.where("asks").select("id", "v"), blocks, shards, "id", search, "query_id long, vec_id long, score long")
    return ranked(found, k)
