"""What the vector searches share: which rows take part, and how queries meet shards of candidates.

Candidates are dealt over shards and queries over blocks, both by a hash of the id and both of a
bounded size; a task gets one shard with one block. Each shard's best are merged by a window over a
query's rows, of which there are k for each shard.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.deploy import ship


def usable(vector: str) -> Column:
    """False for null vectors and those that hold a null, NaN or infinite component."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & fine, F.lit(False))


def rows_within(most: int, width: int) -> int:
    """How many vectors of a width may lie in one task: ``most``, or as many as take 128 MB as doubles."""
    return max(1, min(most, (1 << 24) // max(1, width)))


def dealt(key: str, of: int, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(of)).cast("int")


def matrix(table: pa.Table, key: str, vector: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors as doubles, one row an id, ids ascending; short vectors end in zeros. Of rows that
    repeat an id the one whose vector is the least, component by component, counts."""
    lists = table.column(vector).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ids, sizes = table.column(key).to_numpy(), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(ids), width))
    out[np.repeat(np.arange(len(ids)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    order = np.lexsort((*out.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    ids, out = ids[order], out[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
    return ids[first], out[first]


def pairs_to_best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best pairs: highest score, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    start = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    begun = np.flatnonzero(start)
    rank = np.arange(len(q)) - np.repeat(begun, np.diff(np.append(begun, len(q))))
    return order[rank < k]


def by_blocks(left: DataFrame, right: DataFrame, blocks: int, shards: int, key: str, search: Callable, schema: str) -> DataFrame:
    """left has the column shard; right (queries, by ``key``) meets it in blocks. search gets the Arrow tables."""
    ship(left.sparkSession)
    one = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    two = right.withColumn("block", dealt(key, blocks, 2)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return one.groupBy("shard", "block").cogroup(two.groupBy("shard", "block")).applyInArrow(search, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best of what the shards found."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
