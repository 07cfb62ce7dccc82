"""Connected components of a table of links, by alternating large and small stars.

Nothing is gathered: each round is two aggregations and two joins over the links, and the number of
rounds grows with the logarithm of the longest chain. A node with very many links is only ever a
join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.shared import discard, materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node that can be reached; only nodes that are linked to another appear.
    Nulls and links of a node to itself count for nothing; repeated links count once."""
    now = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    now = materialize(now, "links")
    while True:
        then = materialize(_small_star(_large_star(now).where("a <> b").distinct()).where("a <> b").distinct(), "links")
        discard(now)
        now = then
        # done once no node that is pointed to points on, and each node points to one
        on = now.select(F.col("b").alias("a")).distinct().join(now, "a", "left_semi").limit(1).count()
        if not on and not now.groupBy("a").count().where("count > 1").limit(1).count():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
