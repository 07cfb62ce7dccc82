"""Set operations on rows, and tables that take in new rows by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_by_key(keys: list[str], *parts: DataFrame) -> DataFrame:
    """The rows of all parts, one for each key; of several the last part's."""
    numbered = [p.withColumn("part_", F.lit(i)) for i, p in enumerate(parts)]
    every = reduce(lambda a, b: a.unionByName(b), numbered)
    rest = [c for c in parts[0].columns if c not in keys]
    best = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("part_", *rest)).alias("row_")) if rest else every.select(*keys).distinct()
    return best.select(*keys, *[F.col(f"row_.{c}").alias(c) for c in rest]).select(*parts[0].columns)


def multiset_difference(current: DataFrame, candidate: DataFrame, by: list[str]) -> DataFrame:
    """by, n_current, n_candidate, added, removed: how often each row is on either side, where that differs."""
    both = current.select(*by, F.lit(1).alias("c"), F.lit(0).alias("d")).unionByName(candidate.select(*by, F.lit(0).alias("c"), F.lit(1).alias("d")))
    n = both.groupBy(*by).agg(F.sum("c").alias("n_current"), F.sum("d").alias("n_candidate"))
    more = F.col("n_candidate") - F.col("n_current")
    return n.where(more != 0).withColumns({"added": F.greatest(more, F.lit(0)), "removed": F.greatest(-more, F.lit(0))})


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and those of ``rows`` whose key it doesn't have; of rows with one key the first by their values."""
    rest = [c for c in table.columns if c not in keys]
    fresh = rows.join(table, keys, "left_anti").groupBy(*keys).agg(F.min(F.struct(*rest)).alias("row_"))
    return table.unionByName(fresh.select(*keys, *[F.col(f"row_.{c}").alias(c) for c in rest]))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], rules: dict[str, str] | None = None) -> DataFrame:
    """``table`` with ``rows`` taken in by key, a key once in either. rules tell what a column of a key in both
    becomes: replace (the new value, null too; the default), keep (the new one unless null) or fill
    (the old one unless null or empty)."""
    rules = rules or {}
    old, new = table.withColumn("old_", F.lit(True)).alias("o"), rows.select(*table.columns).withColumn("new_", F.lit(True)).alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys])

    def pick(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        met = {"replace": n, "keep": F.coalesce(n, o), "fill": F.when(o.isNull() | (o.cast("string") == ""), n).otherwise(o)}[rules.get(c, "replace")]
        return F.when(F.col("o.old_").isNull(), n).when(F.col("n.new_").isNull(), o).otherwise(met).alias(c)

    return old.join(new, on, "full").select(*[pick(c) if c not in keys else F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in table.columns])


def keep_listed(table: DataFrame, kept: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is listed, rows to remove)."""
    listed = kept.select(key).distinct()
    return table.join(listed, key, "left_semi"), table.join(listed, key, "left_anti")


def reconcile(existing: DataFrame, incoming: DataFrame, key: str, id_col: str) -> DataFrame:
    """Each natural key of either side with its state: matched, orphaned (existing only) or created (incoming only);
    id is the existing row's. Of rows that repeat a key the one with the smallest id counts."""
    old = existing.groupBy(F.col(key)).agg(F.min(id_col).alias("id"))
    new = incoming.select(key).distinct().withColumn("in_", F.lit(True))
    both = old.join(new, key, "full")
    state = F.when(F.col("id").isNull(), "created").when(F.col("in_").isNull(), "orphaned").otherwise("matched")
    return both.select(key, "id", state.alias("state"))


def session_key(label: str, start: str, end: str) -> Column:
    """The natural key of a session: its label in lower case without outer spaces, and its days."""
    day = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws("|", F.lower(F.trim(F.coalesce(F.col(label), F.lit("")))), day(start), day(end))


def matching_any(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose composite key is one of ``wanted``."""
    return rows.join(wanted.select(*keys).distinct(), keys, "left_semi")


def owned_within(runs: DataFrame, key: str, ids: str, owners: DataFrame, owner_id: str, group: str, allowed: list[str]) -> DataFrame:
    """Runs whose ids belong to some groups, all of them among ``allowed``."""
    each = runs.select(key, F.explode(F.array_distinct(ids)).alias(owner_id)).join(owners.select(owner_id, group), owner_id)
    told = each.groupBy(key).agg(F.bool_and(F.col(group).isin(allowed) if allowed else F.lit(False)).alias("fine_"))
    return runs.join(told.where("fine_").select(key), key, "left_semi")
