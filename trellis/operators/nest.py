"""Parents with their children as arrays, and the latest or first few rows of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered(items: Column, *order: Column) -> Column:
    """An array column's place in a sort: nulls last, then by value. Use inside in_order()."""
    return F.struct(*[x for i, c in enumerate(order) for x in (c.isNull().alias(f"n{i}"), c.alias(f"v{i}"))], items.alias("item"))


def in_order(item: Column, *order: Column) -> Column:
    """Aggregate: the group's items as an array, by ``order`` ascending with nulls last."""
    return F.transform(F.sort_array(F.collect_list(ordered(item, *order))), lambda x: x["item"])


def nest(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, list[str], list[str]]]) -> DataFrame:
    """``parents`` with one array for each of ``children``: name -> (rows, their key to the parent, fields, order).

    Children are put together first, one row a parent, so several kinds don't multiply each other.
    A parent without children has an empty array."""
    out = parents
    for name, (rows, to, fields, order) in children.items():
        item = F.struct(*fields)
        packed = rows.groupBy(F.col(to).alias("key_")).agg(in_order(item, *map(F.col, order)).alias(name))
        empty = F.array().cast(packed.schema[name].dataType)
        out = out.join(packed, F.col(key) == F.col("key_"), "left").drop("key_").withColumn(name, F.coalesce(name, empty))
    return out


def nest_through(parents: DataFrame, key: str, links: DataFrame, from_key: str, to_key: str, others: DataFrame, other_key: str, name: str, fields: list[str], order: list[str]) -> DataFrame:
    """As nest(), over a table of links between many parents and many others. Links to none are left out."""
    rows = links.select(F.col(from_key).alias("from_"), F.col(to_key).alias("to_")).distinct().join(others, F.col("to_") == F.col(other_key))
    return nest(parents, key, {name: (rows, "from_", fields, order)})


def with_latest(parents: DataFrame, key: str, rows: DataFrame, to: str, by: list[str], fields: list[str]) -> DataFrame:
    """``parents`` with the fields of each one's latest row (by the columns ``by``, ascending; nulls first),
    nulls where there is none. One aggregation, nothing sorted."""
    latest = rows.groupBy(F.col(to).alias("key_")).agg(F.max_by(F.struct(*fields), F.struct(*by)).alias("latest_"))
    out = parents.join(latest, F.col(key) == F.col("key_"), "left")
    return out.select(*parents.columns, *[F.col(f"latest_.{f}").alias(f) for f in fields])


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first ``most`` rows of each key, with their number as ``rank``."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def first_with_count(rows: DataFrame, keys: list[str], order: list[Column], count: str = "n") -> DataFrame:
    """Each key's first row, with the number of the key's rows. The count is an aggregation of its own, so the
    first row can be found before anything is shuffled whole."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    return first_of_each(rows, keys, order).drop("rank").join(counts, keys)


def neighbours(rows: DataFrame, order: list[Column], key: str, most: int = 500) -> DataFrame:
    """The first ``most`` rows with the key before and after each, as previous_ and next_ columns."""
    w = W.orderBy(*order)
    head = rows.orderBy(*order).limit(most)
    return head.withColumns({f"previous_{key}": F.lag(key).over(w), f"next_{key}": F.lead(key).over(w), "place": F.row_number().over(w)})


def latest_snapshots(rows: DataFrame, source: str, fetched: str, digest: str) -> DataFrame:
    """Snapshots of each source numbered from the newest, ties by the larger hash, as ``rank``."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(source).orderBy(F.desc(fetched), F.desc(digest))))


def by_digest_prefix(rows: DataFrame, digest: str, prefix: str) -> DataFrame:
    """The snapshot with this hash or, if one hash only begins so, that one; else none."""
    found = rows.where(F.col(digest).startswith(prefix))
    one = found.agg(F.count_distinct(digest).alias("n_"), F.count_distinct(F.when(F.col(digest) == prefix, F.col(digest))).alias("exact_"))
    sure = (F.col("n_") == 1) | ((F.col("exact_") == 1) & (F.col(digest) == prefix))
    return found.crossJoin(F.broadcast(one)).where(sure).drop("n_", "exact_")
