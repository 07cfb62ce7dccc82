"""Counts, shares, rates and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.values import half_up, ratio, whole_percent


def since(moment: str, as_of: str, days: int) -> Column:
    """Later than so many days before as_of."""
    return F.col(moment).cast("timestamp") > F.expr(f"timestamp'{as_of}' - interval {int(days)} days")


def covered_share(rows: DataFrame, covered: Column, keys: list[str] = ()) -> DataFrame:
    """total, covered and percent (whole, 0 of nothing) for each key, or for all rows."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(covered).alias("covered"))
    return counted.withColumn("percent", whole_percent("covered", "total"))


def approval(rows: DataFrame, name: str, value: str, approved: str, rejected: str) -> DataFrame:
    """One row: the sums of two metrics and the first's share of both."""
    total = lambda n: F.coalesce(F.sum(F.when(F.col(name) == n, F.col(value)).otherwise(0)), F.lit(0)).alias(n)
    sums = rows.where(F.col(name).isin(approved, rejected)).agg(total(approved), total(rejected))
    return sums.withColumn("rate", ratio(F.col(approved), F.col(approved) + F.col(rejected)))


def mean_of(rows: DataFrame, value: str) -> DataFrame:
    return rows.agg(half_up(F.coalesce(F.avg(value), F.lit(0.0))).alias("mean"))


def rate_by(rows: DataFrame, key: Column | str, hit: Column, most: int = 10, name: str = "key") -> DataFrame:
    """total, hits and rate of each key that isn't null; the ``most`` with the most hits, ties by key."""
    key = F.col(key) if isinstance(key, str) else key
    counted = rows.select(key.alias(name), hit.alias("hit_")).where(F.col(name).isNotNull())
    counted = counted.groupBy(name).agg(F.count(F.lit(1)).alias("total"), F.count_if("hit_").alias("hits"))
    return counted.withColumn("rate", ratio("hits", "total")).orderBy(F.desc("hits"), F.asc(name)).limit(most)


def hourly(rows: DataFrame, moment: str, since_: str, until: str, name: str = "n") -> DataFrame:
    """Rows of each hour with any, from since_ (included) to until (excluded)."""
    inside = rows.where((F.col(moment).cast("timestamp") >= F.lit(since_).cast("timestamp")) & (F.col(moment).cast("timestamp") < F.lit(until).cast("timestamp")))
    return inside.groupBy(F.date_trunc("hour", F.col(moment).cast("timestamp")).alias("hour")).agg(F.count(F.lit(1)).alias(name))


def merged_series(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """Two series side by side; 0 where one of them has nothing."""
    return left.join(right, key, "full").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in (left_name, right_name)])


def per_hour(total: Column, since_: str, until: str) -> Column:
    """A rate over all the hours between, an hour at least; quiet hours count."""
    span = (F.unix_timestamp(F.lit(until).cast("timestamp")) - F.unix_timestamp(F.lit(since_).cast("timestamp"))) / 3600.0
    return total / F.greatest(F.lit(1.0), span)


def latest_by_field(rows: DataFrame, field: str, moment: str, name: str) -> DataFrame:
    return rows.groupBy(field).agg(F.max(moment).alias(name))


def most_frequent(rows: DataFrame, key: str, most: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(most)


def fan_out_mean(rows: DataFrame, keys: list[str], inner: str, value: str) -> DataFrame:
    """Means of ``value`` for each key: ``weighted`` counts every row once for each row of its inner key, as a join of
    the rows with themselves would; ``plain`` counts rows once. No such join is made."""
    each = rows.groupBy(*keys, inner).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.count(F.lit(1)).alias("of"))
    sums = each.groupBy(*keys).agg(F.sum(F.col("of") * F.col("s")).alias("ws"), F.sum(F.col("of") * F.col("n")).alias("wn"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select(*keys, half_up(F.col("ws") / F.col("wn")).alias("weighted"), half_up(F.col("s") / F.col("n")).alias("plain"))


def ingestion_summary(rows: DataFrame, status: str, threshold: float) -> DataFrame:
    """One row: counts of ok, skip and error, the failures' share (0 of nothing) and whether that fails the run:
    more than the threshold, or rows but none that went well."""
    n = lambda s: F.count_if(F.col(status) == s)
    out = rows.agg(F.count(F.lit(1)).alias("total"), n("ok").alias("ok"), n("skip").alias("skipped"), n("error").alias("errors"))
    out = out.withColumn("failure_ratio", F.when(F.col("total") > 0, F.col("errors") / F.col("total")).otherwise(F.lit(0.0)))
    return out.withColumn("failed", ((F.col("total") > 0) & (F.col("ok") == 0)) | (F.col("failure_ratio") > threshold))


def run_status(processed: Column, errors: Column) -> Column:
    """FAILED only if everything that was processed went wrong."""
    return F.when((processed > 0) & (errors == processed), "FAILED").otherwise("COMPLETED")


def field_coverage(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, n, fraction: rows in which a field is neither null nor empty, of each key. One pass."""
    filled = [F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != "")).alias(f) for f in fields]
    wide = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("of_"), *filled)
    long = wide.unpivot([*keys, "of_"], fields, "field", "n")
    return long.select(*keys, "field", "n", ratio("n", "of_").alias("fraction"))


def regressions(before: DataFrame, after: DataFrame, keys: list[str], value: str, least: float = 0.6) -> DataFrame:
    """Series before and after: dropped where less than ``least`` of the former is left (never from 0), gone where
    nothing is."""
    both = before.select(*keys, F.col(value).alias("before")).join(after.select(*keys, F.col(value).alias("after")), keys, "full")
    both = both.select(*keys, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    fell = (F.col("before") != 0) & (F.col("after") / F.col("before") < least)
    return both.withColumns({"dropped": F.coalesce(fell, F.lit(False)), "gone": (F.col("before") > 0) & (F.col("after") == 0)})


def threshold_sweep(rows: DataFrame, confidence: str, approved: Column, class_: str, passes: Column, thresholds: list[float]) -> DataFrame:
    """threshold, class, passed, precision (null where nothing passes) and coverage (of all rows), for every threshold
    and class that occurs. Conditional counts in one pass; nothing is joined."""
    sums = [F.count(F.lit(1)).alias("of_")]
    for i, t in enumerate(thresholds):
        over = passes & (F.col(confidence) >= t)
        sums += [F.count_if(over).alias(f"p{i}"), F.count_if(over & approved).alias(f"a{i}")]
    each = rows.groupBy(class_).agg(*sums)
    all_ = rows.agg(F.count(F.lit(1)).alias("all_"))
    long = each.select(class_, F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"p{i}").alias("passed"), F.col(f"a{i}").alias("approved")) for i, t in enumerate(thresholds)])).alias("x"))
    long = long.select(class_, "x.*").crossJoin(F.broadcast(all_))  # one row
    precision = F.when(F.col("passed") > 0, F.col("approved") / F.col("passed"))
    return long.select("threshold", class_, "passed", precision.alias("precision"), (F.col("passed") / F.col("all_")).alias("coverage"))


def transitions(rows: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """keys, moves: how often each change of state occurs, as a map "before>after" -> count."""
    counted = rows.groupBy(*keys, F.concat_ws(">", before, after).alias("move_")).agg(F.count(F.lit(1)).alias("n_"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("move_", "n_")))).alias("moves"))


def counted_for(rows: DataFrame, keys: DataFrame, key: str, name: str = "n") -> DataFrame:
    """How many rows each of ``keys`` has; 0 for none."""
    return keys.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def mean_confidence(values: Column) -> Column:
    """The mean of an array to two decimals, 0 of an empty one."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, half_up(total / F.size(values))).otherwise(F.lit(0.0))
