"""Operators whose result depends on the order of a source's rows.

The state of such a fold goes from row to row. Here it is taken apart into running values and rounds of joins, so that no
source's rows have to come together in one array or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.functions.text import safe_url, stripped_name
from trellis.functions.values import half_up
from trellis.operators.keep import written
from trellis.operators.matching import near_sets
from trellis.operators.scans import MAX, SUM, carried, in_ranges, running, same_keys

_LOCATOR = r"^chars:(\d+)-(\d+)$"


def locator_start(locator: Column) -> Column:
    return F.regexp_extract(locator, _LOCATOR, 1).try_cast("int")


def global_items(rows: DataFrame, source: str = "source", seq: str = "seq", index: str = "item", locator: str = "locator", keep=written) -> DataFrame:
    """``rows`` with global_item: item numbers that go on where a source's numbering starts anew.

    A number that falls while the place in the page doesn't means a new chunk: its numbers are put
    after all those before. A missing number is 0, a missing place -1. boundary: the row began a chunk.
    (source, seq) tells a row.

    Whether the place falls is a matter of the largest so far. Where it doesn't, the largest number so far is from then on the row's own, whether a
    chunk begins or not; so that is the largest since the last such row, and the numbers before a chunk add up. All are running values, over ranges:
    a source of any length is neither an array nor a task."""
    order, own = [F.col(seq)], W.partitionBy("part_", source).orderBy(seq)
    ready = rows.withColumns({"i_": F.coalesce(F.col(index), F.lit(0)).cast("long"), "at_": F.coalesce(locator_start(F.col(locator)), F.lit(-1))})
    dealt = in_ranges(ready, [source], order, keep)
    led = running(dealt, [source], order, {"lead_": (MAX, F.col("at_"))}, before=True)
    led = keep(led.withColumn("head_", F.col("at_") >= F.coalesce("lead_", F.lit(-1))))
    # within a range: the largest number since the last head, the head's own counting
    led = led.withColumn("since_", F.count_if("head_").over(own.rowsBetween(W.unboundedPreceding, W.currentRow)))
    held = F.max("i_").over(W.partitionBy("part_", source, "since_").orderBy(seq).rowsBetween(W.unboundedPreceding, W.currentRow))
    led = keep(led.withColumn("held_", held))
    # at a range's end: that of its last head or, where it has none, also what came before
    last = F.max_by(F.struct(F.col("since_"), F.col("held_")), F.col(seq)).alias("last_")

    def ends(w: W) -> dict[str, Column]:
        heads = F.sum((F.col("last_.since_") > 0).cast("int"))
        return {"run_": heads.over(w.rowsBetween(W.unboundedPreceding, W.currentRow))}

    ended = carried(led, [source], [last], ends)
    so_far = F.max("last_.held_").over(W.partitionBy(f"{source}_c", "run_").orderBy("part_c").rowsBetween(W.unboundedPreceding, W.currentRow))
    into = ended.withColumn("into_", so_far).withColumn("into_", F.lag("into_").over(W.partitionBy(f"{source}_c").orderBy("part_c"))).drop("last_", "run_")
    # a range each at most, as in running()
    led = led.join(F.broadcast(into), same_keys([source]), "left").drop("part_c", f"{source}_c")
    whole = F.when(F.col("since_") == 0, F.greatest("held_", "into_")).otherwise(F.col("held_"))
    most = F.coalesce(F.lag("whole_").over(own), F.col("into_"), F.lit(-1))
    led = led.withColumn("whole_", whole).withColumn("most_", most).withColumn("boundary", F.col("head_") & (F.col("i_") < F.col("most_")))
    led = keep(led.withColumn("over_", F.when(F.col("boundary"), F.col("most_") + 1).otherwise(0)))
    out = running(led, [source], order, {"base_": (SUM, F.col("over_"))})
    return out.select(*rows.columns, (F.col("base_") + F.col("i_")).cast("int").alias("global_item"), "boundary")


def item_scalars(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rows: source, global_item, seq, path, value, confidence, excerpt. One row for each item; of each field the first."""
    first = [F.min_by(F.when(F.col("path") == f, F.col("value")), F.when(F.col("path") == f, F.col("seq"))).alias(f) for f in fields]
    return rows.groupBy("source", "global_item").agg(*first, F.count(F.lit(1)).alias("proposals"), half_up(F.avg("confidence")).alias("confidence"))


def item_rows(rows: DataFrame, family: str, fields: list[str]) -> DataFrame:
    """rows as in item_scalars(), with sub (place within the family, or null). source, global_item, row and the fields.

    Rows that have a place come first, by place; of a field named twice the last counts. The others
    are paired by the order in which each field comes. label is the excerpt of the field that came
    first, confidence the mean."""
    own = rows.where(F.col("path").startswith(f"{family}[].")).withColumn("field", F.element_at(F.split("path", r"\."), -1))
    own = own.where(F.col("field").isin(fields))
    order = W.partitionBy("source", "global_item", "field").orderBy("seq")
    placed = own.where("sub is not null").withColumns({"loose": F.lit(0), "r": F.col("sub").cast("int")})
    loose = own.where("sub is null").withColumns({"loose": F.lit(1), "r": F.row_number().over(order) - 1})
    cells = placed.unionByName(loose).groupBy("source", "global_item", "loose", "r", "field")
    cells = cells.agg(F.max_by(F.struct("value", "confidence", "excerpt"), "seq").alias("v"), F.min("seq").alias("first"))
    found = [F.max(F.when(F.col("field") == f, F.col("v.value"))).alias(f) for f in fields]
    grouped = cells.groupBy("source", "global_item", "loose", "r").agg(*found, F.min_by("v.excerpt", "first").alias("label"), half_up(F.avg("v.confidence")).alias("confidence"))
    number = F.row_number().over(W.partitionBy("source", "global_item").orderBy("loose", "r"))
    return grouped.withColumn("row", number).drop("loose", "r")


def item_tags(rows: DataFrame, family: str) -> DataFrame:
    """The different values of a list of tags of each item, in order of place, then of coming; each with its highest
    confidence."""
    own = rows.where(F.col("path") == f"{family}[]")
    place = F.struct(F.col("sub").isNull().alias("loose"), F.coalesce("sub", "seq").alias("at"))
    last = own.where("sub is not null").groupBy("source", "global_item", "sub").agg(F.max("seq").alias("seq"))
    kept = own.join(last.select("source", "global_item", "seq"), ["source", "global_item", "seq"], "left_semi").unionByName(own.where("sub is null"))
    each = kept.withColumn("place", place).groupBy("source", "global_item", "value").agg(F.min("place").alias("place"), F.max("confidence").alias("confidence"))
    return each.withColumn("n", F.row_number().over(W.partitionBy("source", "global_item").orderBy("place"))).drop("place")


def last_values(rows: DataFrame, keys: list[str], field: str, value: str, seq: str, fields: list[str]) -> DataFrame:
    """One row for each key, a column for each field: its last value."""
    last = [F.max_by(F.when(F.col(field) == f, F.col(value)), F.when(F.col(field) == f, F.col(seq))).alias(f) for f in fields]
    return rows.groupBy(*keys).agg(*last)


def distinct_items(rows: DataFrame, source: str = "source", order: str = "item", name: str = "name", least: float = 0.75, keep=written) -> DataFrame:
    """The rows whose name isn't like that of a row before that stayed, in order, for each source.

    (source, order) tells a row. Links between near names of a source are found by a join, and in rounds every name that no undecided
    one before it is linked with stays, and what is linked with it goes. A page of many names is no array and no task of its own. Names without
    bigrams are like none. ``keep`` cuts the lineage between rounds."""
    # names that are equal go but for the first, whether that stays or not: what it goes for is as like them
    named = rows.select(F.struct(F.col(source).alias("s")).alias("s_"), F.col(order).alias("o_"), stripped_name(name).alias("name_")).where(F.length("name_") >= 2)
    first = keep(named.groupBy("s_", "name_").agg(F.min("o_").alias("o_")))
    names = first.select("s_", "name_")
    met = near_sets(names, names, least, keep=keep).where("x_ <> y_")
    of = lambda n: first.toDF("s_", f"{n}_", f"{n}o")
    links = keep(met.join(of("x"), ["s_", "x_"]).join(of("y"), ["s_", "y_"]).where("xo < yo").select("s_", "xo", "yo"))
    gone = named.join(first.withColumnRenamed("o_", "f_"), ["s_", "name_"]).where("o_ > f_").select("s_", "o_")
    while not links.isEmpty():
        waits = links.select("s_", F.col("yo").alias("xo")).distinct()
        lost = keep(links.join(waits, ["s_", "xo"], "left_anti").select("s_", "yo").distinct())
        gone = gone.unionByName(lost.withColumnRenamed("yo", "o_"))
        links = keep(links.join(lost, ["s_", "yo"], "left_anti").join(lost.withColumnRenamed("yo", "xo"), ["s_", "xo"], "left_anti").select("s_", "xo", "yo"))
    return rows.join(gone, F.struct(F.col(source).alias("s")).eqNullSafe(F.col("s_")) & (F.col(order) == F.col("o_")), "left_anti")


def grounded(value: Column, excerpt: Column, locator: Column) -> Column:
    """A value that stands word for word in its excerpt, which says where it is in the page."""
    value = F.trim(value)
    return F.coalesce((value != "") & excerpt.contains(value) & locator.rlike(_LOCATOR), F.lit(False))


def discovery_items(rows: DataFrame, base_url: str) -> DataFrame:
    """rows: source, seq, item, path (name, detailUrl or snippet), value, excerpt, locator. The items that a page lists:
    source, item, name, detail_url, snippet. Items without a grounded name are dropped, and those whose
    name is like an earlier one's; other fields that aren't grounded become null."""
    numbered = global_items(rows)
    packed = numbered.withColumn("v", F.struct(F.trim("value").alias("value"), "excerpt", "locator"))
    wide = last_values(packed, ["source", "global_item"], "path", "v", "seq", ["name", "detailUrl", "snippet"])
    fine = lambda c: grounded(F.col(f"{c}.value"), F.coalesce(f"{c}.excerpt", F.lit("")), F.col(f"{c}.locator"))
    url = F.col("detailUrl.value")
    linked = F.col("detailUrl.excerpt").contains(F.concat(F.lit("]("), url, F.lit(")"))) & F.col("detailUrl.locator").rlike(_LOCATOR)
    root = F.regexp_extract(F.lit(base_url), r"^(https?://[^/]+)", 1)
    whole = F.when(url.startswith("/"), F.concat(root, url)).otherwise(url)
    items = wide.where(fine("name")).select(
        "source", F.col("global_item").alias("item"), F.col("name.value").alias("name"),
        F.when(linked, safe_url(whole)).alias("detail_url"), F.when(fine("snippet"), F.col("snippet.value")).alias("snippet"),
    )
    return distinct_items(items)
