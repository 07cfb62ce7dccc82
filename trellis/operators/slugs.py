"""Unique slugs, as a loop in order gives them, without the loop.

A row takes its slug or, where that is held, the slug with the first number from 2 on that is free. Rows of one slug
take its numbers in turn, so a row's number is its place among them and what had to be skipped before it. Skipped is
what is taken from the start, and what a row of another slug holds by then: only a slug that itself ends in a number can stand in
the way of another, its parent, and only by its first row, which takes the slug as it is unless the parent has come so far before. So each
slug that ends in a number is settled after its parent, and there are as many rounds as numbers at the ends of slugs, two as a rule.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.deploy import ship
from trellis.operators.keep import written
from trellis.operators.scans import SUM, in_ranges, numbered, running

#: A slug that another may come to: its own without the number, and the number. Longer numbers are never reached.
_NUMBERED = r"^(.*)-([2-9]|[1-9][0-9]{1,14})$"


def _parent(slug: str) -> tuple[Column, Column]:
    ends = F.col(slug).rlike(_NUMBERED)
    number = F.regexp_extract(slug, _NUMBERED, 2)
    return F.when(ends, F.regexp_extract(slug, _NUMBERED, 1)), F.when(ends, number.cast("long"))


def _settle(table: pa.Table) -> pa.Table:
    """What of a slug's numbers are skipped: kid holds number k from when came rows of the slug have come; passed numbers
    below k are skipped anyway. In order of k, one after the other."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("k", "came", "passed", "kid")), strict=True))
    skipped, out = 0, []
    for k, came, passed, _ in rows:
        skips = k - passed - skipped > came
        skipped += skips
        out.append(skips)
    slug = table.column("slug_")[0].as_py()
    return pa.table({"slug_": pa.array([slug] * len(rows), pa.string()), "k": pa.array([r[0] for r in rows], pa.int64()), "kid": pa.array([r[3] for r in rows], pa.string()), "skips": pa.array(out, pa.bool_())})


def _skips(rows: DataFrame, taken: DataFrame, keep) -> DataFrame:
    """rows: slug_, g_ (place among all), m_ (place within the slug). slug_, k: the numbers that each slug's rows skip, 1 being the slug itself."""
    parent, number = _parent("slug_")
    bases = keep(rows.groupBy("slug_").agg(F.min("g_").alias("first_")).withColumns({"parent": parent, "k": number}))
    held = taken.select("slug_").where("slug_ is not null").distinct().withColumns({"parent": parent, "k": number})
    holes = held.join(bases.select("slug_"), "slug_", "left_semi").select("slug_", F.lit(1).cast("long").alias("k"))
    holes = keep(holes.unionByName(held.where("parent is not null").select(F.col("parent").alias("slug_"), "k").join(bases.select("slug_"), "slug_", "left_semi")))
    kids = bases.where("parent is not null").select(F.col("slug_").alias("kid"), F.col("parent").alias("slug_"), "k", "first_")
    kids = keep(kids.join(bases.select("slug_"), "slug_", "left_semi").join(holes, ["slug_", "k"], "left_anti"))
    if kids.isEmpty():
        return holes
    # how many of the parent's rows come before a kid's first, and how many numbers below the kid's are taken
    parents = kids.select("slug_").distinct()
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    mine = rows.join(parents, "slug_", "left_semi").select("slug_", F.col("g_").alias("at"), F.lit(1).alias("one"), none("long", "k"), none("string", "kid"))
    theirs = kids.select("slug_", F.col("first_").alias("at"), F.lit(0).alias("one"), "k", "kid")
    came = running(in_ranges(mine.unionByName(theirs), ["slug_"], [F.col("at")], keep), ["slug_"], [F.col("at")], {"came": (SUM, F.col("one"))}).where("one = 0")
    gone = holes.join(parents, "slug_", "left_semi").select("slug_", F.col("k").alias("at"), F.lit(1).alias("one"), none("string", "kid"), none("long", "came"))
    both = gone.unionByName(came.select("slug_", F.col("k").alias("at"), F.lit(0).alias("one"), "kid", "came"))
    passed = running(in_ranges(both, ["slug_"], [F.col("at")], keep), ["slug_"], [F.col("at")], {"passed": (SUM, F.col("one"))}).where("one = 0")
    open_ = keep(passed.select("slug_", F.col("at").alias("k"), "came", "passed", "kid"))
    found, lost = holes, None
    while not open_.isEmpty():
        # a kid's own kids wait until it is known whether it lost its own slug to its parent
        ready = open_.join(open_.select(F.col("kid").alias("slug_")), "slug_", "left_anti")
        if lost is not None:
            ready = ready.join(lost, "slug_", "left").withColumn("passed", F.col("passed") + F.coalesce("lost_", F.lit(0)))
        told = keep(ready.select("slug_", "k", "came", "passed", "kid").groupBy("slug_").applyInArrow(_settle, "slug_ string, k long, kid string, skips boolean"))
        gave = told.where("not skips").select(F.col("kid").alias("slug_"), F.lit(1).alias("lost_"))
        lost = gave if lost is None else lost.unionByName(gave)
        found = found.unionByName(told.where("skips").select("slug_", "k")).unionByName(gave.select("slug_", F.lit(1).cast("long").alias("k")))
        open_ = keep(open_.join(told.select(F.col("slug_"), "k"), ["slug_", "k"], "left_anti"))
    return found


def unique_slugs(rows: DataFrame, slug: str, order: list[Column], taken: DataFrame | None = None, keep=written) -> DataFrame:
    """``rows``, all columns, their slugs unique: each row, in order, takes its slug or, where ``taken`` (one column, of that name) or an
    earlier row holds it, the slug with -2, -3 and so on, the first that none holds. Null slugs stay null.

    The order tells rows apart. No key is one task, however many rows share a slug; ``keep`` cuts the lineage between steps."""
    ship(rows.sparkSession)
    placed = numbered(rows.withColumn("slug_", F.col(slug).cast("string")), [], order, "g_", keep)
    placed = keep(numbered(placed, ["slug_"], [F.col("g_")], "m_", keep))
    own = placed.where("slug_ is not null").select("slug_", "g_", "m_")
    held = taken.select(F.col(slug).cast("string").alias("slug_")) if taken is not None else own.select("slug_").limit(0)
    skips = keep(_skips(own, held, keep))
    # the i-th number that is skipped, k, moves on the rows that come to k - i + 1 or beyond
    at = numbered(skips, ["slug_"], [F.col("k")], "i_", keep).select("slug_", (F.col("k") - F.col("i_") + 1).alias("at"), F.lit(0).alias("row"), F.lit(1).alias("one"), F.col("k").alias("g_"))
    moved = own.join(skips.select("slug_").distinct(), "slug_", "left_semi").select("slug_", F.col("m_").alias("at"), F.lit(1).alias("row"), F.lit(0).alias("one"), "g_")
    by = [F.col("at"), F.col("row"), F.col("g_")]
    moved = running(in_ranges(at.unionByName(moved), ["slug_"], by, keep), ["slug_"], by, {"moved_": (SUM, F.col("one"))}).where("row = 1").select(F.col("g_").alias("g2_"), "moved_")
    number = F.col("m_") + F.coalesce("moved_", F.lit(0))
    final = F.when(number > 1, F.concat("slug_", F.lit("-"), number.cast("string"))).otherwise(F.col("slug_"))
    return placed.join(moved, F.col("g_") == F.col("g2_"), "left").select(*[final.alias(c) if c == slug else F.col(c) for c in rows.columns])
