"""Spans of patterns in texts, by DataFrame functions only: shared by the scans for secrets and for personal data.

Positions come from cutting a text at its matches: what lies between them and the matches themselves, measured in turn.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.functions.values import let


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: the group that holds the value
    value: int = 0
    #: whether a match stays, once found: a condition on its value
    stays: Callable[[Column], Column] = lambda value: F.lit(True)
    #: what values that mean the same have in common; the span's hash is one of it
    same: Callable[[Column], Column] = lambda value: value
    #: further fields of its spans, made of the value: name, type and how
    more: tuple[tuple[str, str, Callable[[Column], Column]], ...] = ()


#: Matches are measured in blocks of so many: what adds to an array copies it, so blocks keep very long texts cheap.
BLOCK = 256
SPAN = "start:int,order:int,kind:string,end:int,hash:long"


def found(text: Column, kind: Kind, order: int, around: int = 0) -> Column:
    """The spans of a kind in a text, leftmost first and without overlap; in code points, end exclusive.

    With ``around``, spans have so many code points of the text before and after them, too, but no more than
    lie between them and the kind's next match: before, after, and cut_before, cut_after where there is more."""
    fields = SPAN + (",before:string,after:string,cut_before:boolean,cut_after:boolean" if around else "") + "".join(f",{name}:{of}" for name, of, _ in kind.more)
    hits, between = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern)
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.value)) if kind.value else hits
    zipped = [F.slice(between, 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value")]
    parts = F.arrays_zip(*zipped, *[F.slice(between, 2, F.size(hits)).alias("next")] * bool(around))
    none = F.array().cast(f"array<struct<{fields}>>")

    def step(acc: Column, x: Column) -> Column:
        begins = acc["at"] + F.length(x["gap"])
        ends = begins + F.length(x["hit"])
        span = [begins.alias("start"), F.lit(order).alias("order"), F.lit(kind.name).alias("kind"), ends.alias("end"), F.xxhash64(kind.same(x["value"])).alias("hash")]
        if around:
            span += [F.right(x["gap"], F.lit(around)).alias("before"), F.left(x["next"], F.lit(around)).alias("after")]
            span += [(F.length(x["gap"]) > around).alias("cut_before"), (F.length(x["next"]) > around).alias("cut_after")]
        span += [how(x["value"]).alias(name) for name, _, how in kind.more]
        out = F.when(kind.stays(x["value"]), F.concat(acc["out"], F.array(F.struct(*span)))).otherwise(acc["out"])
        return F.struct(ends.alias("at"), out.alias("out"))

    def block(acc: Column, x: Column) -> Column:
        inner = F.aggregate(x, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    def measured(parts: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda i: F.slice(parts, i * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<struct<{fields}>>>").alias("out"))
        return F.flatten(F.aggregate(blocks, start, block)["out"])

    return F.when(text.rlike(kind.pattern), let(parts, measured)).otherwise(none)


def written(spans: Column) -> Column:
    """kind:start:end of the spans by start, then by kind as listed, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def apart_from_base(each: DataFrame) -> DataFrame:
    """each: id_, row_, s (a span), base (whether it is one of the base kinds). Adds free: no base span overlaps it."""
    # both are running values: what comes after is what came before in the reverse order
    forth, back = W.partitionBy("id_", "row_").orderBy("s.start", "s.order"), W.partitionBy("id_", "row_").orderBy(F.desc("s.start"), F.desc("s.order"))
    before = F.max(F.when(F.col("base"), F.col("s.end"))).over(forth.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("s.start"))).over(back.rowsBetween(W.unboundedPreceding, -1))
    return each.withColumn("free", F.coalesce(before <= F.col("s.start"), F.lit(True)) & F.coalesce(after >= F.col("s.end"), F.lit(True)))
