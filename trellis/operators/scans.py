"""Running values over an order, for keys of any size.

A window puts all rows of a key, or of a table without one, in one task. Here rows are dealt over ranges of their key and order, so
that a large key spans several; a window runs within each range, and what the ranges before hold in all is
carried in. Carries are needed only where a key goes on in another range: a row for each range at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.operators.keep import written

#: how a running value is made: summed up, or the largest so far
SUM, MAX = "sum", "max"
_MADE: dict[str, Callable] = {SUM: F.sum, MAX: F.max}


def in_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], keep=written) -> DataFrame:
    """``rows``, written, with part_: the number of a row's range. Ranges are those of the keys, then the order."""
    return keep(rows.repartitionByRange(*map(F.col, keys), *order).withColumn("part_", F.spark_partition_id()))


def same_keys(keys: Sequence[str]) -> Column:
    """What a row and its range's carry have in common; the carry's columns end in _c."""
    same = F.col("part_") == F.col("part_c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_c"))
    return same


def carried(dealt: DataFrame, keys: Sequence[str], totals: Sequence[Column], carries: Callable) -> DataFrame:
    """Of each key that spans ranges: part_c, the keys (named with _c) and what carries(window over its ranges) makes of the totals."""
    each = dealt.groupBy("part_", *keys).agg(*totals)
    whole, order = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("part_")
    made = each.withColumn("spans_", F.count(F.lit(1)).over(whole)).where("spans_ > 1").withColumns(carries(order))
    names = {"part_": "part_c"} | {k: f"{k}_c" for k in keys}
    return made.drop("spans_").withColumnsRenamed(names)


def running(dealt: DataFrame, keys: Sequence[str], order: Sequence[Column], values: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """``dealt``, which in_ranges() gave for these keys and this order, with a column for each of ``values``: the sum or the largest of its
    column up to the row, or up to the one before; null where there is none.

    The order tells the rows of a key apart."""
    here = W.partitionBy("part_", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)
    totals = [_MADE[kind](c).alias(f"{n}_t") for n, (kind, c) in values.items()]
    past = lambda w: {f"{n}_c": _MADE[kind](f"{n}_t").over(w.rowsBetween(W.unboundedPreceding, -1)) for n, (kind, _) in values.items()}
    carry = carried(dealt, keys, totals, past).drop(*[f"{n}_t" for n in values])
    # at most two rows for each range, however many rows there are
    out = dealt.withColumns({n: _MADE[kind](c).over(here) for n, (kind, c) in values.items()}).join(F.broadcast(carry), same_keys(keys), "left")
    whole = {n: F.greatest(n, f"{n}_c") if kind == MAX else F.when(F.col(n).isNotNull() | F.col(f"{n}_c").isNotNull(), F.coalesce(n, F.lit(0)) + F.coalesce(f"{n}_c", F.lit(0))) for n, (kind, _) in values.items()}
    return out.withColumns(whole).drop("part_c", *[f"{k}_c" for k in keys], *[f"{n}_c" for n in values])


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, keep=written) -> DataFrame:
    """``rows`` with a row's number within its key, from 1, as a long. Rows that the order doesn't tell apart get numbers in any order."""
    dealt = in_ranges(rows, keys, order, keep)
    return running(dealt, keys, order, {name: (SUM, F.lit(1).cast("long"))}).drop("part_")
