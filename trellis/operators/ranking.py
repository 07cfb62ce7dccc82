"""Orders, pages and ends of lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.operators.keep import written
from trellis.operators.scans import in_ranges


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset to offset + limit of the order, which must end in a unique key. total() counts them all. One task takes that many
    rows: for pages far from the first there is in_pages()."""
    return rows.orderBy(*order).offset(offset).limit(limit)


@dataclass(frozen=True)
class Pages:
    """A table dealt over ranges of an order, with how many rows each has: any page reads the ranges that hold it, however deep it is."""

    dealt: DataFrame
    order: tuple[Column, ...]
    counts: tuple[tuple[int, int], ...]

    def ranges(self, limit: int, offset: int = 0) -> tuple[list[int], int]:
        """The ranges that hold the rows, and how many rows of those come before them."""
        found, before, skipped = [], 0, 0
        for part, n in self.counts:
            if before + n <= offset:
                skipped += n
            elif before < offset + limit:
                found.append(part)
            before += n
        return found, offset - skipped

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        parts, skip = self.ranges(limit, offset)
        return self.dealt.where(F.col("part_").isin(parts)).drop("part_").orderBy(*self.order).offset(skip).limit(limit)


def in_pages(rows: DataFrame, order: list[Column], keep=written) -> Pages:
    """Deals ``rows`` once for many pages. The order must end in a unique key; there are as many ranges as a shuffle has partitions, and only their
    counts come to the driver."""
    dealt = in_ranges(rows, [], order, keep)
    counts = dealt.groupBy("part_").agg(F.count(F.lit(1)).alias("n")).collect()
    return Pages(dealt, tuple(order), tuple(sorted((r.part_, r.n) for r in counts)))


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))


def both_ends(rows: DataFrame, value: str, key: str, most: int, lead: list[Column] = ()) -> DataFrame:
    """The ``most`` rows with the highest and the ``most`` with the lowest values, each row once. Ties by key."""
    high = rows.orderBy(*lead, F.desc_nulls_last(value), key).limit(most)
    low = rows.orderBy(*lead, F.asc_nulls_last(value), key).limit(most)
    return high.unionByName(low).dropDuplicates([key])


def verified_first(verified: Column, *order: Column) -> list[Column]:
    """Verified rows come first, in either part the order stays; no row is dropped."""
    return [F.when(verified, 0).otherwise(1).asc(), *order]


def by_rank(c: str, ranks: list[str], otherwise: int = 100) -> Column:
    """A sort key: the place in a list, and a late one for values that aren't in it."""
    found = F.lit(otherwise)
    for i, value in reversed(list(enumerate(ranks))):
        found = F.when(F.col(c) == value, i).otherwise(found)
    return found


def ranked_items(items: Column, ranks: dict[str, int], otherwise: int = 100) -> Column:
    """An array of names by rank, then by name."""
    known = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    placed = F.transform(items, lambda f: F.struct(F.coalesce(F.try_element_at(known, f), F.lit(otherwise)).alias("r"), f.alias("f")))
    return F.transform(F.sort_array(placed), lambda x: x["f"])


def opening_soon(rows: DataFrame, status: str, opens: str, as_of: str, key: str, most: int = 6) -> DataFrame:
    """Rows that are coming soon and don't open by as_of; soonest first, without a day last."""
    ahead = (F.col(status) == "COMING_SOON") & (F.col(opens).isNull() | (F.col(opens) > F.lit(as_of)))
    return rows.where(ahead).orderBy(F.asc_nulls_last(opens), key).limit(most)


def picked(rows: DataFrame, key: str, wanted: list[str], most: int = 3) -> DataFrame:
    """The rows of up to ``most`` wanted keys, in the order of the list, as place; unknown ones are left out."""
    spark = rows.sparkSession
    first = list(dict.fromkeys(wanted))[:most]
    place = spark.createDataFrame([(k, i) for i, k in enumerate(first)], "key_ string, place int")
    return rows.join(F.broadcast(place), F.col(key) == F.col("key_")).drop("key_").orderBy("place")  # of ``most`` rows


#: How pressing a field is in a review, from 0.
FIELD_RANKS = {
    "name": 0, "registrationStatus": 1, "description": 2, "websiteUrl": 3, "city": 4, "neighborhood": 5, "address": 6,
    "ageGroups": 7, "schedules": 8, "pricing": 9,
}


#: So many hosts are visited at once, and at most.
AT_ONCE, AT_MOST = 3, 10


def by_host(rows: DataFrame, host: str, order: list[Column], at_once: int = AT_ONCE) -> DataFrame:
    """``rows`` with turn, their place within their host. A host's rows lie together and in order in one partition, and
    there are ``at_once`` partitions, AT_MOST at most: so no more hosts are visited at once by what maps
    over the partitions, and no host twice at a time. The number is one of politeness, not of size."""
    turn = F.row_number().over(W.partitionBy(host).orderBy(*order))
    dealt = rows.withColumn("turn", turn).repartition(max(1, min(at_once, AT_MOST)), host)
    return dealt.sortWithinPartitions(host, "turn")
