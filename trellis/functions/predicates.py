"""Filters of directory queries. Each gives a Column; an argument that is left out filters nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.functions.values import ColumnOrName, _col, whole_days

EVERYTHING = "ALL"


def all_of(*filters: Column | None) -> Column:
    """All the filters that are given."""
    return reduce(lambda a, b: a & b, [f for f in filters if f is not None], F.lit(True))


def equals(c: ColumnOrName, value: object | None) -> Column | None:
    return None if value is None or value == EVERYTHING else _col(c) == value


def in_scope(c: ColumnOrName, allowed: list[str] | None) -> Column | None:
    """A reader's communities; without any there is no restriction."""
    return _col(c).isin(allowed) if allowed else None


def in_strict_scope(c: ColumnOrName, allowed: str | list[str] | None) -> Column | None:
    """As in_scope(), but an empty list lets nothing through, and one text means just that one."""
    if allowed is None:
        return None
    return _col(c) == allowed if isinstance(allowed, str) else (_col(c).isin(allowed) if allowed else F.lit(False))


def mentions(query: str | None, *columns: ColumnOrName) -> Column | None:
    """The columns' texts, joined by spaces, hold the query in upper or lower case; a null text is empty."""
    if not query:
        return None
    joined = F.concat_ws(" ", *[F.coalesce(_col(c), F.lit("")) for c in columns])
    return F.lower(joined).contains(query.lower())


def overlaps(items: ColumnOrName, lo: str, hi: str, least: float | None, most: float | None, low: float = 0, high: float = 99) -> Column | None:
    """Some item's [lo, hi] meets [least, most]. Open ends reach to low and high; bounds of 0 count as none."""
    if not least and not most:
        return None
    return F.exists(_col(items), lambda x: (F.coalesce(x[lo], F.lit(low)) <= (most if most is not None else high)) & (F.coalesce(x[hi], F.lit(high)) >= (least if least is not None else low)))


def has_member(items: ColumnOrName, value: object | None) -> Column | None:
    return None if not value else F.coalesce(F.array_contains(_col(items), value), F.lit(False))


def lowest(items: ColumnOrName, field: str) -> Column:
    return F.array_min(F.transform(_col(items), lambda x: x[field]))


def costs_at_most(items: ColumnOrName, field: str, cap: float | None) -> Column | None:
    """The lowest price is within the cap, or there is no price. A cap of 0 counts as none."""
    return None if not cap else F.coalesce(lowest(items, field) <= cap, F.lit(True))


def some_item_is(items: ColumnOrName, field: str, value: object | None) -> Column | None:
    return None if not value else F.coalesce(F.exists(_col(items), lambda x: x[field] == value), F.lit(False))


def due_soon(day: ColumnOrName, as_of: str, days: int = 7) -> Column:
    start = F.lit(as_of).cast("date")
    return _col(day).cast("date").between(start, F.date_add(start, days))


def archived(c: ColumnOrName, state: str = "active") -> Column | None:
    """state: active, archived or all."""
    return {"active": _col(c).isNull(), "archived": _col(c).isNotNull()}.get(state)


def is_blank(c: ColumnOrName) -> Column:
    return _col(c).isNull() | (_col(c) == "")


def missing_count(*gaps: Column) -> Column:
    """How many of the conditions hold; null counts as not."""
    return reduce(lambda a, b: a + b, [F.when(g, 1).otherwise(0) for g in gaps])


def name_like(c: ColumnOrName, text: str | None) -> Column | None:
    """The name holds the text, in upper or lower case; % and _ are ordinary characters in it."""
    return None if not text else F.coalesce(F.lower(_col(c)).contains(text.lower()), F.lit(False))


def with_prefix(c: ColumnOrName, prefix: str) -> tuple[Column, Column]:
    """Whether the text begins so, and what follows."""
    return _col(c).startswith(prefix), F.substring(_col(c), F.lit(len(prefix) + 1), F.length(_col(c)))


def crawl_priority(as_of: ColumnOrName, verified_at: ColumnOrName, missing: Column, confidence: ColumnOrName, status: ColumnOrName) -> Column:
    """Days since the last check (180 at most, and for none), 30 for each missing field, and what the
    confidence and a coming opening add."""
    stale = F.least(F.lit(180), F.coalesce(whole_days(verified_at, as_of), F.lit(180)))
    doubt = F.when(_col(confidence) == "PLACEHOLDER", 50).when(_col(confidence) == "STALE", 25).otherwise(0)
    return stale + missing * 30 + doubt + F.when(_col(status) == "COMING_SOON", 40).otherwise(0)


def first_or(items: ColumnOrName, scalar: ColumnOrName) -> Column:
    """The array's first element, else the scalar."""
    return F.coalesce(F.try_element_at(_col(items), F.lit(1)), _col(scalar))


def is_on(flag: str | None) -> bool:
    """A switch from the environment: 0, false, off and no mean off, anything else and nothing mean on."""
    return (flag or "").strip().lower() not in ("0", "false", "off", "no")


def quality_is(state: str | None, pending: Column, missing: Column, verified_at: ColumnOrName) -> Column | None:
    """A table's facet of quality: PENDING (something waits for review), MISSING (fields lack), NEVER_VERIFIED; ALL filters nothing."""
    return {"PENDING": pending > 0, "MISSING": missing > 0, "NEVER_VERIFIED": _col(verified_at).isNull()}.get(state or EVERYTHING)


def pending_is(state: str | None, pending: Column) -> Column | None:
    """PENDING or NO_PENDING; a null count is none. ALL filters nothing."""
    n = F.coalesce(pending, F.lit(0))
    return {"PENDING": n > 0, "NO_PENDING": n == 0}.get(state or EVERYTHING)


def crawl_is(state: str | None, crawled_at: ColumnOrName, as_of: ColumnOrName, days: int = 30) -> Column | None:
    """NEVER, or STALE: never, or so many whole days ago. ALL filters nothing."""
    return {"NEVER": _col(crawled_at).isNull(), "STALE": F.coalesce(whole_days(crawled_at, as_of) >= days, F.lit(True))}.get(state or EVERYTHING)
