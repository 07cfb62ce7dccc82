"""Numbers, days, maps and canonical values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def half_up(x: ColumnOrName, digits: int = 2) -> Column:
    """Rounded with halves going up, also below zero (-2.5 gives -2). What no long holds, NaN too, has no decimals to round."""
    scale = float(10**digits)
    y = _col(x) * scale + 0.5
    return F.when(F.abs(y) < 2.0**63, F.floor(y).cast("double")).otherwise(y) / F.lit(scale)


def whole_percent(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """A percentage without decimals; 0 where there is no whole."""
    share = F.floor(_col(part) * 100.0 / _col(whole) + 0.5).cast("int")
    return F.when(_col(whole) > 0, share).otherwise(F.lit(0))


def ratio(part: ColumnOrName, whole: ColumnOrName, digits: int = 2) -> Column:
    """part / whole with so many decimals; 0 where there is no whole."""
    return F.when(_col(whole) > 0, half_up(_col(part).cast("double") / _col(whole), digits)).otherwise(F.lit(0.0))


def days_elapsed(since: ColumnOrName, as_of: ColumnOrName) -> Column:
    """Days between two moments, with fractions."""
    micros = lambda c: F.unix_micros(_col(c).cast("timestamp"))
    return (micros(as_of) - micros(since)) / F.lit(86_400_000_000.0)


def whole_days(since: ColumnOrName, as_of: ColumnOrName) -> Column:
    """Days that have passed in full, cut towards zero; not calendar days, of which 20 minutes across midnight are one."""
    return days_elapsed(since, as_of).cast("int")


def iso_date(c: ColumnOrName) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")


def is_iso_date(text: ColumnOrName) -> Column:
    """True for a text YYYY-MM-DD that is a day of the calendar; false for null."""
    text = _col(text)
    same = F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd") == text
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & same, F.lit(False))


def local_date(moment: ColumnOrName, zone: str = "America/Denver", shown: str = "MMM d, yyyy") -> Column:
    """A moment as a zone's wall clock shows it."""
    return F.date_format(F.from_utc_timestamp(_col(moment).cast("timestamp"), zone), shown)


def local_date_of_text(text: ColumnOrName, zone: str = "America/Denver", shown: str = "MMM d, yyyy") -> Column:
    """As local_date() for texts. A date without time stands for noon UTC, so no zone moves it to another day."""
    text = _col(text)
    noon = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit(" 12:00:00"))).otherwise(text)
    return local_date(F.try_to_timestamp(noon), zone, shown)


def merge_maps(left: ColumnOrName, right: ColumnOrName) -> Column:
    """Both maps' entries; of a key in both, the right one's. A null map counts as empty."""
    empty = lambda c: F.coalesce(_col(c), F.map_filter(_col(c), lambda k, v: F.lit(False)), F.create_map().cast("map<string,string>"))
    left, right = empty(left), empty(right)
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def compact_map(m: ColumnOrName) -> Column:
    """Without the entries whose value is null or the empty string."""
    return F.map_filter(_col(m), lambda k, v: v.isNotNull() & (v != ""))


def sorted_json(m: ColumnOrName) -> Column:
    """A map as JSON with its keys in order, so that equal maps give equal texts."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(_col(m)))))


def content_hash(c: ColumnOrName) -> Column:
    return F.sha2(_col(c).cast("string"), 256)


def value_key(item: Column, fields: list[tuple[str, str]]) -> Column:
    """One text for a struct's (name, type) fields, in this order; whatever else it holds doesn't count.
    Nulls are written out, numbers all in one form."""

    def part(name: str, kind: str) -> Column:
        c = item[name]
        said = {"number": F.to_json(F.struct(c.cast("double").alias("n"))), "date": c.cast("date").cast("string")}.get(kind, c.cast("string"))
        return F.coalesce(F.concat(F.lit("="), said), F.lit("-"))

    quoted = [F.concat(F.lit(f"{name}"), F.regexp_replace(part(name, kind), r"([|\\])", r"\\$1")) for name, kind in fields]
    return F.concat_ws("|", *quoted)


def same_value(a: ColumnOrName, b: ColumnOrName) -> Column:
    """True for values that are one observation: JSON texts compared as written, plain texts without
    the white space around them. Two nulls are the same."""
    return F.trim(_col(a)).eqNullSafe(F.trim(_col(b)))


def format_state(value: ColumnOrName, kind: str | None, allowed: list[str] | None = None) -> Column:
    """valid, invalid or uncheckable, for a value given as JSON text and a kind: string, number, boolean,
    date, enum, enums (an array of enum values), object, array or None (no rule)."""
    value = _col(value)
    if kind is None:
        return F.lit("uncheckable")
    v = F.try_parse_json(value)
    shape = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    is_text = shape == "STRING"
    rule = {
        "string": is_text,
        "number": shape.rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"),
        "boolean": shape == "BOOLEAN",
        "date": is_text & text.rlike(r"^\d{4}-\d{2}-\d{2}"),
        "enum": is_text & text.isin(allowed or []),
        "object": shape.startswith("OBJECT"),
        "array": shape.startswith("ARRAY"),
    }
    if kind == "enums":
        items = F.from_json(value, "array<string>")
        fine = shape.startswith("ARRAY") & F.forall(items, lambda x: F.coalesce(x.isin(allowed or []), F.lit(False)))
    else:
        fine = rule[kind]
    none = value.isNull() | value.isin("", '""', "null")
    return F.when(none, "uncheckable").when(F.coalesce(fine, F.lit(False)), "valid").otherwise("invalid")
