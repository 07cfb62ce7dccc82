"""Sheets: a directory's CSV files, read whole and turned into records, row by row, with errors kept apart."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions import parsers as P
from trellis.functions.text import city_of, has_editorial_marker, is_artifact_name, slug

#: The kind of camp that each kind of file lists.
FILE_KINDS = {"summer": "SUMMER_DAY", "sleepaway": "SLEEPAWAY", "family": "FAMILY", "winter": "WINTER_BREAK", "break": "SCHOOL_BREAK", "virtual": "VIRTUAL"}
#: The days that a column of a winter or break file stands for.
DATED_COLUMNS = {
    "winter": (
        ("Dec 22-26 (Holiday Week)", "2026-12-22", "2026-12-26"),
        ("Dec 29-Jan 2 (Holiday Week)", "2026-12-29", "2027-01-02"),
        ("Dec 30-31", "2026-12-30", "2026-12-31"),
        ("Jan 2-3", "2027-01-02", "2027-01-03"),
        ("Jan 5-7", "2027-01-05", "2027-01-07"),
    ),
    "break": (
        ("January 19th - MLK day", "2026-01-19", "2026-01-19"),
        ("Feb 16th - President's Day", "2026-02-16", "2026-02-16"),
        ("Feb 27th - Prof dev day", "2026-02-27", "2026-02-27"),
        ("May 1 - Prof dev day", "2026-05-01", "2026-05-01"),
    ),
}
#: Lines of a file among which its header is looked for.
HEADER_LINES = 5


def header_line(lines: Sequence[str]) -> int:
    """Which of a file's first lines is the header: the first that names a column "Name"; 0 if none does."""
    for i, line in enumerate(lines[:HEADER_LINES]):
        if '"Name"' in line or ",Name," in line:
            return i
    return 0


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as strings, trimmed. Cells may hold line breaks, rows may be short, lines before the header are left
    out; empty rows are dropped."""
    lines = [r.value for r in spark.read.text(path).limit(HEADER_LINES).collect()]  # five lines at most
    at = header_line(lines)
    options = {"multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "mode": "PERMISSIVE"}
    raw = spark.read.options(**options).csv(path)
    names: list[str] = []
    for i, cell in enumerate(next(csv.reader(line + "\n" for line in lines[at:]), [])):
        name = cell.strip().lstrip("\ufeff") or f"_c{i}"
        names.append(f"{name} ({i})" if name in names else name)
    rows = raw.select(*[F.col(c).alias(n) for c, n in zip(raw.columns, names, strict=False)])
    of = lambda c: F.col(f"`{c}`")
    is_header = reduce(lambda a, b: a & b, [F.coalesce(F.ltrim(of(n), F.lit("\ufeff")) == n, F.lit(False)) for n in names if not n.startswith("_c")][:3])
    for line in csv.reader(lines[:at]):  # what stands before the header
        cells = [F.coalesce(F.ltrim(of(n), F.lit("\ufeff")), F.lit("")) == c.strip().lstrip("\ufeff") for n, c in zip(rows.columns, line, strict=False)]
        is_header = is_header | reduce(lambda a, b: a & b, cells, F.lit(True))
    empty = F.coalesce(*[F.nullif(of(c), F.lit("")) for c in rows.columns]).isNull()
    return rows.where(~is_header & ~empty)


def find_column(columns: Sequence[str], *wanted: str) -> str | None:
    """The column meant by one of the names: as written, else in other case, else as a part; names in order."""
    low = {c.lower(): c for c in reversed(columns)}
    for name in wanted:
        if name in columns:
            return name
    for name in wanted:
        if name.lower() in low:
            return low[name.lower()]
    return next((c for name in wanted for c in columns if name.lower() in c.lower()), None)


def _cell(rows: DataFrame, *wanted: str) -> Column:
    found = find_column(rows.columns, *wanted)
    return F.coalesce(F.col(f"`{found}`"), F.lit("")) if found else F.lit("")


def _ages(rows: DataFrame) -> Column:
    """The cell for ages or, where that has none, what the columns of single grades say."""
    said = P.age_groups(_cell(rows, "Ages/Grades", "ages/grades"))
    grades = [c for c in rows.columns if c not in ("Ages/Grades",) and any(w in c.lower() for w in ("prek", "pre-k", "kindergarten", " grade"))]
    marks = F.filter(F.array(*[P.column_age_group(c, F.col(f"`{c}`")) for c in grades]), lambda g: g.isNotNull()) if grades else F.array().cast(f"array<{P.AGE_GROUP}>")
    found = F.when(F.size(said) > 0, said).otherwise(P.merged_age_groups(marks))
    return F.filter(found, lambda g: ~has_editorial_marker(g["label"]))


def _sessions(rows: DataFrame, kind: str, times: Column, early: Column, late: Column) -> Column:
    if kind == "summer":
        found = [next((c for c in rows.columns if label in c or label.replace("-", "–") in c), None) for label, _, _ in P.season_weeks()]
        return P.week_sessions([F.col(f"`{c}`") if c else F.lit("") for c in found], times, early, late)
    if kind in ("sleepaway", "family"):
        return P.run_sessions(_cell(rows, "Weeks Run"), times)
    return P.marked_sessions([(_cell(rows, name), name, a, b) for name, a, b in DATED_COLUMNS.get(kind, ())], times, early, late)


def normalise(rows: DataFrame, kind: str) -> DataFrame:
    """One record for each row, with status ok, skip (no name, or a row of notes) or error (the name is no name).

    kind: one of FILE_KINDS. Records of rows that aren't ok are filled in too, but not meant for use."""
    name = F.trim(_cell(rows, "Name", "name"))
    description = _cell(rows, "Description")
    listed = P.category(_cell(rows, "Category"))
    times = P.hours(_cell(rows, "Hours"))
    early = P.early_care(_cell(rows, "Early Drop Off (8-9 am) Y/N or time", "Early Drop Off"))
    late = P.late_care(_cell(rows, "Late Pick up (after 4) (Y/N or latest time)", "Late Pick up"))
    address = _cell(rows, "Location")
    opening = P.registration_opening(_cell(rows, "Registration Date"))
    released = F.lower(_cell(rows, "2025 Info Released Yet?", "2024 Info Released Yet?", "2025/2026 Info Released Yet?"))
    note = F.lower(name).contains("2026 notes") | F.lower(name).contains("updater")
    status = F.when((name == "") | note, "skip").when(is_artifact_name(name), "error").otherwise("ok")
    return rows.select(
        status.alias("status"), name.alias("name"), slug(name).alias("slug"), F.lit(FILE_KINDS[kind]).alias("camp_type"),
        F.when(listed == "OTHER", P.category_of_text(name, description)).otherwise(listed).alias("category"),
        description.alias("description"), F.nullif(_cell(rows, "Notes"), F.lit("")).alias("notes"),
        _cell(rows, "Link").alias("website_url"), F.nullif(_cell(rows, "Interesting Camp Sessions"), F.lit("")).alias("details"),
        F.coalesce(city_of(address), F.lit("Denver")).alias("city"), _cell(rows, "Part of Town").alias("neighborhood"), address.alias("address"),
        _cell(rows, "Lunch").rlike("(?i)yes|included|provided").alias("lunch_included"),
        P.registration_status(_cell(rows, "Registration Status")).alias("registration_status"),
        opening["date"].alias("opens_on"), opening["time"].alias("opens_at"),
        F.when(released.isin("y", "yes"), "VERIFIED").otherwise("PLACEHOLDER").alias("confidence"),
        _ages(rows).alias("age_groups"), _sessions(rows, kind, times, early, late).alias("sessions"),
        P.prices(_cell(rows, "Cost Per Week, if Blue 2025 info", "Cost Per Week"), _cell(rows, "Discounts Offered")).alias("prices"),
    )


def ingested(records: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records to add, counts by status). Records whose slug exists, or comes a second time, are skipped."""
    ok = records.where("status = 'ok'")
    first = ok.groupBy("slug").agg(F.min_by(F.struct(*[c for c in ok.columns if c != "slug"]), "name").alias("r_")).select("slug", "r_.*").select(*records.columns)
    fresh = first.join(existing.select("slug"), "slug", "left_anti").select(*records.columns)
    return fresh, records.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
