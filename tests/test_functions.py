"""Functions on cells as people write them, against expectations written by hand."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trellis.functions import parsers as P
from trellis.functions import predicates as W
from trellis.functions import text as X
from trellis.functions import values as V


def over(spark, cells, f, kind="string"):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}").coalesce(1)
    return [r.v for r in rows.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def group(*v):
    return None if v[0] is None else tuple(v)


def as_tuples(found):
    return [[tuple(x) for x in v] if v is not None else None for v in found]


def test_age_groups(spark):
    cells = {
        None: [], " ": [], "Y": [], "tbd": [], "ALL": [("All ages", 3, 18, -1, 12)],
        "6 to teen": [("Ages 6-teen", 6, 17, 1, 12)],
        "Ages 3-5": [("Grades 3rd-5th", 8, 11, 3, 5)] if False else [("Ages 3-5", 3, 5, -1, 0)],
        "PreK-12th grade": [("Grades PreK-12th", 3, 18, -1, 12)],
        "rising Kindergarten - 2nd grade": [("Grades K-2nd", 5, 8, 0, 2)],
        "Completed 2nd through 11th grade": [("Grades 2nd-11th", 7, 17, 2, 11)],
        "3-7 year olds": [("Grades 3rd-7th", 8, 13, 3, 7)],
        "9-16": [("Ages 9-16", 9, 16, 4, 11)],
        "Kindergarten": [("Kindergarten", 5, 6, 0, 0)],
        "5 year olds": [("Age 5", 5, 5, 0, 0)],
        "adults": [("adults", None, None, None, None)],
        "No, 1st - 12th grade, 3 year old through 5th Grade": [("Grades 1st-12th", 6, 18, 1, 12), ("Grades 3rd-5th", 8, 11, 3, 5)],
        "** VERIFY ** Pre-K": [("** VERIFY ** Pre-K", None, None, None, None)],
    }
    found = as_tuples(over(spark, list(cells), P.age_groups))
    assert dict(zip(cells, found, strict=True)) == cells


def test_prices(spark):
    cells = {
        None: [], "TBD": [], "free": [("Free", 0.0, "FLAT", None, None)],
        "$300/week per session (am/pm)": [("Per Session", 300.0, "PER_SESSION", None, None)],
        "$400- Half Day, $550 Full Day": [("Half Day", 400.0, "PER_SESSION", None, None), ("Full Day", 550.0, "PER_WEEK", None, None)],
        "$1349 for one week, $2399 for two weeks, $3499 for three weeks": [("1 Week", 1349.0, "PER_CAMP", 1, None), ("2 Weeks", 2399.0, "PER_CAMP", 2, None), ("3 Weeks", 3499.0, "PER_CAMP", 3, None)],
        "$1250 (8 year olds), $7,450.50 (9-17 year olds, 27 day camps)": [("Per Week", 1250.0, "PER_WEEK", None, "8 year olds"), ("4 Weeks (9-17 year olds, 27 day camps)", 7450.5, "PER_CAMP", 4, "9-17 year olds, 27 day camps")],
        "$445; $150 aftercare": [("Per Week", 445.0, "PER_WEEK", None, None), ("Extended Care", 150.0, "PER_WEEK", None, None)],
        "$735 for all seven days or $119/day": [("Per Week", 735.0, "PER_CAMP", None, None), ("Per Day", 119.0, "PER_DAY", None, None)],
        "members $5 / Non-members $9": [("Members", 5.0, "PER_WEEK", None, None), ("Non-Members", 9.0, "PER_WEEK", None, None)],
        "ask": [],
    }
    found = [[tuple(p)[:5] for p in v] for v in over(spark, list(cells), P.prices)]
    assert dict(zip(cells, found, strict=True)) == cells
    noted = over(spark, ["$1; $2"], lambda c: P.prices(c, F.lit(" 10% off ")))[0]
    assert [p.discountNotes for p in noted] == ["10% off", None]


def test_hours_and_care(spark):
    cells = {None: (None, None), "9am to 3pm": ("9:00 AM", "3:00 PM"), "9:00 AM - 3:00 PM": ("9:00 AM", "3:00 PM"), "Morning 9am-12pm, all 9am–3:30 p.m.": ("9:00 AM", "3:30 PM"), "full day 9am-12pm / 12pm-5pm": ("9:00 AM", "12:00 PM"), "noon": (None, None), "0:30am to 1am": ("12:30 AM", "1:00 AM")}
    assert dict(zip(cells, map(tuple, over(spark, list(cells), P.hours)), strict=True)) == cells
    assert over(spark, ["N", "Y", "8:15 AM", "Y - 7:30 - 8:30am", "perhaps", None], P.early_care) == [None, "8:00 AM", "8:15 AM", "8:30 AM", None, None]
    assert over(spark, ["no", "Y 5:00 PM", "y-"], P.late_care) == [None, "5:00 PM", "5:00 PM"]


def test_runs_of_days(spark):
    times = P.hours(F.lit("9am-3pm"))
    found = over(spark, ["June 10-July 6, July 8-August 3", "6/1-8/1, one week", "Smarch 1-3", "Jul 5 to 9, 2027"], lambda c: P.run_sessions(c, times))
    assert [[(s.label, s.startDate, s.endDate) for s in v] for v in found] == [
        [("Session 1", "2026-06-10", "2026-07-06"), ("Session 2", "2026-07-08", "2026-08-03")], [("Session 1", "2026-06-01", "2026-08-01")], [], [("Session 1", "2027-07-05", "2027-07-09")],
    ]
    assert P.season_weeks()[4] == ("Jun 29-Jul 3", "2026-06-29", "2026-07-03") and P.season_weeks()[11][0] == "Aug 17-21"


def test_registration(spark):
    found = over(spark, ["January 27, 2024 (members) at 10 a.m.", "Opens 12/5", "1/13/25", None], P.registration_opening)
    assert [tuple(v) for v in found] == [("2026-01-27", "10:00 AM"), ("2026-12-05", None), ("2025-01-13", None), (None, None)]
    assert over(spark, ["January 27, 2024"], lambda c: P.registration_opening(c, True))[0].date == "2024-01-27"


def test_excerpts(spark):
    df = spark.createDataFrame([("ab", "xaby", None), ("ab", "abab", None), ("ab", "abab", "chars:2-4"), ("ab", "abab", "chars:1-3"), ("ab", "ab", "chars:0-9"), ("ab", "ab", "bad"), ("", "ab", None), ("ab", None, None), ("aa", "aaa", None)], "e string, b string, l string")
    found = df.select(X.resolve_excerpt("e", "b", "l").alias("r")).collect()
    assert [(r.r.state, r.r.start) for r in found] == [("verified", 1), ("approximate_stale", None), ("verified", 2), ("approximate_stale", None), ("approximate_stale", None), ("approximate_stale", None), ("unavailable", None), ("unavailable", None), ("approximate_stale", None)]


def test_local_dates(spark):
    assert over(spark, ["2026-06-01", "2026-06-01 03:00:00", "no day", None], V.local_date_of_text) == ["Jun 1, 2026", "May 31, 2026", None, None]


def test_switches_and_scopes(spark):
    assert [W.is_on(x) for x in (None, "", "0", "False", " off ", "NO", "yes", "1")] == [True, True, False, False, False, False, True, True]
    df = spark.createDataFrame([("a",), (None,)], "c string")
    assert [df.where(W.all_of(f)).count() for f in (W.in_scope("c", []), W.in_strict_scope("c", []), W.in_scope("c", ["a"]))] == [2, 0, 1]
    assert W.overlaps("c", "a", "b", 0, 0) is None and W.costs_at_most("c", "a", 0) is None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aB &-_.é ", max_size=30), min_size=1, max_size=8))
def test_slugs_of_any_name(spark, names):
    def by_hand(s):
        out = re.sub(r"-+", "-", re.sub(r"\s+", "-", re.sub(r"[^a-z0-9\s-]", "", s.lower())))
        return re.sub("^-|-$", "", out)[:80]

    assert over(spark, names, X.slug) == [by_hand(n) for n in names]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abc ", max_size=12), st.text(alphabet="abc ", max_size=12)), min_size=1, max_size=8))
def test_dice_is_a_share(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", X.dice(X.bigrams("a"), X.bigrams("b")).alias("s"), X.dice(X.bigrams("b"), X.bigrams("a")).alias("t")).collect():
        a, b = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (r.a, r.b))
        want = 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0
        assert r.s == r.t == pytest.approx(want) and 0 <= r.s <= 1


def test_hours_are_read_once(spark):
    """What parsers of hours and days make of a cell is worked out once, however often it is used."""
    cells = [("9am-3pm",), ("Full or half: 9am-12pm, 12pm - 3pm",), ("half 9am-12pm, 8am - 3pm; 10am-5pm",), ("noon",), (None,)]
    df = spark.createDataFrame(cells, "c string")
    found = [(r.h.startTime, r.h.endTime) for r in df.select(P.hours("c").alias("h")).collect()]
    assert found == [("9:00 AM", "3:00 PM"), ("9:00 AM", "12:00 PM"), ("8:00 AM", "3:00 PM"), (None, None), (None, None)]
    patterns = lambda c: df.select(c)._jdf.queryExecution().optimizedPlan().toString().count("regexp_")
    none = F.lit(None).cast("string")
    once = patterns(P.hours("c").alias("h"))
    assert once <= 60
    assert patterns(P.run_sessions("c", P.hours("c")).alias("s")) <= once + 12
    assert patterns(P.week_sessions(["c"] * 12, P.hours("c"), none, none).alias("s")) <= once + 12
