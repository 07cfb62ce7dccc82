"""Parsers of what people type into a sheet: ages, prices, hours, weeks, dates, statuses and categories.

Every parser is a Column; arrays of structs where a cell may hold several things.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.functions.text import SPACE
from trellis.functions.values import ColumnOrName, _col, let

AGE_GROUP = "struct<label:string,minAge:int,maxAge:int,minGrade:int,maxGrade:int>"
PRICE = "struct<label:string,amount:double,unit:string,durationWeeks:int,ageQualifier:string,discountNotes:string>"
SESSION = "struct<label:string,startDate:string,endDate:string,startTime:string,endTime:string,earlyDropOff:string,latePickup:string>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null where there is no match or the group took no part."""
    return F.when(text.rlike(pattern), F.nullif(F.regexp_extract(text, pattern, group), F.lit("")))


def _int(text: Column) -> Column:
    return text.try_cast("int")


# ── ages and grades ────────────────────────────────────────────────────────────────────────────

#: Words for grades, in the order in which they are tried.
GRADE_WORDS = (("prek", -1), ("pre-k", -1), ("preschool", -1), ("kindergarten", 0), ("k", 0))
#: Cells that say nothing about ages.
NO_AGES = ("y", "n", "no", "yes", "x", "tbd", "")


def grade_of_age(age: Column) -> Column:
    return F.when(age <= 4, -1).when(age <= 5, 0).otherwise(F.least(age - 5, F.lit(12))).cast("int")


def age_of_grade(grade: Column) -> Column:
    return F.when(grade == -1, 3).otherwise(grade + 5).cast("int")


def _grade_name(grade: Column) -> Column:
    return F.when(grade == -1, "PreK").when(grade == 0, "K").when(grade == 1, "1st").when(grade == 2, "2nd").when(grade == 3, "3rd").otherwise(F.concat(grade.cast("string"), F.lit("th")))


def _age_group(label: Column, min_age: Column, max_age: Column, min_grade: Column, max_grade: Column) -> Column:
    return F.struct(label.alias("label"), min_age.cast("int").alias("minAge"), max_age.cast("int").alias("maxAge"), min_grade.cast("int").alias("minGrade"), max_grade.cast("int").alias("maxGrade"))


def _grade(token: Column) -> Column:
    word = F.coalesce(*[F.when(token.startswith(w), g) for w, g in GRADE_WORDS])
    number = _int(_group(token, r"^[+-]?\d+", 0))
    return F.coalesce(word, _int(_group(token, r"(\d+)(?:st|nd|rd|th)")), F.when(number.between(0, 12), number))


def _grade_span(low: Column) -> Column:
    """struct(a, b) of the grades that a cell spans; null if it isn't such a span."""
    bare = low
    for qualifier in (r"rising\s+", r"completed\s+", r"entering\s+", r"grades?\s*"):
        bare = F.regexp_replace(bare, qualifier, "")
    ends = F.split(_trim(bare), r"\s*(?:through|thru|to|-|–)\s*")
    grades = lambda e: F.struct(let(_trim(e[0]), _grade).alias("a"), let(_trim(F.try_element_at(e, F.lit(2))), _grade).alias("b"))
    return let(ends, lambda e: F.when(F.size(e) == 2, let(grades(e), lambda g: F.when(g["a"] <= g["b"], g))))


def _numbers(low: Column, pattern: str) -> Column:
    """struct(a, b) of a pattern's two groups as numbers."""
    return F.struct(_int(_group(low, pattern, 1)).alias("a"), _int(_group(low, pattern, 2)).alias("b"))


def _read_ages(raw: Column, low: Column) -> Column:
    text = lambda c: c.cast("string")
    teen = lambda n: F.when(n.isNotNull(), _age_group(F.concat(F.lit("Ages "), text(n), F.lit("-teen")), n, F.lit(17), grade_of_age(n), F.lit(12)))

    def grades(g: Column) -> Column:
        label = F.when(g["a"] == g["b"], F.concat(F.lit("Grade "), _grade_name(g["a"]))).otherwise(F.concat(F.lit("Grades "), _grade_name(g["a"]), F.lit("-"), _grade_name(g["b"])))
        return F.when(g.isNotNull(), _age_group(label, age_of_grade(g["a"]), age_of_grade(g["b"]) + 1, g["a"], g["b"]))

    def ages(n: Column) -> Column:
        fine = n["a"].between(1, 18) & n["b"].between(1, 18) & (n["a"] <= n["b"])
        return F.when(fine, _age_group(F.concat(F.lit("Ages "), text(n["a"]), F.lit("-"), text(n["b"])), n["a"], n["b"], grade_of_age(n["a"]), grade_of_age(n["b"])))

    named = F.coalesce(*[F.when(low.isin(w, f"{w} only"), g) for w, g in GRADE_WORDS])
    by_name = lambda g: F.when(g.isNotNull(), _age_group(F.when(g == -1, "PreK").otherwise("Kindergarten"), age_of_grade(g), age_of_grade(g) + 1, g, g))
    one = lambda n: F.when(n.between(2, 18), _age_group(F.concat(F.lit("Age "), text(n)), n, n, grade_of_age(n), grade_of_age(n)))
    nothing = _null("int")
    return F.coalesce(
        let(_int(_group(low, r"(?:ages?\s*)?(\d+)\s*(?:to|-)\s*teen")), teen),
        let(_grade_span(low), grades),
        let(_numbers(low, r"(?:ages?\s*)?(\d+)\s*(?:to|-|–)\s*(\d+)(?:\s*(?:year\s*old|yr|yo)s?)?"), ages),
        let(named, by_name),
        let(_int(_group(low, r"(?:ages?\s*)?(\d+)\s*(?:year\s*old|yr|yo)?s?\s*$")), one),
        _age_group(raw, nothing, nothing, nothing, nothing),
    )


def one_age_group(raw: ColumnOrName) -> Column:
    """One cell part as an age group: teens, grades, ages, a grade's name, one age; else its text alone."""
    notes = lambda low: _trim(F.regexp_replace(F.regexp_replace(low, rf"^(.*?)\*verify\*{SPACE}*", "$1"), rf"^(.*?)discrepancy{SPACE}*", "$1"))
    return let(_trim(_col(raw)), lambda r: F.when(r != "", let(notes(F.lower(r)), lambda low: _read_ages(r, low))))


def age_groups(raw: ColumnOrName) -> Column:
    """All age groups of a cell, parted by commas. "All" is 3 to 18; cells like "Y" or "TBD" have none."""
    cell = _trim(F.coalesce(_col(raw), F.lit("")))
    low = F.lower(cell)
    every = F.array(_age_group(F.lit("All ages"), F.lit(3), F.lit(18), F.lit(-1), F.lit(12)))
    parts = F.filter(F.split(cell, rf",{SPACE}*"), lambda p: ~F.lower(_trim(p)).isin("", "no", "n", "yes", "y"))
    parts = F.when(F.size(parts) > 1, parts).otherwise(F.array(cell))
    found = F.filter(F.transform(parts, one_age_group), lambda g: g.isNotNull())
    return F.when(low == "all", every).when(low.isin(*NO_AGES), _none(AGE_GROUP)).otherwise(found)


#: How a column's header names two grades and their ages, tried in this order.
GRADES_IN_HEADER = (
    r"(\d+)(?:st|nd|rd|th)-(\d+)(?:st|nd|rd|th)\s*grade.*?(?:ages?\s*)?(\d+)-(\d+)",
    r"(\d+)(?:st|nd|rd|th)\s*and\s*(\d+)(?:st|nd|rd|th)\s*grade.*?(\d+)-(\d+)",
)


def _header_group(header: str) -> Column:
    """What a column's own name says about ages; null if nothing."""
    name = F.lower(F.lit(header))
    four = lambda *v: _age_group(F.lit(v[0]), *map(F.lit, v[1:]))
    found = F.when(name.contains("prek") | name.contains("pre-k"), four("PreK", 3, 4, -1, -1)).when(name.contains("kindergarten"), four("Kindergarten", 5, 6, 0, 0))
    for pattern in GRADES_IN_HEADER:
        a, b, c, d = (_group(name, pattern, i) for i in (1, 2, 3, 4))
        found = found.when(name.rlike(pattern), _age_group(F.concat(F.lit("Grades "), a, F.lit("-"), b), _int(c), _int(d), _int(a), _int(b)))
    return found


def column_age_group(header: str, value: ColumnOrName) -> Column:
    """The group that a cell under a grade's header marks: Y takes the header's, a text speaks for itself."""
    low = F.lower(_trim(F.coalesce(_col(value), F.lit(""))))
    return F.when(low.isin("y", "yes"), _header_group(header)).when(~low.isin("", "no", "n", "x"), one_age_group(value))


def merged_age_groups(groups: ColumnOrName) -> Column:
    """Groups by their least age, joined where the next begins at most two years after the last ends."""
    by_age = F.array_sort(_col(groups), lambda a, b: F.coalesce(a["minAge"], F.lit(0)) - F.coalesce(b["minAge"], F.lit(0)))

    def step(done: Column, g: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        zero = lambda c: F.coalesce(c, F.lit(0))
        max_age = F.greatest(zero(last["maxAge"]), zero(g["maxAge"]))
        max_grade = F.greatest(zero(last["maxGrade"]), zero(g["maxGrade"]))
        said = F.coalesce(last["minAge"].cast("string"), F.lit("null"))
        joined = _age_group(F.concat(F.lit("Ages "), said, F.lit("-"), max_age.cast("string")), last["minAge"], max_age, last["minGrade"], max_grade)
        near = F.coalesce(g["minAge"] <= last["maxAge"] + 2, F.lit(False))
        return F.when(near, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(g)))

    return let(by_age, lambda g: F.aggregate(F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0))), F.slice(g, 1, 1), step))


def age_summary(groups: ColumnOrName) -> Column:
    """"All ages" of none, the label of one, else the span of all ages but 0; labels where there are no ages."""
    groups = _col(groups)
    ages = F.filter(F.concat(F.transform(groups, lambda g: g["minAge"]), F.transform(groups, lambda g: g["maxAge"])), lambda a: a.isNotNull() & (a != 0))
    span = F.concat(F.lit("Ages "), F.array_min(ages).cast("string"), F.lit("-"), F.array_max(ages).cast("string"))
    labels = F.array_join(F.transform(groups, lambda g: g["label"]), ", ")
    return F.when(F.size(groups) < 1, "All ages").when(F.size(groups) == 1, groups[0]["label"]).when(F.size(ages) == 0, labels).otherwise(span)


# ── prices ─────────────────────────────────────────────────────────────────────────────────────

AMOUNT = r"\$\s*([\d,]+(?:\.\d{1,2})?)"
#: Phrases for a price's unit, for the weeks it covers and for its label; the first that fits counts.
UNIT_PHRASES = (
    ("PER_DAY", ("/day", "per day", "/daily")),
    ("PER_SESSION", ("/session", "per session", "half day", "half-day")),
    ("PER_WEEK", ("/month", "per month")),
    ("PER_CAMP", ("for one week", "for two week", "for three week", "for 2 week", "for 3 week", "for one month", "27 day", "all summer", "full summer", "for all")),
)
WEEK_PHRASES = (
    (1, ("one week", "1 week", "1-week")),
    (2, ("two week", "2 week", "2-week")),
    (3, ("three week", "3 week", "3-week")),
    (4, ("four week", "4 week", "one month", "27 day")),
    (6, ("six week", "6 week")),
    (11, ("all summer", "full summer")),
    (1, ("mini camp",)),
)
AGE_IN_BRACKETS = r"(?i)\(([^)]*(?:year|grade|age|old|yr|1st|2nd|3rd|4th|5th|6th|7th|8th|9th|10th|11th|12th)[^)]*)\)"
GRADES_OUTSIDE = r"(?i)((?:\d+(?:st|nd|rd|th)[-/]?\s*(?:through|to|-)\s*\d+(?:st|nd|rd|th))\s*grade(?:rs?)?)"


def _holds(text: Column, *phrases: str) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def price_unit(low: Column) -> Column:
    return F.coalesce(*[F.when(_holds(low, *phrases), unit) for unit, phrases in UNIT_PHRASES], F.lit("PER_WEEK"))


def duration_weeks(low: Column) -> Column:
    """Weeks that a phrase names; of days, more than three make whole weeks of five."""
    days = _int(_group(low, r"(\d+)\s*days?"))
    return F.coalesce(*[F.when(_holds(low, *phrases), n) for n, phrases in WEEK_PHRASES], F.when(days > 3, F.ceil(days / 5))).cast("int")


def _price_label(low: Column, unit: Column, weeks: Column, ages: Column) -> Column:
    half = F.when(_holds(low, "am", "morning"), "Half Day (AM)").when(_holds(low, "pm", "afternoon"), "Half Day (PM)").otherwise("Half Day")
    week = F.when(weeks == 1, "1 Week").otherwise(F.concat(weeks.cast("string"), F.lit(" Weeks")))
    return (
        F.when(_holds(low, "full day", "full-day"), "Full Day")
        .when(_holds(low, "half day", "half-day"), half)
        .when(_holds(low, "aftercare", "extended"), "Extended Care")
        .when(low.contains("member") & ~low.contains("non"), "Members")
        .when(_holds(low, "non-member", "nonmember", "non member"), "Non-Members")
        .when(low.contains("mini camp"), "Mini Camp")
        .when(_holds(low, "all summer", "full summer"), "Full Summer")
        .when(low.contains("horseback"), "Horseback Camp")
        .when(low.contains("material"), "With Materials Fee")
        .when(weeks > 0, F.when(ages.isNotNull(), F.concat(week, F.lit(" ("), ages, F.lit(")"))).otherwise(week))
        .when(unit == "PER_DAY", "Per Day")
        .when(unit == "PER_SESSION", "Per Session")
        .otherwise("Per Week")
    )


def _one_price(part: Column) -> Column:
    amount = F.replace(_group(part, AMOUNT), F.lit(","), F.lit("")).try_cast("double")
    low = F.lower(part)
    unit, weeks = price_unit(low), duration_weeks(low)
    ages = _trim(F.coalesce(_group(part, AGE_IN_BRACKETS), _group(part, GRADES_OUTSIDE)))
    label = let(F.struct(low.alias("low"), unit.alias("unit"), weeks.alias("weeks"), ages.alias("ages")), lambda s: _price_label(s["low"], s["unit"], s["weeks"], s["ages"]))
    price = F.struct(label.alias("label"), amount.alias("amount"), unit.alias("unit"), weeks.alias("durationWeeks"), ages.alias("ageQualifier"), _null("string").alias("discountNotes"))
    return F.when(amount.isNotNull(), price)


def prices(raw: ColumnOrName, discounts: ColumnOrName | None = None) -> Column:
    """All prices of a cell. "Free" is one of 0; discounts go with the first."""
    cell = _trim(F.coalesce(_col(raw), F.lit("")))
    bar = "\x1f"
    parts = cell
    for pattern, by in ((r",\s*\$", bar + r"\$"), (r";\s*\$", bar + r"\$"), (r";\s+", bar), (r"\s+/\s+\$", bar + r"\$"), (r"\s+/\s+(?=[A-Z])", bar), (r"(?i)\s+or\s+\$", bar + r"\$")):
        parts = F.regexp_replace(parts, pattern, by)
    found = F.filter(F.transform(F.transform(F.split(parts, bar), _trim), _one_price), lambda p: p.isNotNull())
    note = F.nullif(_trim(_col(discounts)), F.lit("")) if discounts is not None else _null("string")
    found = F.transform(found, lambda p, i: p.withField("discountNotes", F.when(i == 0, note)))
    free = F.struct(F.lit("Free").alias("label"), F.lit(0.0).alias("amount"), F.lit("FLAT").alias("unit"), _null("int").alias("durationWeeks"), _null("string").alias("ageQualifier"), _null("string").alias("discountNotes"))
    return F.when(F.lower(cell) == "free", F.array(free)).when(F.lower(cell).isin("", "tbd", "?"), _none(PRICE)).otherwise(found)


# ── hours, weeks and dates ─────────────────────────────────────────────────────────────────────

TIME = r"\d{1,2}(?::\d{2})?\s*(?:am|pm|a\.?m\.?|p\.?m\.?)"
#: Months by name and by their first three letters.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_NUMBERS = {name: i + 1 for i, m in enumerate(MONTHS) for name in (m, m[:3])}
#: Mondays and Fridays of the season's weeks run from here, so many weeks.
FIRST_WEEK, WEEKS = "2026-06-01", 12
YEAR = "2026"


def clock_time(raw: ColumnOrName, hour_zero: str = "12") -> Column:
    """H:MM AM or PM; null where the text is no such time."""
    low = F.regexp_replace(F.regexp_replace(F.lower(_trim(_col(raw))), r"a\.?m\.?", "am"), r"p\.?m\.?", "pm")
    pattern = r"^(\d{1,2})(?::(\d{2}))?\s*(am|pm)$"

    def said(low: Column) -> Column:
        hour = F.regexp_extract(low, pattern, 1).try_cast("int").cast("string")
        minute = F.coalesce(F.nullif(F.regexp_extract(low, pattern, 2), F.lit("")), F.lit("00"))
        hour = F.when(hour == "0", hour_zero).otherwise(hour)
        return F.when(low.rlike(pattern), F.concat(hour, F.lit(":"), minute, F.lit(" "), F.upper(F.regexp_extract(low, pattern, 3))))

    return let(low, said)


def minutes_of(clock: Column) -> Column:
    """Minutes since midnight of H:MM AM or PM."""
    hour = _int(_group(clock, r"^(\d{1,2}):", 1))
    hour = F.when(clock.endswith("PM") & (hour != 12), hour + 12).when(clock.endswith("AM") & (hour == 12), 0).otherwise(hour)
    return hour * 60 + _int(_group(clock, r":(\d{2})", 1))


#: Fixed value: a span of two times.
TIME_SPAN = rf"(?i)({TIME})\s*(?:to|-|–|through)\s*({TIME})"


def hours(raw: ColumnOrName) -> Column:
    """struct(startTime, endTime): the only span of times, the first where the cell says "full", else the longest."""
    raw = F.coalesce(_col(raw), F.lit(""))
    each = lambda i: F.regexp_extract_all(raw, F.lit(TIME_SPAN), F.lit(i))
    spans = F.transform(F.arrays_zip(each(1).alias("a"), each(2).alias("b")), lambda x: F.struct(clock_time(x["a"]).alias("startTime"), clock_time(x["b"]).alias("endTime")))
    spans = F.filter(spans, lambda s: s["startTime"].isNotNull() & s["endTime"].isNotNull())
    nothing = F.struct(_null("string").alias("startTime"), _null("string").alias("endTime"))

    def chosen(spans: Column) -> Column:
        lengths = F.transform(spans, lambda s: minutes_of(s["endTime"]) - minutes_of(s["startTime"]))
        widest = F.try_element_at(spans, let(lengths, lambda n: F.array_position(n, F.array_max(n)).cast("int")))
        first = F.try_element_at(spans, F.lit(1))
        return F.coalesce(F.when((F.size(spans) == 1) | F.lower(raw).contains("full"), first).otherwise(widest), nothing)

    # each step is worked out once for a cell: what a lambda uses twice is otherwise made anew, down to the patterns
    return let(spans, chosen)


def care_time(raw: ColumnOrName, usual: str) -> Column:
    """A time for early or late care: the one named, the usual one for yes, null for no."""
    cell = _trim(F.coalesce(_col(raw), F.lit("")))
    low = F.lower(cell)
    said = clock_time(_group(cell, rf"(?i)({TIME})"))
    yes = low.isin("y", "yes") | low.startswith("y ") | low.startswith("y-")
    return F.when(low.isin("", "n", "no"), _null("string")).when(cell.rlike(rf"(?i)({TIME})"), said).when(yes, F.lit(usual))


def early_care(raw: ColumnOrName) -> Column:
    return care_time(raw, "8:00 AM")


def late_care(raw: ColumnOrName) -> Column:
    return care_time(raw, "5:00 PM")


def _session(label: Column, start: Column, end: Column, times: Column, early: Column | None = None, late: Column | None = None) -> Column:
    return F.struct(
        label.alias("label"), start.alias("startDate"), end.alias("endDate"), times["startTime"].alias("startTime"), times["endTime"].alias("endTime"),
        (early if early is not None else _null("string")).alias("earlyDropOff"), (late if late is not None else _null("string")).alias("latePickup"),
    )


def season_weeks() -> list[tuple[str, str, str]]:
    """(label, Monday, Friday) of each week of the season."""
    from datetime import date, timedelta

    out = []
    for i in range(WEEKS):
        a = date.fromisoformat(FIRST_WEEK) + timedelta(weeks=i)
        b = a + timedelta(days=4)
        out.append((f"{a:%b} {a.day}-" + (f"{b:%b} " if a.month != b.month else "") + f"{b.day}", a.isoformat(), b.isoformat()))
    return out


def marked_sessions(cells: list[tuple[ColumnOrName, str, str, str]], times: Column, early: Column, late: Column, no: tuple[str, ...] = ("n", "no")) -> Column:
    """cells: (column, label, first day, last day). A session for each cell that says anything but no."""
    if not cells:
        return _none(SESSION)

    def found(t: Column) -> Column:
        said = [(F.lower(_trim(F.coalesce(_col(cell), F.lit("")))), label, start, end) for cell, label, start, end in cells]
        return F.array(*[F.when(~low.isin("", *no), _session(F.lit(label), F.lit(start), F.lit(end), t, early, late)) for low, label, start, end in said])

    return F.filter(let(times, found), lambda s: s.isNotNull())


def week_sessions(columns: list[ColumnOrName], times: Column, early: Column, late: Column) -> Column:
    """columns: one for each week of the season, in order."""
    cells = [(c, f"Week of {label}", a, b) for c, (label, a, b) in zip(columns, season_weeks(), strict=False)]
    return marked_sessions(cells, times, early, late, ("n", "no", "no camp"))


def _month(name: Column) -> Column:
    numbers = F.create_map(*[F.lit(x) for pair in MONTH_NUMBERS.items() for x in pair])
    return F.try_element_at(numbers, F.lower(name))


def _day(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD as written; whether there is such a day isn't asked."""
    return F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0"))


#: Spans of days, with months by name (the second month and the year may be left out) and with slashes.
NAMED_SPAN = r"(?:(\w+)\s+(\d{1,2}))\s*(?:to|-|–)\s*(?:(\w+)\s+)?(\d{1,2})(?:\s*,\s*(\d{4}))?"
SLASHED_SPAN = r"(\d{1,2})/(\d{1,2})\s*-\s*(\d{1,2})/(\d{1,2})"


def run_sessions(raw: ColumnOrName, times: Column) -> Column:
    """Sessions of a cell like "June 10-July 6, July 8-August 3", numbered; where there is none, of "6/1-8/1"."""
    raw = F.coalesce(_col(raw), F.lit(""))
    year = F.lit(YEAR)

    def all_of(pattern: str, groups: int) -> Column:
        found = [F.regexp_extract_all(raw, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(1, groups + 1)]
        return F.arrays_zip(*found)

    named = all_of(NAMED_SPAN, 5)
    empty = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other)
    spans = F.transform(named, lambda m: F.struct(_day(empty(m["g5"], year), _month(m["g1"]), m["g2"]).alias("a"), _day(empty(m["g5"], year), _month(empty(m["g3"], m["g1"])), m["g4"]).alias("b")))
    spans = F.filter(spans, lambda s: s["a"].isNotNull() & s["b"].isNotNull())
    slashed = F.transform(all_of(SLASHED_SPAN, 4), lambda m: F.struct(_day(year, m["g1"], m["g2"]).alias("a"), _day(year, m["g3"], m["g4"]).alias("b")))
    spans = let(spans, lambda found: F.when(F.size(found) > 0, found).otherwise(slashed))
    session = lambda s, i, t: _session(F.concat(F.lit("Session "), (i + 1).cast("string")), s["a"], s["b"], t)
    return let(times, lambda t: F.transform(spans, lambda s, i: session(s, i, t)))


# ── registration ───────────────────────────────────────────────────────────────────────────────


def registration_status(raw: ColumnOrName) -> Column:
    low = F.lower(_trim(F.coalesce(_col(raw), F.lit(""))))
    return (
        F.when(low == "", "UNKNOWN")
        .when(low.isin("full", "sold out") | low.contains("closed"), "CLOSED")
        .when(_holds(low, "waitlist", "wait list", "filling"), "WAITLIST")
        .when((low == "tbd") | _holds(low, "not yet", "coming soon"), "COMING_SOON")
        .when(low.isin("yes", "y") | _holds(low, "open", "rolling", "available", "accepting", "by appointment"), "OPEN")
        .when(low.rlike(r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|\d{1,2}/\d{1,2})"), "COMING_SOON")
        .otherwise("UNKNOWN")
    )


#: A day with its year, one without, one with slashes; a time of day.
DATED = r"(?i)(\w+)\s+(\d{1,2})(?:st|nd|rd|th)?,?\s*(\d{4})"
UNDATED = r"(?i)(\w+)\s+(\d{1,2})(?:st|nd|rd|th)?"
SLASHED = r"(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?"
OPENING_TIME = r"(?i)(?:at\s+)?(\d{1,2}(?::\d{2})?\s*(?:a\.?m\.?|p\.?m\.?))"


def registration_opening(raw: ColumnOrName, keep_year: bool = False) -> Column:
    """struct(date, time). A written-out date is taken for this season whatever its year, unless keep_year;
    one with slashes has its own."""
    cell = _trim(F.coalesce(_col(raw), F.lit("")))
    season = F.lit(YEAR)
    year = _group(cell, DATED, 3) if keep_year else season
    short = _group(cell, SLASHED, 3)
    slash_year = F.coalesce(F.when(F.length(short) == 2, F.concat(F.lit("20"), short)).otherwise(short), season)
    date = F.coalesce(
        _day(year, _month(_group(cell, DATED, 1)), _group(cell, DATED, 2)),
        _day(season, _month(_group(cell, UNDATED, 1)), _group(cell, UNDATED, 2)),
        _day(slash_year, _group(cell, SLASHED, 1), _group(cell, SLASHED, 2)),
    )
    time = clock_time(_group(cell, OPENING_TIME), "0")
    return F.struct(date.alias("date"), time.alias("time"))


# ── categories ─────────────────────────────────────────────────────────────────────────────────

#: Category names as written in sheets, in the order in which parts of names are tried.
CATEGORY_NAMES = (
    ("SPORTS", ("sports", "sport", "multi-sport", "multisport", "athletic", "athletics", "all sports", "gymnastics")),
    ("ARTS", ("art", "arts", "art - ceramics", "arts & crafts", "arts/crafts", "craft", "crafts", "fashion/sewing", "sewing", "fashion", "ceramics")),
    ("STEM", ("stem", "steam", "stem/steam", "science", "technology", "engineering", "math", "coding", "robotics")),
    ("ACADEMIC", ("math/reading tutoring",)),
    ("STEM", ("variety and science",)),
    ("NATURE", ("outdoors", "outdoor", "nature", "animals & nature", "animals", "adventure", "wilderness", "hiking", "farming")),
    ("ACADEMIC", ("academic", "education performance", "education/ business", "education/business", "education", "tutoring", "reading", "language", "french", "spanish", "chinese")),
    ("MUSIC", ("music", "music camp", "rock band")),
    ("THEATER", ("theater", "theatre", "drama", "performing arts", "musical theater", "musical theatre", "musical theater/dance", "arts/theater", "arts/theatre", "improv")),
    ("COOKING", ("cooking", "culinary", "baking")),
    ("MULTI_ACTIVITY", ("variety", "traditional day camp", "day camp", "general/themed", "preschool play based camp", "play based", "general", "themed")),
    ("THEATER", ("dance",)),
)
#: Words that tell a category, in the order in which categories are tried.
CATEGORY_WORDS = (
    ("SPORTS", r"\b(?:soccer|basketball|baseball|football|tennis|swimming|lacrosse|volleyball|hockey|golf|martial\s*arts|karate|fencing|climbing|gymnastics|multi-?sport|athletic)\b"),
    ("STEM", r"\b(?:coding|programming|robotics|minecraft|roblox|3d\s*print|drone|circuit|engineer|computer|cyber|ai|machine\s*learning|stem|steam|science)\b"),
    ("NATURE", r"\b(?:hiking|nature|wilderness|wildlife|outdoor|camping|ecology|garden|farm|horse|equestrian|fishing|trail|mountain)\b"),
    ("ARTS", r"\b(?:painting|drawing|sculpture|ceramics|pottery|printmaking|mixed\s*media|art\s*studio|fiber\s*art|weaving|sewing)\b"),
    ("THEATER", r"\b(?:theater|theatre|acting|improv|musical|drama|perform|stage|playwriting|dance|ballet|hip\s*hop|choreograph)\b"),
    ("MUSIC", r"\b(?:music|band|orchestra|guitar|piano|drum|singing|choir|song|instrument|jazz|rock\s*band)\b"),
    ("COOKING", r"\b(?:cooking|culinary|baking|chef|kitchen|recipe|cuisine)\b"),
    ("ACADEMIC", r"\b(?:tutor|reading|writing|math|language|french|spanish|chinese|mandarin|sat\s*prep|test\s*prep|homework|study)\b"),
)


def category(raw: ColumnOrName) -> Column:
    """A category's name as one of the known ones: as written, else the first that holds it or is held by it."""
    low = F.lower(_trim(F.coalesce(_col(raw), F.lit(""))))
    exact = [F.when(low.isin(*names), c) for c, names in CATEGORY_NAMES]
    part = [F.when(low.contains(n) | F.lit(n).contains(low), c) for c, names in CATEGORY_NAMES for n in names]
    return F.when(low == "", "OTHER").otherwise(F.coalesce(*exact, *part, F.lit("OTHER")))


def category_of_text(name: ColumnOrName, description: ColumnOrName) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(_col(name), F.lit("")), F.coalesce(_col(description), F.lit(""))))
    return F.coalesce(*[F.when(text.rlike(p), c) for c, p in CATEGORY_WORDS], F.lit("MULTI_ACTIVITY"))
