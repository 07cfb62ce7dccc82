"""What the directory hands out: calendars, a site map and documents in Markdown. All are columns and rows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.values import ColumnOrName, _col

CRLF = "\r\n"


def ics_text(text: ColumnOrName) -> Column:
    """Escaped for a calendar: backslashes, semicolons, commas and line breaks."""
    out = _col(text)
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def ics_day(day: ColumnOrName) -> Column:
    return F.date_format(_col(day).cast("date"), "yyyyMMdd")


def _lines(*lines: Column) -> Column:
    """Lines of a calendar; null ones are left out."""
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF))


def _event(uid: Column, stamp: Column, start: Column, end: Column, summary: Column, description: Column, location: Column, url: Column) -> Column:
    some = lambda c: F.nullif(c, F.lit(""))
    return _lines(
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), uid),
        F.concat(F.lit("DTSTAMP:"), stamp),
        F.concat(F.lit("DTSTART;VALUE=DATE:"), start),
        F.concat(F.lit("DTEND;VALUE=DATE:"), end),
        F.concat(F.lit("SUMMARY:"), ics_text(summary)),
        F.concat(F.lit("DESCRIPTION:"), description),
        F.concat(F.lit("LOCATION:"), ics_text(some(location))),
        F.concat(F.lit("URL:"), some(url)),
        F.lit("END:VEVENT"),
    )


def _calendar(events: Column, name: str, zone: str) -> Column:
    head = ["BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:-//{name}//EN", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", f"X-WR-CALNAME:{name}", f"X-WR-TIMEZONE:{zone}"]
    return F.concat(F.lit(CRLF.join(head) + CRLF), F.array_join(events, ""), F.lit("END:VCALENDAR" + CRLF))


def saved_calendars(saves: DataFrame, camps: DataFrame, sessions: DataFrame, as_of: str, base: str, exclusive_end: bool = False, name: str = "Saved camps", zone: str = "America/Denver") -> DataFrame:
    """saves: user_id, camp_id; camps: camp_id, name, slug, description, address, url; sessions: camp_id, session_id,
    start, end. user_id, calendar: one text for each user with a session among what is saved.

    A session without an end gets seven days. The end is written as stored, which calendars read as the
    day after the last; exclusive_end adds that day."""
    rows = saves.select("user_id", "camp_id").distinct().join(camps, "camp_id").join(sessions, "camp_id")
    end = F.date_add(F.col("end").cast("date"), 1) if exclusive_end else F.col("end").cast("date")
    last = ics_day(F.coalesce(end, F.date_add(F.col("start").cast("date"), 7)))
    link = F.concat(F.lit(f"Details: {base}/camps/"), F.col("slug"))
    text = F.concat_ws("\\n", F.nullif(F.substring("description", 1, 200), F.lit("")), link)
    uid = F.concat_ws("-", F.lit("camp"), F.col("camp_id").cast("string"), F.col("session_id").cast("string"))
    stamp = F.date_format(F.lit(as_of).cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'")
    event = _event(uid, stamp, ics_day("start"), last, F.col("name"), text, F.col("address"), F.col("url"))
    packed = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("camp_id", "session_id", event.alias("event")))).alias("e"))
    return packed.select("user_id", _calendar(F.transform("e", lambda x: x["event"]), name, zone).alias("calendar"))


def camp_calendars(camps: DataFrame, as_of: str, base: str, name: str = "Camp", zone: str = "America/Denver", place: str = "Denver, CO") -> DataFrame:
    """camps: camp_id, name, slug, description, address, url, pricing (array of label, amount), schedules (array of
    session_id, start, end). camp_id, calendar: the day after a session's last is written as its end; a camp
    without sessions has one event, on as_of."""
    link = F.concat(F.lit(f"{base}/camps/"), F.col("slug"))
    amount = lambda p: F.regexp_replace(p["amount"].cast("string"), r"\.0$", "")
    price = F.array_join(F.transform("pricing", lambda p: F.concat(p["label"], F.lit(" $"), amount(p))), ", ")
    text = F.concat_ws("\n", F.nullif(F.substring("description", 1, 200), F.lit("")), F.when(F.size("pricing") > 0, F.concat(F.lit("Pricing: "), price)), F.concat(F.lit("Details: "), link))
    today = F.lit(as_of).cast("date")
    stamp = F.date_format(F.lit(as_of).cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'")
    where, url = F.coalesce(F.nullif("address", F.lit("")), F.lit(place)), F.coalesce(F.nullif("url", F.lit("")), link)
    make = lambda uid, a, b: _event(uid, stamp, ics_day(a), ics_day(b), F.col("name"), ics_text(text), where, url)
    own = F.concat(F.lit("camp-"), F.col("camp_id").cast("string"))
    events = F.transform("schedules", lambda s: make(F.concat(own, F.lit("-"), s["session_id"].cast("string")), s["start"].cast("date"), F.date_add(s["end"].cast("date"), 1)))
    events = F.when(F.size("schedules") > 0, events).otherwise(F.array(make(own, today, today)))
    return camps.select("camp_id", _calendar(events, name, zone).alias("calendar"))


def sitemap(camps: DataFrame, base: str) -> DataFrame:
    """camps: community, slug. url, frequency, priority: the root, three pages for each community, one for each camp."""
    entry = lambda url, often, p: F.struct(url.alias("url"), F.lit(often).alias("frequency"), F.lit(p).alias("priority"))
    root = camps.sparkSession.range(1).select(entry(F.lit(base), "daily", 1.0).alias("e"))
    home = F.concat(F.lit(f"{base}/c/"), F.col("community"))
    pages = F.array(entry(home, "daily", 0.9), entry(F.concat(home, F.lit("/calendar")), "daily", 0.8), entry(F.concat(home, F.lit("/compare")), "monthly", 0.6))
    communities = camps.select("community").distinct().select(F.explode(pages).alias("e"))
    each = camps.select(entry(F.concat(home, F.lit("/camps/"), F.col("slug")), "weekly", 0.8).alias("e"))
    return root.unionByName(communities).unionByName(each).select("e.*")


def _money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.regexp_replace(F.format_number(c, 2), r"\.00$", ""))


def markdown(camps: DataFrame, base: str) -> DataFrame:
    """camps: camp_id, name, slug, community, place, category, camp_type, neighborhood, status, description, details, url,
    opens_on, lunch, age_groups, schedules, pricing. camp_id, document: each camp as Markdown."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    bold = lambda label, c: F.concat(F.lit(f"**{label}:** "), c)
    block = lambda c: F.concat(c, F.lit("\n"))
    title = F.concat(F.lit("### ["), F.col("name"), F.lit(f"]({base}/c/"), F.col("community"), F.lit("/camps/"), F.col("slug"), F.lit(")\n"))
    meta = F.concat_ws(" · ", bold("Community", F.col("place")), bold("Category", F.col("category")), bold("Type", F.col("camp_type")), bold("Neighborhood", some("neighborhood")), bold("Registration", some("status")))
    span = lambda g: F.concat(g["label"], F.lit(" (ages "), g["minAge"].cast("string"), F.lit("–"), g["maxAge"].cast("string"), F.lit(")"))
    ages = F.array_join(F.transform("age_groups", lambda g: F.coalesce(span(g), g["label"])), ", ")
    unit = lambda p: F.when(p["unit"] == "PER_WEEK", "/week").when(p["unit"] == "PER_DAY", "/day").when(p["unit"] == "FLAT", " total").otherwise("/session")
    note = lambda p: F.coalesce(F.concat(F.lit(" ("), F.nullif(p["discountNotes"], F.lit("")), F.lit(")")), F.lit(""))
    cost = F.array_join(F.transform("pricing", lambda p: F.concat(p["label"], F.lit(": "), _money(p["amount"]), unit(p), note(p))), "; ")
    first = F.try_element_at("schedules", F.lit(1))
    starts = F.array_join(F.sort_array(F.transform("schedules", lambda s: s["startDate"])), ", ")
    times = F.concat_ws(
        "\n",
        bold("Hours", F.concat(first["startTime"], F.lit("–"), F.coalesce(first["endTime"], F.lit("")))),
        bold("Early drop-off", first["earlyDropOff"]),
        F.concat(F.lit("**Late pickup:** until "), first["latePickup"]),
        F.when(F.col("camp_type") == "SUMMER_DAY", bold("Available weeks (start dates)", starts)),
    )
    filled = lambda items, c: F.when(F.size(items) > 0, c)
    return camps.select(
        "camp_id",
        F.concat_ws(
            "\n", title, block(meta), block(some("description")), block(filled("age_groups", bold("Ages", ages))), block(filled("pricing", bold("Pricing", cost))),
            block(filled("schedules", times)), F.when(F.col("lunch"), F.lit("**Lunch:** Included\n")), block(bold("Registration opens", some("opens_on"))),
            block(bold("Register", some("url"))), block(F.concat(F.lit("> "), some("details"))),
        ).alias("document"),
    )
