"""Sheets, pages, snapshots, exports and streams."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from tests import compare
from trellis.queries import ORACLE_SQL, QUERIES
from trellis.sources import exports, pages, sheets, tables
from trellis.streaming import metrics as stream


def folder():
    return Path(tempfile.mkdtemp(prefix="spark-trellis-test-"))


SHEET = """Updated by,,,,,,,,
Category,Name,Hours,Registration Status,Location,Cost Per Week,Ages/Grades,Weeks Run,"2025 Info
Released Yet?"
Sports,"Sunny ""Star"" Camp",9am to 3pm,Open,"1 Elm St, Boulder, CO 80301",$300; $150 aftercare,K - 5th grade,"June 10-July 6,
July 8-10",Y
,2026 notes,,,,,,,
Art,"Old - Now New, see that row.",,,,,,,
,,,,,,,,
Underwater, Moon,,TBD,Golden,,ALL
"""


def test_a_sheet_becomes_records(spark):
    path = folder() / "sleepaway.csv"
    path.write_text(SHEET)
    rows = sheets.read_sheet(spark, f"file://{path}")
    records = sheets.normalise(rows, "sleepaway").orderBy("name").collect()
    assert [(r.status, r.name) for r in records] == [("skip", "2026 notes"), ("ok", "Moon"), ("error", "Old - Now New, see that row."), ("ok", 'Sunny "Star" Camp')]
    sunny, moon = records[3], records[1]
    assert (sunny.slug, sunny.category, sunny.city, sunny.registration_status, sunny.camp_type) == ("sunny-star-camp", "SPORTS", "Boulder", "OPEN", "SLEEPAWAY")
    assert [(s.startDate, s.startTime) for s in sunny.sessions] == [("2026-06-10", "9:00 AM"), ("2026-07-08", "9:00 AM")]
    assert [p.amount for p in sunny.prices] == [300.0, 150.0] and sunny.age_groups[0].label == "Grades K-5th"
    assert (moon.city, moon.registration_status, moon.age_groups[0].maxAge) == ("Golden", "COMING_SOON", 18)
    fresh, counts = sheets.ingested(sheets.normalise(rows, "sleepaway"), spark.createDataFrame([("moon",)], "slug string"))
    assert [r.slug for r in fresh.collect()] == ["sunny-star-camp"]
    assert {r.status: r.n for r in counts.collect()} == {"ok": 2, "skip": 1, "error": 1}


def test_other_kinds_of_sheet(spark):
    rows = spark.createDataFrame([("Camp A", "Y", "", "x"), ("Camp B", "no", "Y", "N")], "`Name` string, `PreK` string, `Kindergarten (ages 5-6)` string, `Jan 5-7` string")
    found = sheets.normalise(rows, "winter").orderBy("name").collect()
    assert [[(g.label, g.minAge) for g in r.age_groups] for r in found] == [[("PreK", 3)], [("Kindergarten", 5)]]
    assert [[s.startDate for s in r.sessions] for r in found] == [["2027-01-05"], []]
    rows = spark.createDataFrame([("Camp A", "Y", "Pirates")], "`Name` string, `Week Jun 1-5` string, `Jun 8–12` string")
    assert [s.startDate for s in sheets.normalise(rows, "summer").first().sessions] == ["2026-06-01", "2026-06-08"]


def test_columns_are_found_by_name():
    columns = ["Name", "registration status (new)", "LINK"]
    assert sheets.find_column(columns, "Link", "link") == "LINK"
    assert sheets.find_column(columns, "Registration Status") == "registration status (new)"
    assert sheets.find_column(columns, "Lunch") is None


def test_page_text(spark):
    html = "<html><body><nav><a>Menu</a></nav><main><h1>Title &amp; more</h1><p>One <a>link</a> two</p><div class='cookie-bar'><p>Accept</p></div><script>x</script></main><p>outside</p></body></html>"
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>a  b\tc</p><li>item"), (5, html)], "i int, html string")
    found = {r.i: r.text for r in pages.visible_text(df).collect()}
    assert found == {1: "Title & more\nOne two\nlink", 2: None, 3: "", 4: "a b c\nitem", 5: found[1]}
    assert {r.i: r.t for r in df.select("i", pages.rough_text("html").alias("t")).collect()}[4] == "a b c\nitem"


def test_entities_that_are_not_closed(spark):
    """Cut off at a text's end; the query reads them as its SQL does, the operator as browsers do by default."""
    ends = ["a &amp;&amp", "b &am", "c &", "d &#39;&#39", "e &lt;p&gt", "f &nosuch; &ampx;", "g &eacute;&#x41;"]
    html = lambda x: f"<html><body><h1>{x}</h1><p>one &amp;amp; two</p></body></html>"
    df = spark.createDataFrame([(i, html(x)) for i, x in enumerate(ends)], "page_id int, html string")
    read = lambda **how: [r.text.split("\n")[0] for r in pages.visible_text(df, **how).orderBy("page_id").collect()]
    assert read(closed=True) == ["a &&amp", "b &am", "c &", "d '&#39", "e <p&gt", "f &nosuch; &ampx;", "g éA"]
    assert read()[0] == "a &&" and read()[3] == "d ''"
    path = folder()
    df.withColumn("url", F.lit("https://a.example.org")).coalesce(1).write.parquet(f"file://{path}/pages.parquet")
    con = compare.connect(str(path))
    assert compare.differences(QUERIES["s08_page_text"](spark, str(path)).where("page_id < 6"), f"select * from ({ORACLE_SQL['s08_page_text']}) where page_id < 6", con) == ""


def test_snapshots(spark):
    path = f"file://{folder() / 'store'}"
    rows = spark.createDataFrame([("a", "2024-01-01", "one"), ("a", "2024-01-02", "two"), ("b", "2024-01-01", "one")], "source string, fetched_at string, body string")
    tables.put_snapshots(rows, path)
    tables.put_snapshots(rows, path)
    assert spark.read.parquet(path).count() == 3
    newest = tables.snapshots(spark, path).where("rank = 1 and source = 'a'").first()
    assert newest.body == "two"
    assert [r.body for r in tables.snapshot(spark, path, newest.body_hash[:9]).collect()] == ["two"]
    assert tables.snapshot(spark, path, "zz").count() == 0
    again = spark.createDataFrame([("a", "two"), ("b", "three")], "source string, body string")
    assert {r.source: r.unchanged for r in tables.unchanged(again, tables.snapshots(spark, path)).collect()} == {"a": True, "b": False}


def test_seed_file_and_listings(spark):
    path = folder() / "seed.json"
    path.write_text('{"city": "x", "centers": [{"name": "A", "url": "https://a"}, {"name": "B"}]}')
    assert sorted(r.name for r in tables.read_seed(spark, f"file://{path}", "centers").collect()) == ["A", "B"]
    camps = spark.createDataFrame([("c1", None, 1), ("c0", 1, 2), ("c2", 3, None)], "name string, programProviderId int, corporateProviderId int")
    providers = spark.createDataFrame([(1, "P", "https://p"), (2, "Q", "https://q"), (3, "R", "javascript:x")], "id int, name string, url string")
    assert [(r.name, r.url) for r in tables.listings(camps, providers, 5).collect()] == [("c0", "https://p")]


def test_camp_calendars(spark):
    df = spark.createDataFrame([(1, "A; B", "a", "x,y", None, "", [("Week", 10.0)], [(7, "2026-06-01", "2026-06-05")]), (2, "C", "c", None, "Here", "https://c", [], [])], "camp_id int, name string, slug string, description string, address string, url string, pricing array<struct<label:string,amount:double>>, schedules array<struct<session_id:int,start:string,end:string>>")
    a, c = [r.calendar for r in exports.camp_calendars(df, "2026-01-02 03:04:05", "https://x").orderBy("camp_id").collect()]
    assert "SUMMARY:A\\; B\r\n" in a and "DTEND;VALUE=DATE:20260606\r\n" in a and "DESCRIPTION:x\\,y\\nPricing: Week $10\\nDetails: https://x/camps/a\r\n" in a and "LOCATION:Denver\\, CO" in a
    assert c.count("BEGIN:VEVENT") == 1 and "DTSTART;VALUE=DATE:20260102\r\nDTEND;VALUE=DATE:20260102\r\n" in c and c.endswith("END:VCALENDAR\r\n")


def test_saved_calendars_keep_or_add_the_last_day(spark):
    saves = spark.createDataFrame([(1, 1)], "user_id int, camp_id int")
    camps = spark.createDataFrame([(1, "A", "a", "", None, "")], "camp_id int, name string, slug string, description string, address string, url string")
    sessions = spark.createDataFrame([(1, 1, "2026-06-01", "2026-06-05")], "camp_id int, session_id int, start string, end string")
    for added, day in ((False, "20260605"), (True, "20260606")):
        assert f"DTEND;VALUE=DATE:{day}" in exports.saved_calendars(saves, camps, sessions, "2026-01-01 00:00:00", "https://x", added).first().calendar


def test_streams_count_as_batches_do(spark):
    base = folder()
    rows = [(i, f"2024-01-01 {h:02d}:{m:02d}:00", "view" if i % 2 else "error") for i, (h, m) in enumerate((h, m) for h in range(6) for m in (5, 35))]
    df = spark.createDataFrame(rows, "id int, t string, kind string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    for k in range(3):
        df.where(f"id >= {4 * k} and id < {4 * k + 4}").coalesce(1).write.mode("append").parquet(f"file://{base}/in")
    events = stream.read_events(spark, f"file://{base}/in", "id int, kind string, ts timestamp")
    stream.write(stream.hourly_counts(events, "ts", "kind", "1 hour"), f"file://{base}/out", f"file://{base}/check").awaitTermination()
    found = spark.read.parquet(f"file://{base}/out").collect()
    assert len(found) >= 4 and all(r.n == 1 for r in found)
    first = stream.first_observations(stream.read_events(spark, f"file://{base}/in", "id int, kind string, ts timestamp"), "ts", ["kind"], "10 hours")
    stream.write(first, f"file://{base}/out2", f"file://{base}/check2").awaitTermination()
    assert sorted(r.kind for r in spark.read.parquet(f"file://{base}/out2").collect()) == ["error", "view"]
