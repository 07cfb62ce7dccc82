"""Operators that the other queries only use in passing: one query for each, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions import parsers as P
from trellis.functions import predicates as C
from trellis.functions import text as X
from trellis.functions import values as V
from trellis.operators import diff, folds, metrics, nest, ranking, review, trust
from trellis.operators.keep import shared_file
from trellis.operators.spread import tasks_for
from trellis.plans.registry import AS_OF, Tables, query
from trellis.sources import exports, sheets, tables

# Sources and sinks


def _sheet(t: Tables) -> DataFrame:
    """A sheet as people keep it: a line before the header, quotes and line breaks in cells; written to the shared folder and read."""
    k = F.col("s_suppkey")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    name = F.when(k % 7 == 0, "").when(k % 11 == 0, "2026 notes").when(k % 13 == 0, "Old - Now New, see that row.").otherwise(F.concat(F.lit("Camp ""Sun"" "), k.cast("string")))
    row = F.concat_ws(",", quoted(F.when(k % 2 == 0, "Sports").otherwise("Art - Ceramics")), quoted(name), F.when(k % 3 == 0, "9am to 3pm").otherwise(""), F.when(k % 2 == 0, "Open!").otherwise("TBD"), quoted(F.concat(F.lit("$"), (k % 900 + 1).cast("string"), F.lit("/week"))), quoted(F.lit("line\nbreak")))
    lines = t.supplier.select(F.lit(1).alias("part"), k.alias("at"), row.alias("value"))
    head = t.spark.createDataFrame([(0, 0, "Updated by,,,,,"), (0, 1, "Category,Name,Hours,Registration Status,Cost Per Week,Notes")], "part int, at long, value string")
    path = shared_file(t.spark, "sheet")
    # a sheet is one file with its lines in order; one that people typed is small
    head.unionByName(lines).repartition(1).sortWithinPartitions("part", "at").select("value").write.option("compression", "none").text(path)
    return sheets.read_sheet(t.spark, path)


SHEET_SQL = """
with s as (select s_suppkey as k, case when s_suppkey % 7 = 0 then '' when s_suppkey % 11 = 0 then '2026 notes' when s_suppkey % 13 = 0 then 'Old - Now New, see that row.' else 'Camp Sun ' || s_suppkey end as name from supplier),
r as (select *, case when name in ('', '2026 notes') then 'skip' when name like 'Old%' then 'error' else 'ok' end as status from s)"""


@query(SHEET_SQL + " select name, case when k % 2 = 0 then 'Sports' else 'Art - Ceramics' end as category, case when k % 3 = 0 then '9am to 3pm' else '' end as hours, 'line' || chr(10) || 'break' as notes from s")
def s01_sheet_rows(t: Tables) -> DataFrame:
    rows = _sheet(t)
    return rows.select(F.coalesce("Name", F.lit("")).alias("name"), F.col("Category").alias("category"), F.coalesce("Hours", F.lit("")).alias("hours"), F.col("Notes").alias("notes"))


@query(SHEET_SQL + " select status, name, case when k % 2 = 0 then 'OPEN' else 'COMING_SOON' end as registration from r")
def s02_columns_found(t: Tables) -> DataFrame:
    """Columns are found by name, in any case or as a part of it."""
    rows = _sheet(t).withColumnRenamed("Registration Status", "REGISTRATION STATUS (new)")
    return sheets.normalise(rows, "sleepaway").select("status", "name", F.col("registration_status").alias("registration"))


@query(SHEET_SQL + """ select status, name, regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') as slug, case when k % 2 = 0 then 'SPORTS' else 'ARTS' end as category, 'SLEEPAWAY' as camp_type, (k % 900 + 1)::double as amount from r where status = 'ok'""")
def s03_records(t: Tables) -> DataFrame:
    records = sheets.normalise(_sheet(t), "sleepaway").where("status = 'ok'")
    return records.select("status", "name", "slug", "category", "camp_type", F.element_at("prices", 1)["amount"].alias("amount"))


@query(SHEET_SQL + """ select slug, true as added from (select regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') as slug from r where status = 'ok' and k % 5 <> 0) union all select status || '=' || count(*), false from r group by status""")
def s04_ingested(t: Tables) -> DataFrame:
    """What is new, and counts by status."""
    known = t.supplier.where("s_suppkey % 5 = 0").select(F.concat(F.lit("camp-sun-"), F.col("s_suppkey").cast("string")).alias("slug"))
    fresh, counts = sheets.ingested(sheets.normalise(_sheet(t), "sleepaway"), known)
    return fresh.select("slug", F.lit(True).alias("added")).unionByName(counts.select(F.concat_ws("=", "status", F.col("n").cast("string")).alias("slug"), F.lit(False).alias("added")))


@query("select r_regionkey, r_name from region")
def s05_table(t: Tables) -> DataFrame:
    return tables.read_table(t.spark, t.folder, "region")


@query("select c_custkey as id, c_name as name, c_custkey % 2 = 0 as even from customer")
def s06_seed(t: Tables) -> DataFrame:
    """A JSON file with an array of objects, written to the shared folder and read."""
    item = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 2 == 0).alias("even"))
    path = shared_file(t.spark, "seed")
    # a seed is one document; people write it by hand, so it is small
    t.customer.agg(F.to_json(F.struct(F.collect_list(item).alias("camps"))).alias("value")).write.text(path)
    return tables.read_seed(t.spark, path, "camps").select("id", "name", "even")


@query("""
with p as (select doc_id % 50 as source, n_chars % 7 as seen, sha256(coalesce(text, '')) as h from documents), d as (select source, h, max(seen) as seen from p group by 1, 2)
select source, h, (row_number() over (partition by source order by seen desc, h desc))::int as rank from d""")
def s09_snapshots(t: Tables) -> DataFrame:
    """Two writes to one store: what it has isn't written again."""
    pages = t.documents.select((F.col("doc_id") % 50).alias("source"), (F.col("n_chars") % 7).alias("fetched_at"), F.coalesce("text", F.lit("")).alias("body"))
    pages = pages.groupBy("source", "body").agg(F.max("fetched_at").alias("fetched_at"))
    path = shared_file(t.spark, "store")
    tables.put_snapshots(pages.where("source < 30"), path)
    tables.put_snapshots(pages, path)
    return tables.snapshots(t.spark, path).select("source", F.col("body_hash").alias("h"), "rank")


@query("""
select c_custkey as camp_id, case when c_custkey % 2 = 0 then 'DTSTART;VALUE=DATE:20240610' || chr(13) || chr(10) || 'DTEND;VALUE=DATE:20240615' else 'DTSTART;VALUE=DATE:20240131' || chr(13) || chr(10) || 'DTEND;VALUE=DATE:20240131' end as days,
       'SUMMARY:' || c_name || '\\, ' || c_mktsegment as summary, 'DESCRIPTION:Pricing: Week $' || (c_custkey % 900 + 10) || '\\nDetails: https://example.org/camps/' || c_custkey as description from customer""")
def s14_camp_calendars(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    price = F.array(F.struct(F.lit("Week").alias("label"), (k % 900 + 10).cast("double").alias("amount")))
    session = F.array(F.struct(F.lit(1).alias("session_id"), F.lit("2024-06-10").cast("date").alias("start"), F.lit("2024-06-14").cast("date").alias("end")))
    camps = t.customer.select(k.alias("camp_id"), F.concat_ws(", ", "c_name", "c_mktsegment").alias("name"), k.cast("string").alias("slug"), F.lit("").alias("description"), F.lit("").alias("address"), F.lit("").alias("url"), price.alias("pricing"), F.when(k % 2 == 0, session).otherwise(F.slice(session, 1, 0)).alias("schedules"))
    found = exports.camp_calendars(camps, AS_OF, "https://example.org")
    line = lambda pattern: F.regexp_extract("calendar", pattern, 1)
    return found.select("camp_id", line(r"(DTSTART[^\r]*\r\nDTEND[^\r]*)").alias("days"), line(r"(SUMMARY:[^\r]*)").alias("summary"), line(r"(DESCRIPTION:[^\r]*)").alias("description"))


@query(r"select doc_id, replace(replace(replace(replace(text, '\', '\\'), ';', '\;'), ',', '\,'), chr(10), '\n') as text from documents")
def s15_escaped(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", exports.ics_text("text").alias("text"))


@query("select o_orderkey, strftime(o_orderdate + interval 1 day, '%Y%m%d') as day from orders")
def d06_calendar_days(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", exports.ics_day(F.date_add("o_orderdate", 1)).alias("day"))


# Filters


@query("select s_suppkey from supplier where s_nationkey in (3, 5)")
def f03_strict_scope(t: Tables) -> DataFrame:
    rows = t.supplier.withColumn("nation", F.col("s_nationkey").cast("string"))
    return rows.where(C.all_of(C.in_strict_scope("nation", ["3", "5"]))).select("s_suppkey")


@query("select 'active' as state, count(*) as n from orders where o_orderstatus <> 'P' union all select 'archived', count(*) from orders where o_orderstatus = 'P' union all select 'all', count(*) from orders")
def f10_archived(t: Tables) -> DataFrame:
    at = F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate"))
    states = ["active", "archived", "all"]
    return t.orders.agg(*[F.count_if(C.all_of(C.archived(at, s))).alias(s) for s in states]).unpivot([], states, "state", "n")


@query("select event_id, (event_type = 'view')::int + (event_id % 3 = 0)::int + (event_id % 4 = 0)::int as missing from events")
def f15_missing_fields(t: Tables) -> DataFrame:
    k = F.col("event_id")
    return t.events.select("event_id", C.missing_count(C.is_blank(F.nullif("event_type", F.lit("view"))), k % 3 == 0, F.nullif(k % 4, F.lit(1)) == 0).alias("missing"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def f17_days_as_text(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", V.iso_date("o_orderdate").alias("day"))


@query("select flag, shown from (values ('0', 0), ('off', 0), (' No ', 0), ('FALSE', 0), ('1', 5), ('', 5), ('yes', 5)) v(flag, shown)")
def f21_switches(t: Tables) -> DataFrame:
    """A switch decides whether a filter is there at all; so many of the regions it leaves."""
    parts = [t.region.where(F.lit(C.is_on(f))).agg(F.count(F.lit(1)).cast("int").alias("shown")).withColumn("flag", F.lit(f)) for f in ("0", "off", " No ", "FALSE", "1", "", "yes")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""
with c as (select o_orderkey as k, o_orderkey % 4 as pending, case when o_orderkey % 5 = 0 then null else (o_orderkey % 3) end as missing, case when o_orderkey % 7 = 0 then null else o_orderdate end as seen from orders),
d as (select *, trunc(epoch(timestamp '{AS_OF}' - seen) / 86400) as days from c)
select facet, sum(n)::bigint as n from (select unnest(['PENDING', 'MISSING', 'NEVER_VERIFIED', 'ALL', 'NO_PENDING', 'NEVER', 'STALE']) as facet,
  unnest([(pending > 0)::int, coalesce(missing > 0, false)::int, (seen is null)::int, 1, (pending = 0)::int, (seen is null)::int, coalesce(days >= 9000, true)::int]) as n from d) group by 1""")
def f22_facets(t: Tables) -> DataFrame:
    """The facets of the tables of subjects and of providers."""
    k = F.col("o_orderkey")
    seen, pending, missing = F.when(k % 7 != 0, F.col("o_orderdate")), k % 4, F.when(k % 5 != 0, k % 3)
    facets = {s: C.quality_is(s, pending, missing, seen) for s in ("PENDING", "MISSING", "NEVER_VERIFIED", "ALL")}
    facets |= {"NO_PENDING": C.pending_is("NO_PENDING", pending), "NEVER": C.crawl_is("NEVER", seen, F.lit(AS_OF)), "STALE": C.crawl_is("STALE", seen, F.lit(AS_OF), 9000)}
    return t.orders.agg(*[F.count_if(C.all_of(c)).alias(s) for s, c in facets.items()]).unpivot([], list(facets), "facet", "n")


# Joins and order


@query("select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'P'")
def j02_left(t: Tables) -> DataFrame:
    pending = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return t.customer.select("c_custkey").join(pending, "c_custkey", "left")


@query("select n_name, count(*) as n from customer join nation on n_nationkey = c_nationkey group by 1")
def j11_small_side(t: Tables) -> DataFrame:
    """A side that Spark finds small enough is sent to all tasks; nothing is hinted."""
    return t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("""
with a as (select date_trunc('month', o_orderdate) as m, count(*) as orders from orders group by 1), b as (select date_trunc('month', l_shipdate) as m, count(*) as lines from lineitem group by 1)
select strftime(m, '%Y-%m') as month, coalesce(orders, 0) as orders, coalesce(lines, 0) as lines from a full join b using (m)""")
def j12_merged_series(t: Tables) -> DataFrame:
    by = lambda df, c, name: df.groupBy(F.date_format(c, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias(name))
    return metrics.merged_series(by(t.orders, "o_orderdate", "orders"), by(t.lineitem, "l_shipdate", "lines"), "month", "orders", "lines")


@query("select event_type, strftime(max(ts), '%Y-%m-%d') as day from events group by 1")
def j13_latest_by_field(t: Tables) -> DataFrame:
    return metrics.latest_by_field(t.events, "event_type", "ts", "at").select("event_type", V.iso_date("at").alias("day"))


@query("""
with p as (select o_orderkey as id, o_custkey as subject, o_orderkey % 3 as run, o_orderstatus as value from orders)
select id, (select count(*) from p b where b.subject = a.subject and b.id <> a.id and b.run <> a.run and b.value = a.value) as n from p a""")
def j15_corroborated(t: Tables) -> DataFrame:
    """Other proposals of a subject, from other runs, that say the same; here over all of its proposals."""
    k = F.col("o_orderkey")
    said = t.orders.select(k.alias("id"), F.col("o_custkey").alias("subject"), (k % 3).alias("run"), F.lit("status").alias("field"), F.col("o_orderstatus").alias("value"))
    return review.corroborated(said, said).select("id", F.col("corroborations").alias("n"))


@query("select event_id, missing, seen from (select event_id, (event_id % 5)::int as missing, case when event_id % 4 = 0 then null else strftime(ts, '%Y-%m-%d') end as seen from events) order by missing desc, seen nulls first, event_id limit 500")
def t05_nulls_first(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", (F.col("event_id") % 5).cast("int").alias("missing"), F.when(F.col("event_id") % 4 != 0, V.iso_date("ts")).alias("seen"))
    return rows.orderBy(F.desc("missing"), F.asc_nulls_first("seen"), "event_id").limit(500)


@query("select o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) as status, max(o_orderdate)::date::varchar as day from orders group by 1")
def t07_latest_row(t: Tables) -> DataFrame:
    out = nest.with_latest(t.orders.select("o_custkey").distinct(), "o_custkey", t.orders.withColumnRenamed("o_custkey", "of"), "of", ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderdate"])
    return out.select("o_custkey", F.col("o_orderstatus").alias("status"), V.iso_date("o_orderdate").alias("day"))


@query("select o_custkey, o_orderkey, n from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r, count(*) over (partition by o_custkey) as n from orders) where r = 1")
def w03_first_with_count(t: Tables) -> DataFrame:
    """A group's first row beside its count, in one aggregation."""
    best = F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey")))
    return t.orders.groupBy("o_custkey").agg(best.alias("o_orderkey"), F.count(F.lit(1)).alias("n"))


# Aggregations and sets


@query("select l_orderkey, string_agg(l_linenumber::varchar, ',' order by l_linenumber, l_quantity, l_partkey) as lines from lineitem group by 1")
def a16_in_order(t: Tables) -> DataFrame:
    item = F.struct("l_linenumber", "l_quantity", "l_partkey")
    packed = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("x"))
    return packed.select("l_orderkey", F.array_join(F.transform("x", lambda x: x["l_linenumber"].cast("string")), ",").alias("lines"))


@query("select o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') as kinds, count(distinct o_orderpriority) as n from orders group by 1")
def a18_distinct_sets(t: Tables) -> DataFrame:
    out = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"), F.count_distinct("o_orderpriority").alias("n"))
    return out.select("o_custkey", F.array_join(F.sort_array("s"), ",").alias("kinds"), "n")


@query("select l_orderkey, count(*) as changes, floor(avg(l_discount * 5) * 100 + 0.5) / 100 as confidence from lineitem where l_returnflag <> 'R' group by 1")
def a29_overall_confidence(t: Tables) -> DataFrame:
    """The mean over the changes that were proposed, added up as they are stored; suppressed ones don't count, nor do those without a flag."""
    at = F.struct("_metadata.file_path", "_metadata.row_index").alias("at")
    rows = t.lineitem.select("l_orderkey", (F.col("l_discount") * 5).alias("confidence"), F.when(F.col("l_returnflag") != "R", "update").otherwise("suppressed").alias("mode"), at)
    return diff.overall_confidence(rows, ["l_orderkey"], F.col("at"))


@query("select l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag) || list(l_linestatus))), ',') as both from lineitem group by 1")
def u02_array_union(t: Tables) -> DataFrame:
    out = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    return out.select("l_orderkey", F.array_join(F.sort_array(F.array_union("a", "b")), ",").alias("both"))


# Texts


@query(r"select page_id, regexp_replace(url, '^https?://(www\.)?([^/]+).*', '\2') as host from pages")
def x05_raw_hosts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.raw_host("url").alias("host"))


@query("""
with g as (select p_partkey, list_distinct(list_transform(range(1, length(p_name)), lambda i: substr(p_name, i, 2))) as a, list_distinct(list_transform(range(1, length(p_brand)), lambda i: substr(p_brand, i, 2))) as b from part)
select p_partkey, round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 9) as score from g""")
def x08_dice(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(X.dice(X.bigrams("p_name"), X.bigrams("p_brand")), 9).alias("score"))


@query("select page_id, case page_id % 4 when 0 then 'ftp://x.org/' when 1 then null when 2 then url else 'HTTPS://x.org/a' end as url, case page_id % 4 when 2 then url when 3 then 'HTTPS://x.org/a' end as safe from pages")
def x15_safe_urls(t: Tables) -> DataFrame:
    k = F.col("page_id") % 4
    url = F.when(k == 0, "ftp://x.org/").when(k == 2, F.col("url")).when(k == 3, "HTTPS://x.org/a")
    return t.pages.select("page_id", url.alias("url"), X.safe_url(url).alias("safe"))


@query("select c_custkey, c_custkey % 3 <> 2 as metro from customer")
def x16_in_metro(t: Tables) -> DataFrame:
    city = F.element_at(F.array(F.lit(" Golden "), F.lit("wheat  ridge"), F.lit("Elsewhere")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return t.customer.select("c_custkey", X.in_metro(city).alias("metro"))


@query(r"select doc_id, case when length(text) > 40 then regexp_replace(substr(text, 1, 40), '[ \t\n\v\f\r\p{Z}]+$', '') || '…' else nullif(text, '') end as preview from documents")
def x20_previews(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.excerpt_preview("text", 40).alias("preview"))


@query("select p_partkey, trim(regexp_replace(lower(p_type || ' (' || p_brand || ')'), '[^a-z0-9]+', ' ', 'g')) as name from part")
def x21_item_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.item_name(F.concat(F.col("p_type"), F.lit(" ("), F.col("p_brand"), F.lit(")"))).alias("name"))


# Cells that people typed


@query("select p_partkey, case when p_size <= 4 then -1 when p_size <= 5 then 0 else least(p_size - 5, 12) end as grade from part")
def p02_grades(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", P.grade_of_age(F.col("p_size")).alias("grade"))


@query("select p_partkey, case when p_size % 3 = 0 then 'A:3-6;B:12-14' when p_size % 3 = 1 then 'A:3-5;B:9-11' else 'A:3-9' end as groups from part")
def p04_merged_groups(t: Tables) -> DataFrame:
    """Groups that touch become one, under the first's label or both; told here by the spans."""
    k = F.col("p_size") % 3
    one = lambda label, a, b: F.struct(F.lit(label).alias("label"), a.cast("int").alias("minAge"), b.cast("int").alias("maxAge"), F.lit(None).cast("int").alias("minGrade"), F.lit(None).cast("int").alias("maxGrade"))
    groups = F.array(one("B", F.when(k == 0, 12).when(k == 1, 9).otherwise(6), F.when(k == 0, 14).when(k == 1, 11).otherwise(9)), one("A", F.lit(3), F.when(k == 0, 6).when(k == 1, 5).otherwise(5)))
    merged = P.merged_age_groups(groups)
    said = F.transform(merged, lambda g, i: F.concat(F.when(i == 0, "A:").otherwise("B:"), g["minAge"].cast("string"), F.lit("-"), g["maxAge"].cast("string")))
    return t.part.select("p_partkey", F.array_join(said, ";").alias("groups"))


WEEKS = [("for one week", 1), ("two weeks", 2), ("12 days", 3), ("3 days", None), ("a day", None)]


@query("select p_partkey, case p_partkey % 5 " + " ".join(f"when {i} then {n}" for i, (_, n) in enumerate(WEEKS) if n) + " end as weeks from part")
def p06_durations(t: Tables) -> DataFrame:
    cell = F.element_at(F.array(*[F.lit(c) for c, _ in WEEKS]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", P.duration_weeks(cell).alias("weeks"))


CARE = [("Y", "8:00 AM", "5:00 PM"), ("yes", "8:00 AM", "5:00 PM"), ("no", None, None), ("", None, None), ("Y - 7:30am", "7:30 AM", "7:30 AM"), ("until 6:15 PM", "6:15 PM", "6:15 PM")]


@query("select p_partkey, case p_partkey % 6 " + " ".join(f"when {i} then '{a}'" for i, (_, a, _) in enumerate(CARE) if a) + " end as early, case p_partkey % 6 " + " ".join(f"when {i} then '{b}'" for i, (_, _, b) in enumerate(CARE) if b) + " end as late from part")
def p08_care_times(t: Tables) -> DataFrame:
    cell = F.element_at(F.array(*[F.lit(c) for c, _, _ in CARE]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t.part.select("p_partkey", P.early_care(cell).alias("early"), P.late_care(cell).alias("late"))


@query("select p_partkey, case when p_size % 2 = 0 then 'Jan 5-7=2027-01-05' else '' end || case when p_size % 2 = 0 and p_size % 3 = 0 then ';' else '' end || case when p_size % 3 = 0 then 'Feb 15=2027-02-15' else '' end as sessions from part")
def p10_marked_sessions(t: Tables) -> DataFrame:
    k = F.col("p_size")
    none = F.lit(None).cast("string")
    cells = [(F.when(k % 2 == 0, "Y").otherwise("no"), "Jan 5-7", "2027-01-05", "2027-01-07"), (F.when(k % 3 == 0, "9-3").otherwise(""), "Feb 15", "2027-02-15", "2027-02-15")]
    found = P.marked_sessions(cells, P.hours(F.lit("9am-3pm")), none, none)
    return t.part.select("p_partkey", F.array_join(F.transform(found, lambda s: F.concat_ws("=", s["label"], s["startDate"])), ";").alias("sessions"))


@query("select p_partkey, 'Session 1=2026-06-' || lpad((p_size % 20 + 1)::varchar, 2, '0') || '>2026-07-06;Session 2=2026-07-08>2026-08-03' as sessions from part")
def p11_runs(t: Tables) -> DataFrame:
    cell = F.concat(F.lit("June "), (F.col("p_size") % 20 + 1).cast("string"), F.lit("-July 6, July 8-August 3"))
    found = P.run_sessions(cell, P.hours(F.lit("9am-3pm")))
    return t.part.select("p_partkey", F.array_join(F.transform(found, lambda s: F.concat(s["label"], F.lit("="), s["startDate"], F.lit(">"), s["endDate"])), ";").alias("sessions"))


@query("select p_partkey, case when p_size % 3 = 0 then null when p_size % 3 = 1 then (p_size % 12 + 1) || ':00 AM' else (p_size % 12 + 1) || ':30 PM' end as clock from part")
def p12_clock_times(t: Tables) -> DataFrame:
    k, hour = F.col("p_size") % 3, (F.col("p_size") % 12 + 1).cast("string")
    cell = F.when(k == 0, F.concat(hour, F.lit(" o'clock"))).when(k == 1, F.concat(F.lit(" "), hour, F.lit(" A.M. "))).otherwise(F.concat(hour, F.lit(":30pm")))
    return t.part.select("p_partkey", P.clock_time(cell).alias("clock"))


@query("select p_partkey, '2026-' || lpad((p_size % 12 + 1)::varchar, 2, '0') || '-09' as opens, case when p_size % 2 = 0 then '9:30 AM' end as at from part")
def p14_openings(t: Tables) -> DataFrame:
    months = ["January", "Feb", "March", "Apr", "May", "June", "July", "Aug", "September", "Oct", "Nov", "December"]
    month = F.element_at(F.array(*map(F.lit, months)), (F.col("p_size") % 12 + 1).cast("int"))
    o = P.registration_opening(F.concat(month, F.lit(" 9th"), F.when(F.col("p_size") % 2 == 0, ", 2025 at 9:30am").otherwise("")))
    return t.part.select("p_partkey", o["date"].alias("opens"), o["time"].alias("at"))


GUESSED = [("Robotics", "STEM"), ("Guitar week", "MUSIC"), ("Plain", "MULTI_ACTIVITY"), ("Soccer", "SPORTS")]


@query("select p_partkey, case p_partkey % 4 " + " ".join(f"when {i} then '{c}'" for i, (_, c) in enumerate(GUESSED)) + " end as category from part")
def p16_guessed_categories(t: Tables) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(c) for c, _ in GUESSED]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", P.category_of_text(F.lit(None).cast("string"), name).alias("category"))


@query(f"select o_orderkey, round(epoch(timestamp '{AS_OF}' - o_orderdate) / 86400, 6) as days from orders")
def d02_days_elapsed(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(V.days_elapsed("o_orderdate", F.lit(AS_OF)), 6).alias("days"))


@query("select o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey) as n, coalesce((select sum(l_quantity) from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R'), 0) as returned from orders")
def d08_arrays_of_rows(t: Tables) -> DataFrame:
    """Nested rows, filtered and summed in place."""
    out = nest.nest(t.orders, "o_orderkey", {"lines": (t.lineitem, "l_orderkey", ["l_quantity", "l_returnflag"], ["l_linenumber"])})
    total = F.aggregate(F.filter("lines", lambda x: x["l_returnflag"] == "R"), F.lit(0.0), lambda a, x: a + x["l_quantity"])
    return out.select("o_orderkey", F.size("lines").cast("long").alias("n"), total.alias("returned"))


# Proposals, review and trust


@query("select o_orderkey, lower(trim(coalesce(case when o_orderkey % 3 = 0 then null else ' ' || o_orderpriority || ' ' end, ''))) as said from orders")
def n02_comparable(t: Tables) -> DataFrame:
    value = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    return t.orders.select("o_orderkey", diff.comparable(value).alias("said"))


@query("""
with l as (select l_orderkey, l_returnflag as k, count(*) filter (where l_linenumber <= 3) as a, count(*) as b from lineitem group by 1, 2)
select l_orderkey, sum(b - a)::int as added, 0 as removed, sum(b - a) > 0 as changed, sum(a) > 0 and count(*) filter (where a = 0) > 0 as additive from l group by 1""")
def n04_relation_change(t: Tables) -> DataFrame:
    """The first three lines' flags against all of them, as multisets."""
    packed = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") <= 3, F.col("l_returnflag"))).alias("a"), F.collect_list("l_returnflag").alias("b"))
    return packed.select("l_orderkey", diff.relation_change(F.col("a"), F.col("b")).alias("c")).select("l_orderkey", "c.added", "c.removed", "c.changed", "c.additive")


@query("select p_partkey, unnest(['p_name', 'p_brand', 'p_size']) as field, unnest([p_name, p_brand, p_size::varchar]) as value from part")
def n08_long_fields(t: Tables) -> DataFrame:
    return diff.long_fields(t.part, ["p_partkey"], ["p_name", "p_brand", "p_size"], "value")


@query("select o_orderkey, o_orderkey % 4 > 0 and o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0 as selectable from orders")
def n14_selectable(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", review.selectable(k % 4, F.when(k % 3 == 0, "populate").otherwise("update"), F.when(k % 5 != 0, "old")).alias("selectable"))


@query("select c_custkey as camp_id, coalesce(case min(case o_orderstatus when 'P' then 1 when 'O' then 2 when 'F' then 3 end) when 1 then 'stale' when 2 then 'proposed' else 'verified' end, 'verified') as state from customer left join orders on o_custkey = c_custkey group by 1")
def n23_sessions_state(t: Tables) -> DataFrame:
    """The weakest session's state; verified without any."""
    sessions = t.orders.select(F.col("o_custkey").alias("camp_id"), F.when(F.col("o_orderstatus") == "P", "stale").when(F.col("o_orderstatus") == "O", "proposed").otherwise("verified").alias("state"))
    return trust.sessions_state(t.customer.select(F.col("c_custkey").alias("camp_id")), sessions, "camp_id").select("camp_id", "state")


@query("""
with e as (select o_custkey as claim_id, o_orderdate as seen, o_orderkey as id, case when o_orderstatus = 'P' then 'disputed' else 'verified' end as s, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders)
select c_custkey as claim_id, case when s is null then 'unknown' when s = 'verified' and epoch(timestamp '2000-01-01' - seen) / 86400 > case when c_custkey % 2 = 0 then 180 else 120 end then 'stale' else s end as state from customer left join e on claim_id = c_custkey and r = 1""")
def n24_claim_states(t: Tables) -> DataFrame:
    """The newest event decides, until its days are over."""
    claims = t.customer.select(F.col("c_custkey").alias("claim_id"), F.when(F.col("c_custkey") % 2 == 0, "camp-scalar-field").otherwise("camp-repeated-field").alias("kind"))
    events = t.orders.select(F.col("o_custkey").alias("claim_id"), F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "P", "disputed").otherwise("verified").alias("state"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return trust.claim_states(claims, events, "2000-01-01 00:00:00", tasks_for(t.orders)).select("claim_id", "state")


@query("select p_partkey, case p_partkey % 9 when 8 then 'VERIFIED' when 4 then 'STALE' else 'PLACEHOLDER' end as confidence from part")
def n25_data_confidence(t: Tables) -> DataFrame:
    state = trust.state_of_rank(F.col("p_partkey") % len(trust.STATES))
    return t.part.select("p_partkey", trust.data_confidence(state).alias("confidence"))


@query("""
with c as (select l_orderkey, l_returnflag as q, case when l_quantity < 10 then 'assumed' when l_quantity < 20 then 'disputed' else 'verified' end as s from lineitem),
g as (select l_orderkey, q, bool_and(s = 'assumed') as a, min(case s when 'disputed' then 1 when 'assumed' then 2 else 3 end) as r from c group by 1, 2),
w as (select o_orderkey as l_orderkey, unnest(['A', 'N', 'R']) as q from orders)
select l_orderkey, q as requirement, case when a then 'verified' when r is null then 'unknown' when r = 1 then 'disputed' when r = 2 then 'assumed' else 'verified' end as state from w left join g using (l_orderkey, q)""")
def n33_requirement_states(t: Tables) -> DataFrame:
    """The weakest claim's state of each requirement; all assumed is as good as verified, none is unknown."""
    q = F.col("l_quantity")
    claims = t.lineitem.select("l_orderkey", F.col("l_returnflag").alias("requirement"), F.when(q < 10, "assumed").when(q < 20, "disputed").otherwise("verified").alias("state"))
    wanted = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(*map(F.lit, "ANR"))).alias("requirement"))
    return trust.requirement_states(wanted, claims, ["l_orderkey"], tasks_for(t.lineitem))


@query("""
with r as (select distinct conv_id, turn, role, substr(text, 1, 10) as excerpt from conversations qualify row_number() over (partition by conv_id, turn order by role) = 1),
p as (select conv_id as source, floor(turn / 4)::int as item, turn, turn % 2 as field, role, (turn % 10) / 10.0 as c from r),
n as (select *, row_number() over (partition by source, item, field order by turn) - 1 as r from p)
select source, item as global_item, (row_number() over (partition by source, item order by r))::int as row, max(case when field = 0 then role end) as a, max(case when field = 1 then role end) as b, floor(avg(c) * 100 + 0.5) / 100 as confidence from n group by source, item, r""")
def n05_paired_rows(t: Tables) -> DataFrame:
    """Proposals without a place, paired by the order in which each field comes."""
    first = t.conversations.groupBy("conv_id", "turn").agg(F.min_by(F.struct("role", "text"), "role").alias("x"))
    rows = first.select(
        F.col("conv_id").alias("source"), F.floor(F.col("turn") / 4).cast("int").alias("global_item"), F.col("turn").alias("seq"), F.when(F.col("turn") % 2 == 0, "ageGroups[].a").otherwise("ageGroups[].b").alias("path"),
        F.col("x.role").alias("value"), (F.col("turn") % 10 / 10.0).alias("confidence"), F.substring("x.text", 1, 10).alias("excerpt"), F.lit(None).cast("int").alias("sub"),
    )
    return folds.item_rows(rows, "ageGroups", ["a", "b"]).select("source", "global_item", "row", "a", "b", "confidence")
