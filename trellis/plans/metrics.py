"""Counts, shares, rates and coverage on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.values import half_up, iso_date
from trellis.operators import metrics as M
from trellis.operators.review import LOW_RISK
from trellis.plans.registry import AS_OF, Tables, query

SINCE, UNTIL = "2024-01-10 00:00:00", "2024-01-20 12:00:00"
RECENT = f"ts > timestamp '{AS_OF}' - interval 30 days"


@query("""
select o_orderpriority as priority, count(*) as total, count(*) filter (where o_orderstatus = 'F') as covered,
       cast(floor(count(*) filter (where o_orderstatus = 'F') * 100.0 / count(*) + 0.5) as integer) as percent
from orders group by 1""")
def a01_covered_share(t: Tables) -> DataFrame:
    return M.covered_share(t.orders.withColumn("priority", F.col("o_orderpriority")), F.col("o_orderstatus") == "F", ["priority"])


@query(f"""
with s as (select count(*) filter (where event_type = 'purchase') as purchase, count(*) filter (where event_type = 'error') as error
           from events where {RECENT})
select purchase, error, floor(purchase / (purchase + error) * 100 + 0.5) / 100 as rate from s""")
def a02_approval_rate(t: Tables) -> DataFrame:
    rows = t.events.where(M.since("ts", AS_OF, 30)).withColumn("one", F.lit(1))
    return M.approval(rows, "event_type", "one", "purchase", "error")


@query(f"select floor(avg(value) * 100 + 0.5) / 100 as mean from events where event_type = 'purchase' and {RECENT}")
def a03_windowed_mean(t: Tables) -> DataFrame:
    return M.mean_of(t.events.where(M.since("ts", AS_OF, 30) & (F.col("event_type") == "purchase")), "value")


@query(f"""
select props->>'$.k' as host, count(*) as total, count(*) filter (where event_type = 'error') as hits,
       floor(count(*) filter (where event_type = 'error') / count(*) * 100 + 0.5) / 100 as rate
from events where {RECENT} and props->>'$.k' is not null group by 1 order by hits desc, host limit 10""")
def a04_failure_rate_by_host(t: Tables) -> DataFrame:
    host = F.get_json_object("props", "$.k")
    return M.rate_by(t.events.where(M.since("ts", AS_OF, 30)), host, F.col("event_type") == "error", 10, "host")


@query(f"""
select event_type as field, count(*) as total, count(*) filter (where value < 50) as hits,
       floor(count(*) filter (where value < 50) / count(*) * 100 + 0.5) / 100 as rate
from events where {RECENT} group by 1 order by hits desc, field limit 10""")
def a05_rejection_rate_by_field(t: Tables) -> DataFrame:
    return M.rate_by(t.events.where(M.since("ts", AS_OF, 30)), "event_type", F.col("value") < 50, 10, "field")


HOURLY_SQL = f"""
with h as (select date_trunc('hour', ts) as hour, event_type from events where ts >= '{SINCE}' and ts < '{UNTIL}'),
p as (select hour, count(*) as purchases from h where event_type = 'purchase' group by 1),
e as (select hour, count(*) as errors from h where event_type = 'error' group by 1)"""


def _hourly(t: Tables) -> DataFrame:
    of = lambda kind, name: M.hourly(t.events.where(F.col("event_type") == kind), "ts", SINCE, UNTIL, name)
    return M.merged_series(of("purchase", "purchases"), of("error", "errors"), "hour", "purchases", "errors")


@query(HOURLY_SQL + "select strftime(hour, '%Y-%m-%d %H:%M:%S') as hour, coalesce(purchases, 0) as purchases, coalesce(errors, 0) as errors from p full join e using (hour)")
def a06_hourly_series(t: Tables) -> DataFrame:
    """Also the full outer merge of two series (j12)."""
    return _hourly(t).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query(f"""
select event_type, count(*) as n, round(count(*) / 252.0::double, 6) as per_hour
from events where ts >= '{SINCE}' and ts < '{UNTIL}' group by 1""")
def a07_rate_over_window(t: Tables) -> DataFrame:
    inside = t.events.where((F.col("ts").cast("timestamp") >= F.lit(SINCE).cast("timestamp")) & (F.col("ts").cast("timestamp") < F.lit(UNTIL).cast("timestamp")))
    return inside.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("per_hour", F.round(M.per_hour(F.col("n"), SINCE, UNTIL), 6))


@query("""
select n_name as nation, count(distinct c_custkey) as customers, count(distinct o_orderkey) as orders,
       count(distinct case when o_orderstatus = 'F' then o_orderkey end) as finished,
       strftime(max(o_orderdate), '%Y-%m-%d') as latest, round(avg(o_totalprice), 2) as mean_price
from nation join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by 1""")
def a08_counts_over_joins(t: Tables) -> DataFrame:
    """Orders are counted for each customer first, so the joins don't multiply rows."""
    of = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.max("o_orderdate").alias("d"), F.sum("o_totalprice").alias("s")
    )
    rows = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).join(of, F.col("o_custkey") == F.col("c_custkey"), "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy(F.col("n_name").alias("nation")).agg(
        F.count("c_custkey").alias("customers"), zero("n").alias("orders"), zero("f").alias("finished"), iso_date(F.max("d")).alias("latest"), F.round(F.sum("s") / F.sum("n"), 2).alias("mean_price")
    )


@query("""
with c as (select c_nationkey, o_custkey, count(*) as n, sum(o_totalprice) as s from orders join customer on o_custkey = c_custkey group by 1, 2)
select c_nationkey as nation, floor(sum(n * s) / sum(n * n) * 100 + 0.5) / 100 as weighted, floor(sum(s) / sum(n) * 100 + 0.5) / 100 as plain
from c group by 1""")
def a08_fan_out_mean(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    return M.fan_out_mean(rows, ["nation"], "o_custkey", "o_totalprice")


@query("""
select n_nationkey, (select count(*) from customer where c_nationkey = n_nationkey) as customers,
       (select count(*) from supplier where s_nationkey = n_nationkey) as suppliers,
       (select count(distinct c_mktsegment) from customer where c_nationkey = n_nationkey) as segments
from nation""")
def a09_three_counts(t: Tables) -> DataFrame:
    """Each side is counted before it is joined."""
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"), F.count_distinct("c_mktsegment").alias("segments"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    out = t.nation.select("n_nationkey").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return out.select("n_nationkey", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("customers", "suppliers", "segments")])


@query(r"""
with p as (select page_id, regexp_replace(url, '^https?://(www\.)?([^/]+).*', '\2') as domain, split_part(url, '/', 4) as lang from pages where url <> ''),
l as (select domain, lang, count(*) as n, row_number() over (partition by domain order by count(*) desc, lang) as r from p group by 1, 2)
select domain, l.lang, (select count(*) from p where p.domain = l.domain) as pages, page_id from l join p using (domain) where r = 1""")
def a10_mode_by_domain(t: Tables) -> DataFrame:
    from trellis.functions.text import raw_host

    rows = t.pages.where("url <> ''").select("page_id", raw_host("url").alias("domain"), F.coalesce(F.try_element_at(F.split("url", "/"), F.lit(4)), F.lit("")).alias("lang"))
    each = rows.groupBy("domain", "lang").agg(F.count(F.lit(1)).alias("n"))
    best = each.groupBy("domain").agg(F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("lang"), F.sum("n").alias("pages"))
    return rows.drop("lang").join(best, "domain").select("domain", "lang", "pages", "page_id")


@query("select lang, source, count(*) as n from documents group by 1, 2 order by n desc, lang, source")
def a11_group_count(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang", "source")


@query("select c_nationkey as community, max(c_name) as name, count(*) as n from customer where c_nationkey in (1, 2, 3) group by 1")
def a12_max_text(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_nationkey").isin(1, 2, 3)).groupBy(F.col("c_nationkey").alias("community")).agg(F.max("c_name").alias("name"), F.count(F.lit(1)).alias("n"))


@query(f"select user_id, count(*) as n from events where ts > timestamp '{AS_OF}' - interval 7 days group by 1 order by n desc, user_id limit 10")
def a13_most_changed(t: Tables) -> DataFrame:
    return M.most_frequent(t.events.where(M.since("ts", AS_OF, 7)), "user_id", 10)


@query("""
with a as (select props->>'$.k' as field, max(ts) as seen from events where event_type = 'view' group by 1),
b as (select props->>'$.k' as field, max(ts) as bought from events where event_type = 'purchase' group by 1)
select field, strftime(seen, '%Y-%m-%d %H:%M:%S') as seen, strftime(bought, '%Y-%m-%d %H:%M:%S') as bought from a full join b using (field)""")
def a14_latest_by_field(t: Tables) -> DataFrame:
    """The latest of each field in two series, merged (j13): both in one pass."""
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    rows = t.events.where(F.col("event_type").isin("view", "purchase")).withColumn("field", F.get_json_object("props", "$.k"))
    of = lambda kind: M.latest_by_field(rows.where(F.col("event_type") == kind), "field", "ts", {"view": "seen", "purchase": "bought"}[kind])
    return of("view").join(of("purchase"), "field", "full").select("field", shown("seen"), shown("bought"))


@query("""
select r_name as region, string_agg(n_name, ',' order by n_name) as nations, (select count(*) from customer join nation x on c_nationkey = x.n_nationkey where x.n_regionkey = r_regionkey) as customers
from region left join nation on n_regionkey = r_regionkey group by r_regionkey, r_name""")
def a15_nested_with_count(t: Tables) -> DataFrame:
    from trellis.operators.nest import nest

    packed = nest(t.region, "r_regionkey", {"nations": (t.nation, "n_regionkey", ["n_name"], ["n_name"])})
    n = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("n"))
    out = packed.join(n, "r_regionkey", "left")
    return out.select(F.col("r_name").alias("region"), F.array_join(F.transform("nations", lambda x: x["n_name"]), ",").alias("nations"), F.coalesce("n", F.lit(0)).alias("customers"))


@query("""
with a as (select l_orderkey, list(distinct l_returnflag) as f, list(distinct l_linestatus) as s from lineitem group by 1)
select l_orderkey, array_to_string(list_sort(list_distinct(list_concat(f, s))), ',') as flags, len(list_distinct(list_concat(f, s)))::bigint as n from a""")
def a17_array_union(t: Tables) -> DataFrame:
    """Also the array union of u02 and the counted keys of a18."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"), F.collect_set("l_linestatus").alias("s"))
    both = F.array_sort(F.array_distinct(F.array_union("f", "s")))
    keys = F.map_keys(F.map_from_arrays(both, both))
    return rows.select("l_orderkey", F.array_join(both, ",").alias("flags"), F.size(keys).cast("long").alias("n"))


@query("""
with r as (select case when o_orderstatus = 'F' then 'ok' when o_orderstatus = 'O' then 'skip' else 'error' end as s from orders)
select count(*) as total, count(*) filter (where s = 'ok') as ok, count(*) filter (where s = 'skip') as skipped, count(*) filter (where s = 'error') as errors,
       round(count(*) filter (where s = 'error') / count(*), 9) as failure_ratio,
       count(*) filter (where s = 'ok') = 0 or count(*) filter (where s = 'error') / count(*) > 0.5 as failed from r""")
def a19_ingestion_summary(t: Tables) -> DataFrame:
    rows = t.orders.select(F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "skip").otherwise("error").alias("s"))
    return M.ingestion_summary(rows, "s", 0.5).withColumn("failure_ratio", F.round("failure_ratio", 9))


@query("""
with l as (select source, unnest([{'f': 'text', 'v': text}, {'f': 'lang', 'v': lang}, {'f': 'n_chars', 'v': case when n_chars > 1000 then n_chars::varchar end}]) as x from documents)
select source, x.f as field, count(case when x.v <> '' then 1 end) as n, floor(count(case when x.v <> '' then 1 end) / count(*) * 100 + 0.5) / 100 as fraction from l group by 1, 2""")
def a20_field_coverage(t: Tables) -> DataFrame:
    rows = t.documents.withColumn("n_chars", F.when(F.col("n_chars") > 1000, F.col("n_chars")))
    return M.field_coverage(rows, ["source"], ["text", "lang", "n_chars"])


@query("""
with b as (select o_orderpriority as p, count(*) as before from orders where o_orderdate < '1998-01-01' group by 1),
a as (select o_orderpriority as p, count(*) as after from orders where o_orderdate >= '1998-01-01' and o_orderstatus = 'F' group by 1)
select p, coalesce(before, 0) as before, coalesce(after, 0) as after, coalesce(before, 0) > 0 and coalesce(after, 0) / before < 0.6 as dropped, coalesce(before, 0) > 0 and coalesce(after, 0) = 0 as gone
from b full join a using (p)""")
def a20_regressions(t: Tables) -> DataFrame:
    early = F.col("o_orderdate").cast("timestamp") < F.lit("1998-01-01").cast("timestamp")
    of = lambda rows: rows.groupBy(F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return M.regressions(of(t.orders.where(early)), of(t.orders.where(~early & (F.col("o_orderstatus") == "F"))), ["p"], "n")


THRESHOLDS = [0.7, 0.8, 0.85, 0.9, 0.95]


@query(f"""
with p as (select labels.doc_id, (doc_id % 100) / 100.0::double as confidence, quality = 1 as approved, case when doc_id % 3 = 0 then 'high-risk-present' else 'low-risk-only' end as class from labels),
t as (select unnest({THRESHOLDS}) as threshold)
select threshold, class, count(*) filter (where confidence >= threshold and class = 'low-risk-only') as passed,
       round(count(*) filter (where confidence >= threshold and class = 'low-risk-only' and approved) / nullif(count(*) filter (where confidence >= threshold and class = 'low-risk-only'), 0), 6) as precision,
       round(count(*) filter (where confidence >= threshold and class = 'low-risk-only') / (select count(*) from p), 6) as coverage
from p, t group by 1, 2""")
def a21_threshold_sweep(t: Tables) -> DataFrame:
    """Of changes that a machine would accept, how many people approved, for each threshold and class of fields."""
    low = F.array(F.lit(LOW_RISK[0]), F.lit(LOW_RISK[1]))
    rows = t.labels.select(
        (F.col("doc_id") % 100 / 100.0).alias("confidence"), (F.col("quality") == 1).alias("approved"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("pricing"), F.lit("city"))).otherwise(low).alias("fields"),
    )
    rows = rows.withColumn("class", F.when(F.forall("fields", lambda f: f.isin(*LOW_RISK)), "low-risk-only").otherwise("high-risk-present"))
    out = M.threshold_sweep(rows, "confidence", F.col("approved"), "class", F.col("class") == "low-risk-only", THRESHOLDS)
    return out.withColumns({"precision": F.round("precision", 6), "coverage": F.round("coverage", 6)})


@query("""
with m as (select l_returnflag, l_linestatus || '>' || case when l_discount > 0.05 then 'X' else l_linestatus end as move, count(*) as n from lineitem group by 1, 2)
select l_returnflag, string_agg(move || '=' || n, ',' order by move) as moves from m group by 1""")
def a22_transitions(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("after", F.when(F.col("l_discount") > 0.05, "X").otherwise(F.col("l_linestatus")))
    out = M.transitions(rows, ["l_returnflag"], "l_linestatus", "after")
    said = F.transform(F.map_entries("moves"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.select("l_returnflag", F.array_join(said, ",").alias("moves"))


@query("select l_orderkey, floor(avg(l_quantity / 64) * 100 + 0.5) / 100 as confidence from lineitem group by 1")
def a23_mean_confidence(t: Tables) -> DataFrame:
    """Also the mean over an item's proposals (a29)."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity") / 64).alias("c"))
    return rows.select("l_orderkey", M.mean_confidence(F.col("c")).alias("confidence"))


@query("""
with g as (select l_orderkey, min(case when l_quantity > 10 then l_quantity end) as lo, max(case when l_quantity > 10 then l_quantity end) as hi, count(*) as n, min(l_shipmode) as m
           from (select *, 'Lines ' || l_linenumber as l_shipmode from lineitem) group by 1)
select l_orderkey, case when n = 1 then m when lo is null then null else 'Ages ' || lo::integer || '-' || hi::integer end as summary from g where n = 1 or lo is not null""")
def a25_span_summary(t: Tables) -> DataFrame:
    from trellis.functions.parsers import age_summary

    age = F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("int")).otherwise(0)
    item = F.struct(age.alias("minAge"), age.alias("maxAge"), F.concat(F.lit("Lines "), F.col("l_linenumber").cast("string")).alias("label"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(item).alias("g"))
    some = (F.size("g") == 1) | F.exists("g", lambda x: x["minAge"] > 0)
    return rows.where(some).select("l_orderkey", age_summary("g").alias("summary"))


@query("""
select o_custkey, count(*) as processed, count(*) filter (where o_orderstatus = 'P') as errors,
       case when count(*) = count(*) filter (where o_orderstatus = 'P') then 'FAILED' else 'COMPLETED' end as status from orders group by 1""")
def a26_run_status(t: Tables) -> DataFrame:
    runs = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("o_orderstatus") == "P").alias("errors"))
    return runs.withColumn("status", M.run_status(F.col("processed"), F.col("errors")))


@query("select c_custkey, (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'P') as n from customer")
def a27_pending_counts(t: Tables) -> DataFrame:
    pending = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return M.counted_for(pending, t.customer.select("c_custkey"), "c_custkey")


@query("""
select case when l_returnflag = 'R' then 'batch' else 'review' end as lane, cast(sum(n) as bigint) as fields, cast(sum(k) as bigint) as selectable
from (select l_orderkey, l_returnflag, count(*) as n, count(*) filter (where l_quantity > 25) as k from lineitem group by 1, 2) group by 1""")
def a28_lane_totals(t: Tables) -> DataFrame:
    packed = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list("l_quantity").alias("f"))
    lane = F.when(F.col("l_returnflag") == "R", "batch").otherwise("review")
    return packed.groupBy(lane.alias("lane")).agg(F.sum(F.size("f")).alias("fields"), F.sum(F.size(F.filter("f", lambda x: x > 25))).alias("selectable"))


@query("select distinct l_suppkey as id from lineitem")
def a30_distinct_flattened(t: Tables) -> DataFrame:
    runs = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("ids"))
    return runs.select(F.explode("ids").alias("id")).distinct()


@query("select cast(sum(n) as bigint) as pending from (select o_custkey, count(*) as n from orders where o_orderstatus = 'P' group by 1 having count(*) > 1)")
def a31_filtered_sum(t: Tables) -> DataFrame:
    pending = t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return pending.where("n > 1").agg(F.sum("n").alias("pending"))


@query("select floor(sum(l_extendedprice) / count(*) * 100 + 0.5) / 100 as mean, floor(-2.5 + 0.5) as minus from lineitem")
def d03_half_up(t: Tables) -> DataFrame:
    return t.lineitem.agg(half_up(F.sum("l_extendedprice") / F.count(F.lit(1))).alias("mean")).withColumn("minus", half_up(F.lit(-2.5), 0))
