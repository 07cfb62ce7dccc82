"""Orders, pages, first rows of each key and both ends of a list, on the driver's tables."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.values import iso_date
from trellis.operators import nest, ranking
from trellis.plans.registry import AS_OF, Tables, query


@query("select o_custkey, o_orderkey, rank::int as rank from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rank from orders) where rank <= 20")
def w01_newest_of_each(t: Tables) -> DataFrame:
    return nest.first_of_each(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 20).select("o_custkey", "o_orderkey", "rank")


@query(f"""
with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn, count(*) over (partition by user_id) as failures
           from events where event_type = 'error' and ts > timestamp '{AS_OF}' - interval 45 days)
select user_id, event_id, failures, strftime(ts, '%Y-%m-%d %H:%M:%S') as latest from r where rn = 1""")
def w02_latest_failure(t: Tables) -> DataFrame:
    """Also over sources that have no owner (w03)."""
    from trellis.operators.metrics import since

    rows = t.events.where((F.col("event_type") == "error") & since("ts", AS_OF, 45))
    out = nest.first_with_count(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], "failures")
    return out.select("user_id", "event_id", "failures", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("""
with h as (select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 500)
select o_orderkey, (row_number() over w)::int as place, lag(o_orderkey) over w as previous_o_orderkey, lead(o_orderkey) over w as next_o_orderkey from h window w as (order by o_totalprice desc, o_orderkey)""")
def w04_neighbours(t: Tables) -> DataFrame:
    out = nest.neighbours(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], "o_orderkey", 500)
    return out.select("o_orderkey", "place", "previous_o_orderkey", "next_o_orderkey")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 50")
def t01_page(t: Tables) -> DataFrame:
    return ranking.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 25, 50)


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 40 offset 5000")
def t01_deep_page(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ranking.in_pages(rows, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]).page(40, 5000)


@query("select count(*) as total from orders")
def t01_total(t: Tables) -> DataFrame:
    return ranking.total(t.orders)


@query("""
select o_orderkey, o_totalprice from (select * from orders order by o_totalprice desc, o_orderkey limit 100)
union select o_orderkey, o_totalprice from (select * from orders order by o_totalprice, o_orderkey limit 100)""")
def t02_both_ends(t: Tables) -> DataFrame:
    return ranking.both_ends(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 100)


@query("""
select p_partkey, (row_number() over (order by case when p_brand = 'Brand#13' then 0 else 1 end, p_name, p_partkey))::int as place from part
qualify place <= 300""")
def t03_verified_first(t: Tables) -> DataFrame:
    rows = t.part.orderBy(*ranking.verified_first(F.col("p_brand") == "Brand#13", F.asc("p_name"), F.asc("p_partkey"))).limit(300)
    return nest.neighbours(rows, ranking.verified_first(F.col("p_brand") == "Brand#13", F.asc("p_name"), F.asc("p_partkey")), "p_partkey", 300).select("p_partkey", "place")


@query("""
select o_orderkey, (row_number() over (order by case o_orderstatus when 'P' then 0 when 'O' then 1 else 100 end, o_orderkey))::int as place from orders qualify place <= 200""")
def t04_custom_order(t: Tables) -> DataFrame:
    order = [ranking.by_rank("o_orderstatus", ["P", "O"]).asc(), F.asc("o_orderkey")]
    return nest.neighbours(t.orders, order, "o_orderkey", 200).select("o_orderkey", "place")


@query("""
select o_orderkey, day from (select o_orderkey, case when o_orderkey % 40 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') end as day from orders where o_orderstatus = 'O')
where day is null or day > '1999-06-01' order by day nulls last, o_orderkey limit 6""")
def t06_opening_soon(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "COMING_SOON").alias("status"), F.when(F.col("o_orderkey") % 40 != 0, iso_date("o_orderdate")).alias("day"))
    return ranking.opening_soon(rows, "status", "day", "1999-06-01", "o_orderkey").select("o_orderkey", "day")


@query("select c_custkey, case when c_custkey % 2 = 0 then 'name,city,' || lower(c_mktsegment) || ',zoo' else 'name,pricing' end as fields from customer")
def t09_fields_by_rank(t: Tables) -> DataFrame:
    even = F.array(F.lit("zoo"), F.lit("city"), F.lower("c_mktsegment"), F.lit("name"))
    items = F.when(F.col("c_custkey") % 2 == 0, even).otherwise(F.array(F.lit("pricing"), F.lit("name")))
    return t.customer.select("c_custkey", F.array_join(ranking.ranked_items(items, ranking.FIELD_RANKS), ",").alias("fields"))


@query("""
with s as (select source, doc_id, n_chars, sha256(coalesce(text, '')) as h from documents)
select source, doc_id, rank::int as rank, substr(h, 1, 8) as h from (select *, row_number() over (partition by source order by n_chars desc, h desc, doc_id) as rank from s) where rank <= 3""")
def t10_newest_snapshots(t: Tables) -> DataFrame:
    """Snapshots by time, then hash; content hashes (d12, s09)."""
    from trellis.functions.values import content_hash

    rows = t.documents.select("source", "doc_id", "n_chars", content_hash(F.coalesce("text", F.lit(""))).alias("h"))
    out = nest.first_of_each(rows, ["source"], [F.desc("n_chars"), F.desc("h"), F.asc("doc_id")], 3)
    return out.select("source", "doc_id", "rank", F.substring("h", 1, 8).alias("h"))


@query("select sha256(n_name) as h, n_name from nation where n_name = 'NATION_7'")
def t10_by_prefix(t: Tables) -> DataFrame:
    """The only snapshot whose hash begins so."""
    rows = t.nation.select(F.sha2("n_name", 256).alias("h"), "n_name")
    return nest.by_digest_prefix(rows, "h", sha256(b"NATION_7").hexdigest()[:12]).select("h", "n_name")
