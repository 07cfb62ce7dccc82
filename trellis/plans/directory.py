"""Directory queries: filters, joins, nested documents and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions import predicates as P
from trellis.functions.values import iso_date
from trellis.operators import ranking, sets
from trellis.operators.nest import nest, nest_through, with_latest
from trellis.plans.registry import AS_OF, Tables, query


@query("select p_partkey, p_brand, p_size from part where p_brand = 'Brand#13' and p_size > 5")
def f01_optional_filters(t: Tables) -> DataFrame:
    """Filters that are left out, or ALL, filter nothing (also f10, f22)."""
    wanted = P.all_of(P.equals("p_brand", "Brand#13"), P.equals("p_type", P.EVERYTHING), P.in_scope("p_size", None), P.archived("p_name", "all"), F.col("p_size") > 5)
    return t.part.where(wanted).select("p_partkey", "p_brand", "p_size")


@query("""
select 'some' as scope, count(*) as n from supplier where s_nationkey in (1, 2) union all select 'empty', count(*) from supplier
union all select 'strict empty', 0 union all select 'strict one', count(*) from supplier where s_nationkey = 3 union all select 'strict none', count(*) from supplier""")
def f02_scopes(t: Tables) -> DataFrame:
    """An empty scope filters nothing in one reading, and everything in the strict one (f03)."""
    s = t.supplier.withColumn("nation", F.col("s_nationkey").cast("string"))
    scopes = {"some": P.in_scope("nation", ["1", "2"]), "empty": P.in_scope("nation", []), "strict empty": P.in_strict_scope("nation", []), "strict one": P.in_strict_scope("nation", "3"), "strict none": P.in_strict_scope("nation", None)}
    counts = s.agg(*[F.count_if(P.all_of(c)).alias(name) for name, c in scopes.items()])
    return counts.unpivot([], list(scopes), "scope", "n")


@query("select p_partkey, p_name from part where contains(lower(coalesce(p_name, '') || ' ' || coalesce(p_brand, '') || ' ' || coalesce(p_type, '')), 'widget brand#1')")
def f04_text_search(t: Tables) -> DataFrame:
    return t.part.where(P.mentions("Widget BRAND#1", "p_name", "p_brand", "p_type")).select("p_partkey", "p_name")


def _documents(t: Tables) -> DataFrame:
    """Orders with their lines as an array."""
    fields = ["l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]
    return nest(t.orders, "o_orderkey", {"lines": (t.lineitem, "l_orderkey", fields, ["l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"])})


@query("""
select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and coalesce(l_linenumber, 0) <= 20 and coalesce(nullif(l_quantity, 50), 99) >= 45)""")
def f05_overlapping_spans(t: Tables) -> DataFrame:
    items = F.transform("lines", lambda x: F.struct(x["l_linenumber"].alias("lo"), F.nullif(x["l_quantity"], F.lit(50)).alias("hi")))
    return _documents(t).where(P.overlaps(items, "lo", "hi", 45, 20)).select("o_orderkey")


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def f06_has_member(t: Tables) -> DataFrame:
    return _documents(t).where(P.has_member(F.transform("lines", lambda x: x["l_returnflag"]), "R")).select("o_orderkey")


@query("select o_orderkey from orders left join (select l_orderkey, min(l_extendedprice) as p from lineitem group by 1) on l_orderkey = o_orderkey where p is null or p <= 2000")
def f07_price_cap(t: Tables) -> DataFrame:
    return _documents(t).where(P.costs_at_most("lines", "l_extendedprice", 2000.0)).select("o_orderkey")


@query("select distinct l_orderkey as o_orderkey from lineitem join orders on o_orderkey = l_orderkey where l_shipdate = '1997-10-31'")
def f08_item_on_day(t: Tables) -> DataFrame:
    day = F.transform("lines", lambda x: F.struct(iso_date(x["l_shipdate"]).alias("d")))
    return _documents(t).where(P.some_item_is(day, "d", "1997-10-31")).select("o_orderkey")


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders where o_orderdate::date between date '1997-07-01' and date '1997-07-08' and o_orderstatus in ('O', 'P')")
def f09_due_soon(t: Tables) -> DataFrame:
    """Also days as text (f17)."""
    return t.orders.where(P.due_soon("o_orderdate", "1997-07-01") & F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", iso_date("o_orderdate").alias("day"))


@query("select p_partkey from part where p_brand <> 'Brand#1' and p_size in (1, 2, 3) and (nullif(p_type, 'ECONOMY') is null or nullif(p_type, 'ECONOMY') = '')")
def f11_null_predicates(t: Tables) -> DataFrame:
    kind = F.nullif("p_type", F.lit("ECONOMY"))
    return t.part.where((F.col("p_brand") != "Brand#1") & F.col("p_size").isin(1, 2, 3) & P.is_blank(kind)).select("p_partkey")


@query("select c_custkey, c_name from customer where c_name ilike '%MER#00000001%'")
def f12_name_like(t: Tables) -> DataFrame:
    return t.customer.where(P.name_like("c_name", "MER#00000001")).select("c_custkey", "c_name")


@query("select s_suppkey, substr(s_name, 10) as rest from supplier where s_name like 'Supplier#%'")
def f13_prefix(t: Tables) -> DataFrame:
    begins, rest = P.with_prefix("s_name", "Supplier#")
    return t.supplier.where(begins).select("s_suppkey", rest.alias("rest"))


@query("select event_id, props->>'$.k' as k from events where props->>'$.k' is not null and event_type = 'signup'")
def f14_json_path(t: Tables) -> DataFrame:
    rows = t.events.where("event_type = 'signup'").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return rows.where("k is not null")


PRIORITY_SQL = f"""
with c as (select event_id, user_id, case when event_id % 4 = 0 then null else ts end as seen, nullif(event_type, 'view') as description, case when event_id % 3 = 0 then 'UNKNOWN' when event_id % 3 = 1 then 'COMING_SOON' else 'OPEN' end as status,
                  case when event_id % 5 = 0 then 'PLACEHOLDER' when event_id % 5 = 1 then 'STALE' else 'VERIFIED' end as confidence from events),
m as (select *, (description is null)::int + (status = 'UNKNOWN')::int as missing from c)
select event_id, missing, least(180, coalesce(trunc(epoch(timestamp '{AS_OF}' - seen) / 86400)::int, 180)) + 30 * missing
       + case confidence when 'PLACEHOLDER' then 50 when 'STALE' then 25 else 0 end + case when status = 'COMING_SOON' then 40 else 0 end as score, strftime(seen, '%Y-%m-%d') as day from m"""


def _candidates(t: Tables) -> DataFrame:
    e = F.col("event_id")
    rows = t.events.select(
        "event_id", F.when(e % 4 != 0, F.col("ts")).alias("at"), F.nullif("event_type", F.lit("view")).alias("description"),
        F.when(e % 3 == 0, "UNKNOWN").when(e % 3 == 1, "COMING_SOON").otherwise("OPEN").alias("status"), F.when(e % 5 == 0, "PLACEHOLDER").when(e % 5 == 1, "STALE").otherwise("VERIFIED").alias("confidence"),
    )
    rows = rows.withColumn("missing", P.missing_count(P.is_blank("description"), F.col("status") == "UNKNOWN"))
    return rows.withColumn("score", P.crawl_priority(F.lit(AS_OF), "at", F.col("missing"), "confidence", "status"))


@query(PRIORITY_SQL + " order by score desc, m.seen asc nulls first, event_id limit 200")
def f16_crawl_priority(t: Tables) -> DataFrame:
    """Whole days, missing fields (f15, d01) and the nulls-first order of t05."""
    top = _candidates(t).orderBy(F.desc("score"), F.asc_nulls_first("at"), "event_id").limit(200)
    return top.select("event_id", "missing", "score", iso_date("at").alias("day"))


@query("select o_orderkey as saved_id, c_custkey as camp_id, c_name as name from orders join customer on c_custkey = o_custkey")
def f18_names_kept_apart(t: Tables) -> DataFrame:
    """Of two columns with one name each gets a name of its own."""
    saved = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey")
    camps = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return saved.alias("s").join(camps.alias("c"), F.col("s.o_custkey") == F.col("c.id")).select(F.col("s.id").alias("saved_id"), F.col("c.id").alias("camp_id"), "name")


@query("select n_name, case n_name when 'NATION_7' then 0 when 'NATION_3' then 1 end as place from nation where n_name in ('NATION_7', 'NATION_3')")
def f19_picked(t: Tables) -> DataFrame:
    return ranking.picked(t.nation, "n_name", ["NATION_7", "NATION_3", "nowhere", "NATION_1"]).select("n_name", "place")


@query("select o_orderkey, coalesce((select l_returnflag from lineitem where l_orderkey = o_orderkey order by l_linenumber, l_quantity, l_extendedprice, l_returnflag limit 1), o_orderstatus) as kind from orders")
def f20_first_or_scalar(t: Tables) -> DataFrame:
    return _documents(t).select("o_orderkey", P.first_or(F.transform("lines", lambda x: x["l_returnflag"]), "o_orderstatus").alias("kind"))


@query("""
select l_orderkey from lineitem join supplier on s_suppkey = l_suppkey group by 1 having bool_and(s_nationkey::varchar in ('1', '2', '3', '4', '5', '6', '7', '8', '9', '10', '11', '12'))""")
def f23_owned_within(t: Tables) -> DataFrame:
    """Runs whose ids all belong to allowed groups."""
    runs = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("ids"))
    owners = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("string").alias("nation"))
    return sets.owned_within(runs, "l_orderkey", "ids", owners, "s_suppkey", "nation", [str(i) for i in range(1, 13)]).select("l_orderkey")


@query("select page_id from pages where contains(lower(url), 'example.org')")
def f24_domain_within(t: Tables) -> DataFrame:
    return t.pages.where(P.name_like("url", "example.org")).select("page_id")


@query("select l_orderkey, l_linenumber, o_totalprice, c_name from lineitem join orders on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey where l_quantity > 45")
def j01_inner_and_left(t: Tables) -> DataFrame:
    """Inner and left equi-joins (j02); Spark picks the strategy from sizes (j11)."""
    rows = t.lineitem.where("l_quantity > 45").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left").select("l_orderkey", "l_linenumber", "o_totalprice", "c_name")


@query("""
select o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey) as n,
       coalesce((select string_agg(l_linenumber || ':' || l_quantity::int, ',' order by l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_shipdate) from lineitem where l_orderkey = o_orderkey), '') as lines from orders""")
def j03_nested_documents(t: Tables) -> DataFrame:
    """Parents with ordered arrays of children (a16), rendered as text; parents without children stay."""
    said = F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_quantity"].cast("int").cast("string")))
    return _documents(t).select("o_orderkey", F.size("lines").cast("long").alias("n"), F.array_join(said, ",").alias("lines"))


@query("""
select n_nationkey, coalesce((select string_agg(c_custkey::varchar, ',' order by c_custkey) from customer where c_nationkey = n_nationkey), '') as customers,
       coalesce((select string_agg(s_suppkey::varchar, ',' order by s_suppkey) from supplier where s_nationkey = n_nationkey), '') as suppliers from nation""")
def j04_two_kinds_of_children(t: Tables) -> DataFrame:
    """Two kinds of children, each packed before it is joined."""
    packed = nest(t.nation, "n_nationkey", {"c": (t.customer, "c_nationkey", ["c_custkey"], ["c_custkey"]), "s": (t.supplier, "s_nationkey", ["s_suppkey"], ["s_suppkey"])})
    said = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), ",")
    return packed.select("n_nationkey", said("c", "c_custkey").alias("customers"), said("s", "s_suppkey").alias("suppliers"))


@query("""
select c_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from customer left join
  (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) on o_custkey = c_custkey and r = 1""")
def j05_latest_of_each(t: Tables) -> DataFrame:
    """Each customer's latest order (t07), by one aggregation."""
    out = with_latest(t.customer.select("c_custkey"), "c_custkey", t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate"])
    return out.select("c_custkey", "o_orderkey", iso_date("o_orderdate").alias("day"))


@query("select source, word, count(*) as n from (select source, unnest(string_split(lang || ' ' || source, ' ')) as word from documents) group by 1, 2")
def j06_exploded(t: Tables) -> DataFrame:
    words = t.documents.select("source", F.explode(F.split(F.concat_ws(" ", "lang", "source"), " ")).alias("word"))
    return words.groupBy("source", "word").agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def j07_without_pending(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 4)")
def j08_semi_join(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.where("c_nationkey = 4").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


@query("""
select p_partkey, coalesce((select string_agg(s_name, ',' order by s_name) from (select distinct l_suppkey from lineitem where l_partkey = p_partkey) join supplier on s_suppkey = l_suppkey), '') as suppliers from part""")
def j09_through_links(t: Tables) -> DataFrame:
    """Many to many, over a table of links."""
    out = nest_through(t.part, "p_partkey", t.lineitem, "l_partkey", "l_suppkey", t.supplier, "s_suppkey", "s", ["s_name"], ["s_name"])
    return out.select("p_partkey", F.array_join(F.transform("s", lambda x: x["s_name"]), ",").alias("suppliers"))


@query("select l_orderkey, l_linenumber from lineitem where (l_orderkey, l_linenumber) in (select o_orderkey, (o_orderkey % 4)::int + 1 from orders where o_orderstatus = 'P')")
def j10_composite_lookup(t: Tables) -> DataFrame:
    wanted = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("l_linenumber"))
    return sets.matching_any(t.lineitem, wanted, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


SESSIONS_SQL = """
with old as (select lower(trim(o_orderpriority)) || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || strftime(o_orderdate, '%Y-%m-%d') as key, min(o_orderkey) as id from orders where o_orderkey % 2 = 0 group by 1),
new as (select distinct lower(trim(o_orderpriority)) || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || strftime(o_orderdate, '%Y-%m-%d') as key from orders where o_orderkey % 3 = 0)"""


def _reconciled(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("day", iso_date("o_orderdate")).withColumn("key", sets.session_key("o_orderpriority", "day", "day"))
    return sets.reconcile(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 3 = 0"), "key", "o_orderkey")


@query(SESSIONS_SQL + "select key, id, case when old.key is null then 'created' when new.key is null then 'orphaned' else 'matched' end as state from old full join new using (key)")
def j16_reconciled(t: Tables) -> DataFrame:
    """Existing against incoming by a natural key (n27)."""
    return _reconciled(t)


@query("select c_nationkey as k, max(n) as n from (select c_nationkey, 'customer' as n from customer union all select s_nationkey, 'supplier' from supplier) group by 1")
def u01_union_by_key(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("n")).distinct()
    b = t.supplier.select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("n")).distinct()
    return sets.union_by_key(["k"], a, b)


@query("""
with a as (select c_nationkey as k, count(*) as c from customer group by 1), b as (select s_nationkey as k, count(*) as c from supplier group by 1)
select k, coalesce(b.c, 0) as n_current, coalesce(a.c, 0) as n_candidate, greatest(coalesce(a.c, 0) - coalesce(b.c, 0), 0) as added, greatest(coalesce(b.c, 0) - coalesce(a.c, 0), 0) as removed
from a full join b using (k) where coalesce(a.c, 0) <> coalesce(b.c, 0)""")
def u04_multiset_difference(t: Tables) -> DataFrame:
    return sets.multiset_difference(t.supplier.select(F.col("s_nationkey").alias("k")), t.customer.select(F.col("c_nationkey").alias("k")), ["k"])


@query("select l_orderkey, array_to_string(list_sort(list_filter(list_distinct(list(l_returnflag)), lambda x: not list_contains(list_distinct(list(l_linestatus)), x))), ',') as rest from lineitem group by 1")
def u03_array_difference(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    return rows.select("l_orderkey", F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("rest"))


@query("select distinct o_orderpriority as community from orders")
def u05_distinct(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderpriority").alias("community")).distinct()


@query("select s_suppkey, s_suppkey in (select l_suppkey from lineitem where l_quantity >= 49) as kept from supplier")
def u06_keep_listed(t: Tables) -> DataFrame:
    kept, gone = sets.keep_listed(t.supplier.select("s_suppkey"), t.lineitem.where("l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey")
    return kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))


@query("""
with old as (select s_suppkey as k, s_name as name, nullif(s_name, 'Supplier#000000003') as note from supplier),
new as (select c_custkey as k, c_name as name, c_mktsegment as note from customer)
select coalesce(old.k, new.k) as k, case when new.k is null then old.name else coalesce(new.name, old.name) end as name, case when new.k is null then old.note when old.k is null then new.note when coalesce(old.note, '') = '' then new.note else old.note end as note
from old full join new on old.k = new.k""")
def s11_upsert(t: Tables) -> DataFrame:
    old = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.nullif("s_name", F.lit("Supplier#000000003")).alias("note"))
    new = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("note"))
    return sets.upsert(old, new, ["k"], {"name": "keep", "note": "fill"})


@query("""
with old as (select s_suppkey as k, s_name as name from supplier), new as (select c_custkey as k, min(c_name) as name from customer group by 1)
select k, name from old union all select k, name from new where k not in (select k from old)""")
def s11_insert_new(t: Tables) -> DataFrame:
    old = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return sets.insert_new(old, t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), ["k"])


@query("""
select s_suppkey, case when s_suppkey % 2 = 0 then 'a=' || (s_suppkey + 1)::varchar || ',b=' || s_name || ',c=new' else 'a=' || s_suppkey::varchar || ',b=' || s_name end as sources from supplier""")
def s12_merged_maps(t: Tables) -> DataFrame:
    from trellis.functions.values import merge_maps

    k = F.col("s_suppkey")
    left = F.create_map(F.lit("a"), k.cast("string"), F.lit("b"), F.col("s_name"))
    right = F.when(k % 2 == 0, F.create_map(F.lit("a"), (k + 1).cast("string"), F.lit("c"), F.lit("new")))
    said = F.transform(F.sort_array(F.map_entries(merge_maps(left, right))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return t.supplier.select("s_suppkey", F.array_join(said, ",").alias("sources"))
