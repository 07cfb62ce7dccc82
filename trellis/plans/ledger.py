"""Differences, matching, folds, the review queue and the trust ledger on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions import text as X
from trellis.functions.values import iso_date
from trellis.operators import diff, folds, matching, ranking, review, trust
from trellis.operators.spread import tasks_for
from trellis.plans.registry import AS_OF, Tables, query

OLD_NEW = """
with f as (select p_partkey, 'name' as field, case when p_partkey % 7 = 0 then null else p_name end as old, case when p_partkey % 3 = 0 then ' ' || upper(p_name) when p_partkey % 3 = 1 then p_name || ' x' end as new from part
  union all select p_partkey, 'brand', p_brand, case when p_partkey % 5 < 3 then p_type else p_brand end from part),
c as (select *, (p_partkey % 10) / 10.0 as confidence, case when p_partkey % 4 = 0 then timestamp '2024-01-20' when p_partkey % 4 = 1 then timestamp '2023-11-01' end as approved_at from f),
m as (select p_partkey, field, confidence, case when confidence < 0.3 or new is null or lower(trim(coalesce(old, ''))) = lower(trim(new)) then 'none'
  when approved_at is not null and epoch(timestamp '2024-01-31' - approved_at) / 86400 < 30 and confidence < 0.8 then 'suppressed' when coalesce(old, '') = '' then 'populate' else 'update' end as mode from c)"""


def _changes(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    name = t.part.select("p_partkey", F.lit("name").alias("field"), F.when(k % 7 != 0, F.col("p_name")).alias("old"), F.when(k % 3 == 0, F.concat(F.lit(" "), F.upper("p_name"))).when(k % 3 == 1, F.concat("p_name", F.lit(" x"))).alias("new"))
    brand = t.part.select("p_partkey", F.lit("brand").alias("field"), F.col("p_brand").alias("old"), F.when(k % 5 < 3, F.col("p_type")).otherwise(F.col("p_brand")).alias("new"))
    at = F.when(k % 4 == 0, F.lit("2024-01-20").cast("timestamp")).when(k % 4 == 1, F.lit("2023-11-01").cast("timestamp"))
    return diff.scalar_changes(name.unionByName(brand).withColumns({"confidence": k % 10 / 10.0, "approved_at": at}), AS_OF)


@query(OLD_NEW + " select p_partkey, field, mode from m")
def n01_scalar_changes(t: Tables) -> DataFrame:
    """The diff of plain fields, compared in one form (n02)."""
    return _changes(t).select("p_partkey", "field", "mode")


@query(OLD_NEW + " select p_partkey, count(*) as changes, floor(avg(confidence) * 100 + 0.5) / 100 as confidence from m where mode not in ('none', 'suppressed') group by 1")
def n01_overall_confidence(t: Tables) -> DataFrame:
    return diff.overall_confidence(_changes(t), ["p_partkey"])


@query("""
with o as (select l_orderkey as k, l_returnflag || '|' || l_quantity::int as i, count(*) as a from lineitem where l_linenumber <= 3 group by 1, 2), n as (select l_orderkey as k, l_returnflag || '|' || l_quantity::int as i, count(*) as b from lineitem where l_linenumber >= 2 or l_orderkey % 2 = 0 group by 1, 2),
d as (select k, coalesce(a, 0) as a, coalesce(b, 0) as b from o full join n using (k, i)),
g as (select k, sum(a) as olds, sum(b) as news, sum(greatest(b - a, 0)) as added, sum(greatest(a - b, 0)) as removed, bool_or(a = 0 and b > 0) as novel from d group by 1)
select k, case when news = 0 or added + removed = 0 then 'none' when olds = 0 then 'populate' when removed = 0 and news > olds and novel then 'add_items' else 'update' end as mode, added::int as added, removed::int as removed from g""")
def n03_relation_changes(t: Tables) -> DataFrame:
    """Prices as multisets of keys: what was added, what was removed, and whether all stayed (n04)."""
    item = F.struct(F.col("l_returnflag").alias("label"), F.col("l_quantity").cast("int").cast("double").alias("amount"), F.lit("PER_WEEK").alias("unit"), F.lit(None).cast("double").alias("durationWeeks"), F.lit(None).cast("string").alias("ageQualifier"), F.lit(None).cast("string").alias("discountNotes"), F.col("l_partkey").alias("id"))
    old = F.collect_list(F.when(F.col("l_linenumber") <= 3, item))
    new = F.collect_list(F.when((F.col("l_linenumber") >= 2) | (F.col("l_orderkey") % 2 == 0), item))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(old.alias("old"), new.alias("new"))
    rows = rows.withColumns({"confidence": F.lit(0.9), "approved_at": F.lit(None).cast("timestamp")})
    return diff.relation_changes(rows, "pricing", AS_OF).select("k", "mode", "added", "removed")


@query("""
select p_partkey, case p_partkey % 4 when 3 then 'unsupported-field-not-proposed:' || p_partkey || ':other' when 2 then 'removal-not-proposed:' || p_partkey || ':city' end as warning,
       case p_partkey % 4 when 0 then 'populate' when 1 then 'add_items' end as mode from part""")
def n29_events_to_changes(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    events = t.part.select(
        "p_partkey", F.lit("field-changed").alias("kind"), F.col("p_partkey").cast("string").alias("entity"), F.when(k == 3, "other").otherwise("city").alias("field"), F.lit(None).cast("string").alias("old"), F.when(k != 2, F.col("p_name")).alias("new"),
        F.lit(0.9).alias("confidence"), F.when(k == 0, "value-populated").when(k == 1, "items-added").otherwise("value-updated").alias("change_kind"),
    )
    return diff.events_to_changes(events, ["city"]).select("p_partkey", "warning", "mode")


@query("""
with c as (select p_partkey, p_brand as old, case when p_partkey % 2 = 0 then p_type end as new, p_partkey % 3 = 0 as ok, case when p_partkey % 5 = 0 then '' else p_brand end as value from part)
select p_partkey, value as old, new, case when value = '' then 'FIELD_POPULATED' else 'FIELD_UPDATED' end as change from c where new is not null and ok""")
def n19_change_log(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    current = t.part.select("p_partkey", F.lit("brand").alias("field"), F.when(k % 5 == 0, "").otherwise(F.col("p_brand")).alias("value"))
    changes = t.part.where(k % 2 == 0).select("p_partkey", F.lit("brand").alias("field"), F.col("p_brand").alias("old"), F.col("p_type").alias("new"))
    _, log = diff.apply_approved(current, changes, t.part.where(k % 3 == 0).select("p_partkey", F.lit("brand").alias("field")), ["p_partkey"])
    return log.select("p_partkey", "old", "new", "change")


BIGRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"


def _a(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("a"))


def _b(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("other"), F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("b"))


NAMES_SQL = rf"""
with l as (select p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')) as n from part),
r as (select p_partkey as other, trim(regexp_replace(lower(p_type || ' ' || p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) as n from part),
a as (select n, {BIGRAMS.format("n")} as x from (select distinct n from l)), b as (select n, {BIGRAMS.format("n")} as y from (select distinct n from r)),
s as (select a.n as ln, b.n as rn, 2.0::double * len(list_intersect(x, y)) / (len(x) + len(y)) as score from a, b)"""


@query(NAMES_SQL + " select p_partkey, other, round(score, 9) as score from s join l on l.n = ln join r on r.n = rn where score >= 0.8")
def j14_near_names(t: Tables) -> DataFrame:
    """All pairs of parts at 0.8 and more, their names written in two ways; found on shared rare bigrams."""
    return matching.near_names(_a(t), "p_partkey", "a", _b(t), "other", "b", 0.8, digits=9)


@query(NAMES_SQL + " select p_partkey from l where not exists (select 1 from s where s.ln = l.n and score >= 0.9)")
def n32_new_names(t: Tables) -> DataFrame:
    return matching.new_names(_a(t), "p_partkey", "a", _b(t), "b", 0.9, X.match_name).select("p_partkey")


def _candidates(t: Tables, known: bool) -> DataFrame:
    """Parts as candidates; those of a small size are the providers that are known."""
    k, small = F.col("p_partkey"), F.col("p_size") <= 5
    site = F.when(k % 4 == 0, F.concat(F.lit("s"), (k % 6000).cast("string"), F.lit(".example.org")))
    return t.part.where(small if known else ~small).select(k.alias("id"), k.alias("seq"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"), site.alias("domain"))


CANDIDATES_SQL = rf"""
with p as (select p_partkey as id, p_size, p_name || ' ' || p_brand || ' ' || p_type as name, case when p_partkey % 4 = 0 then 's' || (p_partkey % 6000) || '.example.org' end as domain from part),
k as (select *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) as key from p),
v as (select * from k where p_size <= 5), c as (select * from k where p_size > 5),
e as (select id, min(m) as m from (select c.id, v.id as m from c join v on c.key = v.key union all select c.id, v.id from c join v on c.domain = v.domain) group by 1),
cn as (select key, {BIGRAMS.format("key")} as g from (select distinct key from c)), vn as (select key, {BIGRAMS.format("key")} as g, min(id) as id from v group by 1, 2),
n as (select cn.key, vn.id as m, 2.0::double * len(list_intersect(cn.g, vn.g)) / (len(cn.g) + len(vn.g)) as s from cn, vn),
b as (select key, m, s, row_number() over (partition by key order by s desc, m) as r from n where s >= 0.8 and s < 1)"""


@query(
    CANDIDATES_SQL
    + """ select c.id, case when e.m is not null then 'exact-duplicate' when b.m is not null then 'near-duplicate' else 'new' end as kind, coalesce(e.m, b.m) as matched from c left join e on e.id = c.id left join b on b.key = c.key and b.r = 1"""
)
def n09_verdicts(t: Tables) -> DataFrame:
    c = _candidates(t, False)
    return matching.verdicts(c, _candidates(t, True), c.limit(0)).select("id", "kind", "matched")


@query(
    CANDIDATES_SQL.replace("with p as", "with recursive p as")
    + """,
o as (select c.*, row_number() over (order by c.id) as i from c left join e on e.id = c.id where e.m is null),
run(i, ids, domains, keys, id, hit) as (
  select 0::bigint, []::bigint[], []::varchar[], []::varchar[], null::bigint, null::bigint
  union all
  select o.i, case when place is null then list_append(ids, o.id) else ids end, case when place is null then list_append(domains, coalesce(o.domain, '')) else domains end,
         case when place is null then list_append(keys, coalesce(o.key, '')) else keys end, o.id, ids[place]
  from (select run.*, least(case when o.domain <> '' then nullif(list_position(run.domains, o.domain), 0) end, case when o.key <> '' then nullif(list_position(run.keys, o.key), 0) end) as place
        from run join o on o.i = run.i + 1) x join o on o.i = x.i + 1)
select c.id, case when e.m is not null or run.hit is not null then 'exact-duplicate' when b.m is not null then 'near-duplicate' else 'new' end as kind, coalesce(e.m, run.hit, b.m) as matched,
       case when e.m is null and run.hit is null then round(b.s, 9) end as score
from c left join e on e.id = c.id left join run on run.id = c.id left join (select key, m, s, r from b) b on b.key = c.key and b.r = 1"""
)
def n10_discovery_run(t: Tables) -> DataFrame:
    """Candidates that are accepted join the queue for later ones."""
    return matching.discover(_candidates(t, False), _candidates(t, True)).withColumn("score", F.round("score", 9))


@query(r"""
with w as (select p_partkey as id, p_size, p_name || ' ' || p_brand as name from part),
n as (select distinct name, list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') as ws from w),
g as (select name, list_distinct(flatten(list_transform(ws, lambda w: list_transform(range(1, length('  ' || w || ' ') - 1), lambda i: substr('  ' || w || ' ', i, 3))))) as t from n),
s as (select a.name as x, b.name as y, len(list_intersect(a.t, b.t))::double / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) as score from g a, g b where len(list_intersect(a.t, b.t)) > 0),
f as (select s.x, w.id as other, score from s join w on w.name = s.y where p_size <= 5),
r as (select *, (row_number() over (partition by x order by score desc, other))::int as rank from f qualify rank <= 5)
select w.id, other, rank, round(score, 9) as score from w join r on r.x = w.name where p_size > 5""")
def t08_most_alike(t: Tables) -> DataFrame:
    """Of each part the five small ones whose names share most trigrams."""
    name = F.concat_ws(" ", "p_name", "p_brand").alias("name")
    a, b = t.part.where("p_size > 5").select(F.col("p_partkey").alias("id"), name), t.part.where("p_size <= 5").select(F.col("p_partkey").alias("other"), name)
    return matching.most_alike(a, "id", "name", b, "other", "name").withColumn("score", F.round("score", 9))


TRIGRAMS = r"list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''), lambda w: list_transform(range(1, length('  ' || w || ' ') - 1), lambda i: substr('  ' || w || ' ', i, 3)))))"
SITE = "case when {0} % 4 = 0 then 's' || ({0} % 60) || '.example.org' else '' end"


@query(rf"""
with a as (select p_partkey as id, p_name || ' ' || p_brand as name, {SITE.format("p_partkey")} as url from part),
b as (select s_suppkey as camp_id, s_name as name, {SITE.format("s_suppkey")} as url from supplier union all
      select 1000000 + p_partkey, case when p_partkey % 3 = 0 then p_brand || ' ' || p_name else p_name || 's ' || p_brand || '0' end, '' from part where p_partkey % 20 = 3),
x as (select name, t, {BIGRAMS.format("plain")} as g from (select distinct name, {TRIGRAMS} as t, trim(regexp_replace(lower(name), '[^a-z0-9\s]', '', 'g')) as plain from a)),
y as (select camp_id, t, {BIGRAMS.format("plain")} as g from (select camp_id, {TRIGRAMS} as t, trim(regexp_replace(lower(name), '[^a-z0-9\s]', '', 'g')) as plain from b)),
s as (select x.name, camp_id, len(list_intersect(x.t, y.t)) as c, len(x.t) as m, len(y.t) as n, 2.0::double * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)) as dice from x, y),
f as (select name, camp_id, dice, row_number() over (partition by name order by c::double / (m + n - c) desc, camp_id) as r from s where c > 0 qualify r <= 5),
k as (select name, min_by(camp_id, r) as alike from f where dice > 0.75 group by 1),
u as (select url, min(camp_id) as same from b where url <> '' group by 1)
select id, case when same is not null then 'skipped' when alike is not null then 'flagged' else 'created' end as action, coalesce(same, alike) as camp_id
from a left join u using (url) left join k using (name)""")
def n11_match_or_create(t: Tables) -> DataFrame:
    """All parts are listings; suppliers, whose sites have the same names, and some parts with their names turned or changed are the camps that are known."""
    k = F.col("p_partkey")
    site = lambda k: F.when(k % 4 == 0, F.concat(F.lit("s"), (k % 60).cast("string"), F.lit(".example.org"))).otherwise("")
    rows = t.part.select(k.alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), site(k).alias("url"))
    existing = t.supplier.select(F.col("s_suppkey").alias("camp_id"), F.col("s_name").alias("name"), site(F.col("s_suppkey")).alias("url"))
    changed = F.when(k % 3 == 0, F.concat_ws(" ", "p_brand", "p_name")).otherwise(F.concat("p_name", F.lit("s "), "p_brand", F.lit("0")))
    known = t.part.where(k % 20 == 3).select((k + 1_000_000).alias("camp_id"), changed.alias("name"), F.lit("").alias("url"))
    return matching.match_or_create(rows, existing.unionByName(known), lambda c: X.stripped_name(c, False))


@query("""
with g as (select l_orderkey, count(*) as n, count(*) filter (where l_linenumber = l_orderkey % 7 + 1) as f, min(l_partkey) as one, min(case when l_linenumber = l_orderkey % 7 + 1 then l_partkey end) as fit from lineitem group by 1)
select l_orderkey, case when n = 1 then one when f = 1 then fit end as l_partkey, case when n = 1 or f = 1 then 'chosen' else 'ambiguous-multi-item' end as outcome from g""")
def n34_chosen_items(t: Tables) -> DataFrame:
    return matching.choose_item(t.lineitem, "l_orderkey", "l_partkey", F.col("l_linenumber").cast("long"), F.col("l_orderkey") % 7 + 1)


def _proposals(t: Tables) -> DataFrame:
    """Turns of a conversation as proposals of a page's items, with numbers that start anew."""
    fields = F.element_at(F.array(F.lit("name"), F.lit("ageGroups[].minAge"), F.lit("ageGroups[].maxAge"), F.lit("tags[]")), (F.col("turn") % 4 + 1).cast("int"))
    place = F.concat(F.lit("chars:"), (F.col("turn") * 10).cast("string"), F.lit("-"), (F.col("turn") * 10 + 5).cast("string"))
    return t.conversations.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("x")).select("conv_id", "turn", "x.*").select(
        F.col("conv_id").alias("source"), F.col("turn").alias("seq"), (F.floor(F.col("turn") / 2) % 3).cast("int").alias("item"), place.alias("locator"), fields.alias("path"),
        F.col("role").alias("value"), (F.col("turn") % 10 / 10.0).alias("confidence"), F.substring("text", 1, 10).alias("excerpt"), F.lit(None).cast("int").alias("sub"),
    )


@query("select distinct conv_id as source, turn as seq, floor(turn / 2)::int as global_item from conversations")
def w05_global_items(t: Tables) -> DataFrame:
    """Numbers go on where they start anew."""
    return folds.global_items(_proposals(t)).select("source", "seq", "global_item")


@query("""
with r as (select * from conversations qualify row_number() over (partition by conv_id, turn order by role, text) = 1)
select conv_id as source, floor(turn / 2)::int as global_item, 1::int as row, case when turn % 4 = 1 then role end as minAge, case when turn % 4 = 2 then role end as maxAge,
       substr(text, 1, 10) as label, floor((turn % 10 / 10.0::double) * 100 + 0.5) / 100 as confidence
from r where turn % 4 in (1, 2)""")
def n05_item_rows(t: Tables) -> DataFrame:
    """A page's proposals as rows of its items, whose numbers go on where they start anew (also n08)."""
    return folds.item_rows(folds.global_items(_proposals(t)), "ageGroups", ["minAge", "maxAge"]).select("source", "global_item", "row", "minAge", "maxAge", "label", "confidence")


@query("""
with r as (select distinct conv_id, turn, role from conversations), p as (select conv_id, floor(turn / 4)::int as item, turn % 2 as field, turn, role from r)
select conv_id as source, item, max(case when field = 0 then role end) as a, max(case when field = 1 then role end) as b
from p where turn = (select max(turn) from p q where q.conv_id = p.conv_id and q.item = p.item and q.field = p.field) group by 1, 2""")
def n06_last_values(t: Tables) -> DataFrame:
    rows = t.conversations.select(F.col("conv_id").alias("source"), F.floor(F.col("turn") / 4).cast("int").alias("item"), F.when(F.col("turn") % 2 == 0, "a").otherwise("b").alias("field"), "turn", "role")
    return folds.last_values(rows, ["source", "item"], "field", "role", "turn", ["a", "b"])


@query(rf"""
with n as (select l_orderkey as source, l_partkey as item, trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) as name from (select distinct l_orderkey, l_partkey from lineitem) join part on p_partkey = l_partkey),
g as (select source, list({{'o': item, 'g': {BIGRAMS.format("name")}}} order by item) as x from n group by 1),
k as (select source, list_reduce(x[2:], lambda done, y: case when len(list_filter(done, lambda d: 2.0::double * len(list_intersect(d.g, y.g)) / (len(d.g) + len(y.g)) >= 0.75)) > 0 then done else list_append(done, y) end, x[1:1]) as kept from g)
select source, unnest(list_transform(kept, lambda r: r.o)) as item from k""")
def n07_distinct_items(t: Tables) -> DataFrame:
    """An order is a page, its parts the items: names of a page that aren't like an earlier one."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("item")).distinct()
    rows = lines.join(t.part.select(F.col("p_partkey").alias("item"), F.concat_ws(" ", "p_name", "p_type").alias("name")), "item")
    return folds.distinct_items(rows).select("source", "item")


def _claims(t: Tables) -> tuple[DataFrame, DataFrame]:
    o = t.orders
    proposals = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderkey") % 4).alias("run"), F.col("o_orderdate").alias("created"), (F.col("o_orderkey") % 3).cast("int").alias("priority"), (F.col("o_orderkey") % 97 / 97.0).alias("confidence"))
    claims = o.select(F.col("o_orderkey").alias("id"), F.lit("status").alias("field"), F.when(F.col("o_orderkey") % 5 != 0, "old").alias("old"), F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise("")).alias("value"), F.when(F.col("o_orderkey") % 7 == 0, "populate").otherwise("update").alias("mode"))
    return proposals, claims


HISTORY_SQL = """
with p as (select o_orderkey as id, o_custkey as subject, case when o_orderkey % 6 <> 0 then o_orderkey % 4 end as run, o_orderdate as created, (o_orderkey % 3)::int as priority, (o_orderkey % 97) / 97.0::double as confidence, o_orderstatus as value,
  case when o_orderkey % 5 <> 0 then 'old' end as old, case when o_orderkey % 7 = 0 then 'populate' else 'update' end as mode from orders),
h as (select * from p qualify row_number() over (partition by subject order by created desc, id desc) <= 20)"""


@query(HISTORY_SQL + " select a.id, (select count(*) from h b where b.subject = a.subject and b.id <> a.id and b.run <> a.run and b.value = a.value) as corroborations from h a")
def n13_corroborated(t: Tables) -> DataFrame:
    """Proposals that others of the subject's newest 20 confirm (j15)."""
    proposals, claims = _claims(t)
    history = review.recent_history(proposals, "subject", "created", "id")
    said = claims.join(history.select("id", "subject", "run"), "id")
    return review.corroborated(said, said).select("id", "corroborations")


@query(
    HISTORY_SQL
    + """, c as ((select id from p order by priority desc, confidence desc, id limit 1000) union (select id from p order by priority desc, confidence, id limit 1000)),
s as (select p.*, case when h.id is not null and p.mode <> 'populate' and p.old is not null and exists (select 1 from h b where b.subject = p.subject and b.id <> p.id and b.run <> p.run and b.value = p.value) then 1 else 0 end as selectable from p join c using (id) left join h on h.id = p.id),
l as (select *, case when selectable > 0 then 'batch' else 'review' end as lane from s)
select id, lane, (row_number() over (partition by lane order by priority desc, case when lane = 'batch' then -confidence else confidence end, id))::int as place, selectable::bigint as selectable from l qualify place <= 1000"""
)
def n15_ranked_queue(t: Tables) -> DataFrame:
    """Both lanes, with what may be accepted in a batch (n14)."""
    return review.ranked_queue(*_claims(t)).select("id", "lane", "place", "selectable")


@query("select o_orderkey, case when o_orderstatus = 'P' and o_orderkey <> (select o.o_orderkey from orders o where o.o_custkey = orders.o_custkey and o.o_orderstatus = 'P' order by o.o_orderdate desc, o.o_orderkey desc limit 1) then 'SKIPPED' when o_orderstatus = 'P' then 'PENDING' else o_orderstatus end as status from orders")
def n12_supersede(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise(F.col("o_orderstatus")).alias("status"))
    return review.supersede(rows, "o_custkey", "o_orderdate", "status", "o_orderkey").select("o_orderkey", "status")


@query("select o_orderkey, o_orderkey % 3 = 0 and o_orderkey % 100 >= 90 and o_orderkey % 2 = 1 as accepts from orders")
def n16_machine_accepts(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    fields = F.when(k % 3 == 0, F.array(F.lit("city"), F.lit("description"))).when(k % 3 == 1, F.array(F.lit("city"), F.lit("pricing"))).otherwise(F.array().cast("array<string>"))
    return t.orders.select("o_orderkey", review.machine_accepts(fields, k % 100 / 100.0, k % 2 == 1).alias("accepts"))


@query("""
select x.n as name, count(*) as n, round(sum(x.v), 4) as total from (select unnest([{'n': 'extraction_confidence', 'v': (event_id % 10) / 10.0::double}, {'n': 'extraction_duration_ms', 'v': 5.0}, {'n': 'changes_found', 'v': user_id::double}, {'n': 'site_fetch_success', 'v': case when event_type = 'error' then 0.0 else 1.0 end},
  {'n': 'tokens_used', 'v': 7.0}, {'n': 'provider_calls', 'v': 1.0}, {'n': 'field_confidence', 'v': 0.5}, {'n': 'field_confidence', 'v': 0.25}]) as x from events) group by 1""")
def n17_extraction_metrics(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.col("user_id").alias("camp_id"), F.lit("h").alias("host"), (F.col("event_id") % 10 / 10.0).alias("confidence"), F.lit(5).alias("duration_ms"), F.col("user_id").alias("changes"), F.when(F.col("event_type") == "error", "x").alias("error"), F.lit(7).alias("tokens"), F.lit(1).alias("calls"),
        F.create_map(F.lit("city"), F.lit(0.5), F.lit("name"), F.lit(0.25)).alias("field_confidence"),
    )
    return review.extraction_metrics(rows).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
select name, count(*) as n from (select unnest(case when o_orderstatus = 'F' then ['field_approved', 'field_rejected', 'field_rejected', 'field_rejection_learning_signal'] else ['field_approved', 'field_rejected', 'field_rejected'] end) as name from orders) group by 1""")
def n18_decision_metrics(t: Tables) -> DataFrame:
    change = F.struct(F.lit("a").alias("old"), F.lit("b").alias("new"))
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("r").alias("run"), F.array(F.lit("name")).alias("approved"), F.array(F.lit("city"), F.lit("zip")).alias("rejected"), F.create_map(F.lit("city"), change, F.lit("name"), change).alias("changes"), (F.col("o_orderstatus") == "F").alias("final"), F.lit("").alias("notes"))
    return review.decision_metrics(rows).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("select distinct l_suppkey as user_id, o_orderkey as camp_id from lineitem join orders on o_orderkey = l_orderkey join supplier on s_suppkey = l_suppkey where o_orderstatus = 'P' and s_acctbal > 0")
def n31_notifications(t: Tables) -> DataFrame:
    due = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("camp_id"))
    saves = t.lineitem.select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("camp_id"))
    return review.notifications(due, saves, t.supplier.select(F.col("s_suppkey").alias("user_id"), (F.col("s_acctbal") > 0).alias("opted_in")))


def _by_number(c: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


FIELDS = list(trust.CAMP_FIELDS)
LEDGER_SQL = f"""
with cl as (select l_orderkey as camp_id, ({FIELDS})[l_linenumber] as requirement, l_partkey, case when l_quantity < 5 then 'disputed' when l_quantity < 12 then 'assumed' when l_discount > 0.09 then 'proposed' else 'verified' end as s, l_shipdate as seen from lineitem),
st as (select *, case when s = 'verified' and epoch(timestamp '2000-01-01' - seen) / 86400 > case when requirement in ('ageGroups', 'pricing') then 120 else 180 end then 'stale' else s end as state from cl),
rk as (select camp_id, requirement, min(list_position({list(trust.STATES)}, state)) as r, bool_and(state = 'assumed') as a from st group by 1, 2),
w as (select o_orderkey as camp_id, unnest({FIELDS}) as requirement from orders),
rq as (select w.*, case when a then 9 else coalesce(r, 6) end as r from w left join rk using (camp_id, requirement)
  union all select o_orderkey, 'sessions-verified', case when o_orderkey % 2 = 0 then 9 else case o_orderstatus when 'F' then 9 when 'O' then 5 else 7 end end from orders)"""


def _ledger(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, int | None]:
    """Camps, claims with their states, sessions, and the tasks for what is made of them. A row that is there twice is a claim told twice, which changes no state."""
    li = t.lineitem
    tasks = tasks_for(li)
    q = F.col("l_quantity")
    requirement = _by_number(F.col("l_linenumber") - 1, FIELDS)
    kind = F.when(requirement.isin("ageGroups", "pricing"), "camp-repeated-field").otherwise("camp-scalar-field")
    claims = li.withColumn("claim_id", F.xxhash64(*li.columns)).select("claim_id", F.col("l_orderkey").alias("camp_id"), requirement.alias("requirement"), kind.alias("kind"), F.when(q < 5, "disputed").when(q < 12, "assumed").when(F.col("l_discount") > 0.09, "proposed").otherwise("verified").alias("s"), F.col("l_shipdate").cast("timestamp").alias("at"))
    events = claims.select("claim_id", F.lit(1).alias("event_id"), F.lit("proposed").alias("state"), F.lit("1990-01-01").cast("timestamp").alias("at")).unionByName(claims.select("claim_id", F.lit(2).alias("event_id"), F.col("s").alias("state"), "at"))
    told = trust.claim_states(claims.select("claim_id", "camp_id", "requirement", "kind"), events, "2000-01-01 00:00:00", tasks)
    camps = t.orders.select(F.col("o_orderkey").alias("camp_id"))
    sessions = t.orders.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("camp_id"), F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "stale").otherwise("proposed").alias("state"))
    return camps, told, sessions, tasks


@query(LEDGER_SQL + f" select camp_id, ({list(trust.STATES)})[min(r)] as state, count(*) as n, count(*) filter (where r = 9) as met, case min(r) when 9 then 'VERIFIED' when 5 then 'STALE' else 'PLACEHOLDER' end as confidence from rq group by 1")
def n20_camp_rollup(t: Tables) -> DataFrame:
    """All that a subject needs (n23, n25, n33), from its claims' newest events and their validity (n24)."""
    camps, claims, sessions, tasks = _ledger(t)
    return trust.camp_rollup(camps, claims, sessions, tasks=tasks)


@query(LEDGER_SQL + " select camp_id, count(*) filter (where r = 9) as covered, count(*) filter (where r = 6) as missing, count(*) filter (where r not in (6, 9)) as unattested, floor(count(*) filter (where r = 9) * 100.0 / count(*) + 0.5)::int as percent from rq where requirement <> 'sessions-verified' group by 1")
def a24_trust_coverage(t: Tables) -> DataFrame:
    camps, claims, _, tasks = _ledger(t)
    out = trust.coverage(trust.field_states(camps, claims, "camp_id", tasks=tasks), ["camp_id"])
    return out.select("camp_id", *[F.size(c).cast("long").alias(c) for c in ("covered", "missing", "unattested")], "percent")


@query(LEDGER_SQL + ", g as (select camp_id, min(r) as r from rq group by 1) select camp_id, case r when 5 then 'STALE' else 'PLACEHOLDER' end as confidence from g where camp_id % 3 = 0 and r <> 9")
def n35_downgrades(t: Tables) -> DataFrame:
    camps, claims, sessions, tasks = _ledger(t)
    shown = camps.withColumn("shown", F.when(F.col("camp_id") % 3 == 0, "VERIFIED").otherwise("PLACEHOLDER"))
    return trust.downgrades(shown, trust.camp_rollup(camps, claims, sessions, tasks=tasks), "camp_id").select("camp_id", "confidence")


@query("""
select o_custkey as camp_id, o_orderkey as session_id, case when o_orderkey % 2 = 0 then case when o_orderkey % 3 = 0 then 'verified' else 'proposed' end when o_custkey % 2 = 0 then case when o_orderkey % 3 = 0 then 'verified' else 'proposed' end else case when o_orderkey % 3 = 0 then 'stale' else 'stale' end end as state from orders""")
def n21_session_rollup(t: Tables) -> DataFrame:
    """A session's own attributes, or those that its camp lends it."""
    o = t.orders
    s = o.select(F.col("o_custkey").alias("camp_id"), F.col("o_orderkey").alias("session_id"))
    dates = o.select(F.col("o_orderkey").alias("session_id"), F.lit("dates").alias("requirement"), F.when(F.col("o_orderkey") % 3 == 0, "verified").otherwise("proposed").alias("state"))
    price = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("session_id"), F.lit("price").alias("requirement"), F.lit("verified").alias("state"))
    camp = t.customer.select(F.col("c_custkey").alias("camp_id"), F.lit("pricing").alias("requirement"), F.when(F.col("c_custkey") % 2 == 0, "verified").otherwise("stale").alias("state"))
    return trust.session_rollup(s, dates.unionByName(price), camp, {"price": "pricing"}, ["dates", "price"]).select("camp_id", "session_id", "state")


@query("select p_partkey, case when p_partkey % 3 = 0 then 'unknown' when p_partkey % 3 = 1 then 'assumed' else 'verified' end as state from part")
def n22_capped(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    inputs = F.array(F.lit("verified"), F.when(k == 1, "assumed").when(k == 2, "verified"))
    return t.part.select("p_partkey", trust.capped(F.lit("verified"), inputs).alias("state"))


@query("""
with e as (select doc_id as k, text, case when doc_id % 4 = 1 then '~' || substr(text, 12, 29) else substr(text, 11, 30) end as x from documents),
s as (select k, case when k % 4 = 3 then 'unverified' when k % 4 = 2 then 'attested_no_source' when coalesce(x, '') = '' then 'unverified' when length(text) >= 40 and substr(text, 11, 30) = x then 'verified_current' else 'stale_unresolvable' end as shown from e)
select k as claim_id, shown, case when shown = 'unverified' then 'none' when k % 4 = 2 or k % 8 = 0 then 'human' else 'crawl' end as origin, case when shown <> 'unverified' then 'ann' end as actor from s""")
def n26_trust_display(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    d = t.documents.select("doc_id", "text", "lang")
    claims = d.select(k.alias("claim_id"), F.when(k % 4 == 3, "disputed").when(k % 4 == 2, "assumed").otherwise("verified").alias("state"))
    events = claims.select("claim_id", F.lit(1).alias("event_id"), "state", F.lit("2024-01-01").cast("timestamp").alias("at"), F.lit("ann").alias("actor"), F.col("claim_id").alias("evidence_id"))
    excerpt = F.when(k % 4 == 1, F.concat(F.lit("~"), F.substring("text", 12, 29))).otherwise(F.substring("text", 11, 30))
    evidence = d.select(k.alias("evidence_id"), F.when(k % 4 == 2, "override").otherwise("source").alias("mode"), F.when(k % 8 == 0, "attestation").otherwise("crawl").alias("method"), k.cast("string").alias("source_ref"), F.lit("chars:10-40").alias("locator"), excerpt.alias("excerpt"))
    pages = d.select(k.cast("string").alias("source_ref"), F.col("text").alias("body"))
    return trust.trust_display(claims, events, evidence, pages).select("claim_id", "shown", "origin", "actor")


BACKFILL_SQL = """
with s as (select p_partkey as camp_id, unnest(['city', 'pricing', 'name']) as field, case when p_partkey % 3 = 0 then null else timestamp '2024-01-01' end as approved, case when p_partkey % 2 = 0 then 'ann' end as attested, p_brand as url, case when p_partkey % 5 = 0 then p_name end as excerpt from part),
a as (select s_suppkey as id, case when s_suppkey % 4 = 0 then 'PROVIDER' else 'CAMP' end as entity, s_suppkey as camp_id, case when s_suppkey % 5 = 0 then 'name' else 'city' end as field, ['ACTIVE', 'STALE', 'INVALIDATED'][s_suppkey % 3 + 1] as status from supplier),
r as (select camp_id, field, 'camp.' || camp_id || '.' || field as claim_id, 'field-source' as o, attested is not null as att, coalesce(attested, 'backfill') as actor, case when attested is not null then 'admin:ann' else url end as source_ref,
        coalesce(excerpt, 'No excerpt was recorded.') as excerpt, 'verified' as state, 'verification' as type, approved as seen, approved as verified_at, null as notes from s where field in ('city', 'pricing') and approved is not null
  union all select camp_id, field, 'camp.' || camp_id || '.' || field, 'attestation.' || id, true, 'bob', 'admin:bob', 'seen', case status when 'ACTIVE' then 'verified' when 'STALE' then 'stale' else 'revoked' end,
        case status when 'ACTIVE' then 'verification' else 'invalidation' end, timestamp '2024-01-02', case status when 'ACTIVE' then timestamp '2024-01-02' end, 'seen' from a where entity = 'CAMP' and field = 'city'),
k as (select 'camp.' || p_partkey || '.city' as id from part where p_partkey % 2 = 0)"""


def _backfill(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    entry = F.struct(F.when(k % 3 != 0, F.lit("2024-01-01").cast("timestamp")).alias("approvedAt"), F.when(k % 2 == 0, "ann").alias("attestedBy"), F.col("p_brand").alias("sourceUrl"), F.when(k % 5 == 0, F.col("p_name")).alias("excerpt"), none.alias("notes"))
    camps = t.part.select(k.alias("camp_id"), F.create_map(F.lit("city"), entry, F.lit("pricing"), entry, F.lit("name"), entry).alias("field_sources"))
    n = F.col("s_suppkey")
    attestations = t.supplier.select(
        n.alias("id"), F.when(n % 4 == 0, "PROVIDER").otherwise("CAMP").alias("entity_type"), n.alias("entity_id"), F.when(n % 5 == 0, "name").otherwise("city").alias("field"), _by_number(n, ["ACTIVE", "STALE", "INVALIDATED"]).alias("status"),
        none.alias("source_url"), none.alias("excerpt"), F.lit("seen").alias("notes"), F.lit("2024-01-02").cast("timestamp").alias("observed_at"), F.lit(None).cast("timestamp").alias("approved_at"), F.lit("bob").alias("approved_by"), none.alias("reason"),
    )
    known = t.part.where(k % 2 == 0).select(F.concat(F.lit("camp."), k.cast("string"), F.lit(".city")).alias("id"))
    return trust.backfill(camps, attestations, known)


@query(BACKFILL_SQL + " select distinct claim_id, camp_id, field, case when field = 'pricing' then 'camp-repeated-field' else 'camp-scalar-field' end as kind from r where claim_id not in (select id from k)")
def n36_backfill(t: Tables) -> DataFrame:
    """Claims of approved entries and attestations; what nobody approved, and other fields, make none."""
    return _backfill(t)[0]


@query(BACKFILL_SQL + " select 'evidence.' || claim_id || '.' || o as evidence_id, claim_id, case when att then 'attestation' else 'crawl_observation' end as evidence_type, case when att then 'attestation' else 'observation' end as method, source_ref, excerpt, actor as collected_by from r")
def n36_evidence(t: Tables) -> DataFrame:
    return _backfill(t)[1].drop("observed_at")


@query(BACKFILL_SQL + " select 'event.' || claim_id || '.' || o as event_id, claim_id, state, type, actor, strftime(seen, '%Y-%m-%d') as day, verified_at is not null as verified, notes from r")
def n36_events(t: Tables) -> DataFrame:
    return _backfill(t)[2].select("event_id", "claim_id", "state", "type", "actor", iso_date("at").alias("day"), F.col("verified_at").isNotNull().alias("verified"), "notes")


@query("select l_orderkey || ':' || l_linenumber as claim_id, 'revoked' as state, strftime(timestamp '2024-01-31', '%Y-%m-%d') as day from (select distinct l_orderkey, l_linenumber from lineitem) where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'P')")
def n27_revocations(t: Tables) -> DataFrame:
    claims = t.lineitem.select(F.lit("session").alias("subject_type"), F.col("l_orderkey").cast("string").alias("subject_id"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("claim_id")).distinct()
    gone = t.orders.where("o_orderstatus = 'P'").select(F.lit("session").alias("subject_type"), F.col("o_orderkey").cast("string").alias("subject_id"))
    return trust.revocations(gone, claims, "crawl", AS_OF).select("claim_id", "state", iso_date("at").alias("day"))


@query("select page_id, regexp_extract(url, '://([^/?#]+)', 1) as host, (row_number() over (partition by host order by page_id))::int as turn from pages")
def n28_by_host(t: Tables) -> DataFrame:
    """Pages of a host one after the other; tests look at which partitions they lie in."""
    rows = t.pages.select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"))
    return ranking.by_host(rows, "host", [F.asc("page_id")])


@query("""
with c as (select o_orderkey as camp_id, case when o_orderkey % 4 = 0 then 'UNKNOWN' else 'OPEN' end as status, (o_orderkey % 3)::int as n, o_orderkey % 5 = 0 as ok, o_orderkey % 5 < 2 as src,
      '{"slug":"s-' || o_orderkey || '","name":"' || o_orderpriority || '"' || case when o_orderkey % 7 > 0 then ',"data_confidence":"PLACEHOLDER"' else '' end || case when o_orderkey % 5 = 0 then ',"field_source":{"approvedAt":"2024-01-01T00:00:00.000Z","sourceUrl":"https://s","excerpt":"x"}'
      when o_orderkey % 5 = 1 then ',"field_source":{"sourceUrl":"https://s","excerpt":"x"}' else '' end || '}' as about from orders),
p as (select l_orderkey as camp_id, l_linenumber as id, case l_returnflag when 'R' then 'REJECTED' when 'A' then 'APPROVED' else 'PENDING' end as status, case when l_quantity < 10 then 'NONSENSE' else 'FULL' end as new, case when l_quantity > 30 then l_linenumber end as n
      from (select l_orderkey, l_linenumber, min(l_returnflag) as l_returnflag, min(l_quantity) as l_quantity from lineitem group by 1, 2)),
q as (select *, '{"proposal_id":' || id || ',"proposal_status":"' || status || '","old_value":"OPEN","mode":"' || case when n is null then 'update' else 'populate' end || '","overall_confidence":0.5,"extraction_model":"m"}' as about from p),
o as (select 'directory.' || camp_id || '.registrationStatus.current' as claim_id, camp_id, 'registrationStatus' as field, status as value, case when ok then 'verified' when status = 'UNKNOWN' then 'unknown' else 'proposed' end as state, case when src then 'field-source-approval' else 'candidate-resolution' end as method, case when ok then 'moderate' else 'none' end as support, about as metadata, case when src then 'field-review' else 'directory' end as who from c
union all select 'directory.' || camp_id || '.schedules.current', camp_id, 'schedules', n::varchar, case when ok then 'verified' else 'proposed' end, case when src then 'field-source-approval' else 'candidate-resolution' end, case when ok then 'moderate' else 'none' end, about, null from c where n > 0 or ok
union all select 'directory.' || camp_id || '.registrationStatus.' || id, camp_id, 'registrationStatus', new, case status when 'APPROVED' then 'verified' when 'REJECTED' then 'rejected' else 'proposed' end, case status when 'PENDING' then 'crawl-proposal' else 'field-review' end, 'moderate', about, 'm' from q where new <> 'NONSENSE'
union all select 'directory.' || camp_id || '.schedules.' || id, camp_id, 'schedules', n::varchar, case status when 'APPROVED' then 'verified' when 'REJECTED' then 'rejected' else 'proposed' end, case status when 'PENDING' then 'crawl-proposal' else 'field-review' end, 'moderate', about, null from q where n is not null)
select claim_id, field, value, state, method, support, metadata, 'html:field=' || field as locator, 'medium' as impact_level, case when who is not null then 'publisher_owned_page' end as authority_class, case when who is not null then 'public-directory' end as product_area,
       case when who is not null then camp_id::varchar end as subject_id, who as declared_by from o""")
def n30_observations(t: Tables) -> DataFrame:
    """Two fields of each subject, as they stand and as proposed, with what their sources have the authority for."""
    k = F.col("o_orderkey")
    source = F.struct(F.when(k % 5 == 0, F.lit("2024-01-01").cast("timestamp")).alias("approvedAt"), F.lit("https://s").alias("sourceUrl"), F.lit("x").alias("excerpt"))
    sources = F.when(k % 5 < 2, F.create_map(F.lit("registrationStatus"), source, F.lit("schedules"), source))
    camps = t.orders.select(
        k.alias("camp_id"), F.concat(F.lit("s-"), k.cast("string")).alias("slug"), F.col("o_orderpriority").alias("name"), F.when(k % 7 > 0, "PLACEHOLDER").alias("data_confidence"), F.lit("https://c").alias("url"), F.when(k % 4 == 0, "UNKNOWN").otherwise("OPEN").alias("status"),
        (k % 3).cast("int").alias("n_schedules"), F.lit(None).cast("timestamp").alias("verified_at"), F.col("o_orderdate").cast("timestamp").alias("crawled_at"), sources.alias("field_sources"),
    )
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_returnflag", "l_quantity", "l_discount")])
    some = F.col("l_quantity") > 30
    change = F.struct(
        F.lit("OPEN").alias("old"), F.when(F.col("l_quantity") < 10, "NONSENSE").otherwise("FULL").alias("new"), F.when(some, "populate").otherwise("update").alias("mode"), F.when(some, F.col("l_linenumber")).alias("n_items"), F.lit(None).cast("string").alias("sourceUrl"), F.lit("x").alias("excerpt"), F.col("l_discount").alias("confidence")
    )
    proposals = lines.select(
        F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("camp_id"), F.lit("https://p").alias("url"), F.when(F.col("l_returnflag") == "R", "REJECTED").when(F.col("l_returnflag") == "A", "APPROVED").otherwise("PENDING").alias("status"), F.lit(AS_OF).cast("timestamp").alias("created"),
        F.lit(None).cast("timestamp").alias("reviewed_at"), F.lit(None).cast("string").alias("reviewed_by"), F.lit("m").alias("model"), F.lit(0.5).alias("overall_confidence"), F.create_map(F.lit("registrationStatus"), change, F.lit("schedules"), change).alias("changes"),
    )
    found = trust.observations(camps, proposals, AS_OF)
    authority = [F.col("authority.class").alias("authority_class"), F.col("authority.scope.product_area").alias("product_area"), F.col("authority.scope.subject_id").alias("subject_id"), F.col("authority.declared_by").alias("declared_by")]
    return found.select("claim_id", "field", "value", "state", "method", "support", "metadata", "locator", "impact_level", *authority)


@query("""
with l as (select distinct l_orderkey, l_orderkey * 10 + l_linenumber as l from lineitem),
e as (select l, '{"event_id":' || (l * 10 + 1) || ',"state":"proposed","at":"2024-01-0' || (l % 7 + 1) || '","actor":"crawl"}' || case when l % 3 = 0 then ',{"event_id":' || (l * 10 + 2) || ',"state":"verified","at":"2024-01-09","actor":"admin"}' else '' end as events from l where l % 5 > 0)
select o_orderkey as subject_id, '{"subject_id":' || o_orderkey || ',"claims":[' || coalesce((select string_agg('{"claim_id":' || l || ',"field":"line","state":"verified","evidence":[{"evidence_id":' || l || ',"method":"crawl","source_ref":"' || o_orderkey || '"}],"events":[' || coalesce(events, '') || ']}', ',' order by l)
  from l left join e using (l) where l_orderkey = o_orderkey), '') || ']}' as bundle from orders""")
def n30_trust_export(t: Tables) -> DataFrame:
    """Every claim of a subject with its evidence and its events, in order."""
    claims = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), F.col("l_orderkey").alias("subject_id"), F.lit("line").alias("field"), F.lit("verified").alias("state")).distinct()
    evidence = claims.select(F.col("claim_id").alias("evidence_id"), "claim_id", F.lit("crawl").alias("method"), F.col("subject_id").cast("string").alias("source_ref"))
    c = F.col("claim_id")
    event = lambda n, state, at, actor: claims.select((c * 10 + n).alias("event_id"), "claim_id", F.lit(state).alias("state"), at.alias("at"), F.lit(actor).alias("actor")).where(c % 5 > 0)
    events = event(1, "proposed", F.concat(F.lit("2024-01-0"), (c % 7 + 1).cast("string")), "crawl").unionByName(event(2, "verified", F.lit("2024-01-09"), "admin").where(c % 3 == 0))
    return trust.export(t.orders.select(F.col("o_orderkey").alias("subject_id")), claims, evidence, events)
