"""The registered queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import bpe, hnsw, line_dedup, mixing, negatives, passages, pii, secrets, simhash, topk, toxicity, url_filter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


OP1_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from p qualify rank <= 10
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.by_document(passages.shared_passages(_table(spark, sf_dir, "documents")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a repository is a source's texts of one language, its owner the source
    found = secrets.scan(_table(spark, sf_dir, "documents"), F.col("source"), F.concat_ws("/", "source", "lang"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = secrets.written(F.concat("base", "added"))
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"), "n_live", "n_copied")


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_ASSIGN = rf"""({_either_case("password|passwd|secret|token|api_?key")})["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")


def _spans_sql(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Matches with the text before each, in order; what follows the last has no match."""
    return f"""select doc_id, owner, {order} as k, '{kind}' as kind, {least} as least, unnest(regexp_extract_all(t, '{pattern}', 0)) as hit, unnest(regexp_extract_all(t, '{pattern}', {group})) as val,
  unnest(string_split_regex(t, '{pattern}')) as gap, generate_subscripts(string_split_regex(t, '{pattern}'), 1) as i from d"""


OP4_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as owner from documents),
e as ({_spans_sql(0, "assign", _ASSIGN, 2, 8)} union all {_spans_sql(1, "access", "AKIA[A-Z0-9]+", 0, 16)} union all {_spans_sql(2, "hex", "[0-9a-f]+", 0, 32)} union all {_spans_sql(3, "live", "[A-Za-z0-9+/_-]+", 0, 24)}),
p as (select *, sum(length(gap) + coalesce(length(hit), 0)) over (partition by doc_id, k order by i) as upto from e),
s as (select doc_id, owner, k, kind, val, (upto - length(hit))::bigint as a, upto::bigint as b from p where hit is not null and length(val) >= least
      and (k < 3 or regexp_matches(val, '[0-9]') and regexp_matches(val, '[A-Z]') and regexp_matches(val, '[a-z]'))),
o as (select val, count(distinct owner) <= 1 as rare from s group by 1),
w as (select s.*, rare from s join o using (val)),
x as (select * from w where k < 3 or rare and not exists (select 1 from w v where v.doc_id = w.doc_id and v.k < 3 and v.a < w.b and w.a < v.b)),
g as (select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex, count(*) filter (where k < 3 and rare) as n_live, count(*) filter (where k < 3 and not rare) as n_copied,
      string_agg(kind || ':' || a || ':' || b, ',' order by a, k) filter (where k < 3) as base, string_agg(kind || ':' || a || ':' || b, ',' order by a, k) as spans from x group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
from documents left join g using (doc_id)
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"))


OP5_SQL = """
with d as (select row_number() over (order by doc_id nulls last, text) as rid, doc_id, text from documents),
s as (select rid, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from d where text is not null),
r as (select *, row_number() over (order by rid, i) as r from s),
f as (select l, min(r) as r, length(l) as n from r where trim(l) <> '' group by 1),
h as (select r, l, n, unnest([n, n - 1]) as m from f where n >= 5),
k as (select r, l, n, 'a' || m || substr(l, 1, m // 2) as key from h union all select r, l, n, 'z' || m || substr(l, n - (m - m // 2) + 1) from h),
c as (select distinct a.l as x, b.l as y, b.r, a.n as xn, b.n as yn from k a join k b on a.key = b.key and a.r < b.r where abs(a.n - b.n) <= 1 and levenshtein(a.l, b.l) <= 4),
gone as (select distinct r from c where len(list_filter(range(0, least(xn, yn) + 1), lambda i: substr(x, 1, i) = substr(y, 1, i)
         and substr(x, i + 1 + (xn >= yn)::int) = substr(y, i + 1 + (yn >= xn)::int))) > 0),
t as (select rid, string_agg(r.l, chr(10) order by r.i) filter (where trim(r.l) = '' or f.r is not null) as kept, count(f.r) as n from r left join (select * from f where r not in (select r from gone)) f on f.r = r.r group by 1),
o as (select doc_id, case when d.text is null then d.text when n > 0 then kept else '' end as text from d left join t using (rid))
select doc_id, text, length(text)::bigint as n_chars from o
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The contract's rules.
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
#: The tables have no block list, so it is made of the corpus: the pages of hosts that have one of these words as a part,
#: and, so that the list is long, those with a number of these last digits.
LISTED_HOST = r"(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)"
LISTED_PATH = r"^/[a-z]+/[0-9]*[357](\.html)?/?$"


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    listed = pages.where(host.rlike(LISTED_HOST) | path.rlike(LISTED_PATH)).select(url_filter.page_key(host, path).alias("key"))
    return url_filter.judge_urls(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


OP7_SQL = rf"""
with a as (select page_id, case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest from pages),
b as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
l as (select distinct host || path as key from b where regexp_matches(host, '{LISTED_HOST}') or regexp_matches(path, '{LISTED_PATH}')),
rules(rule, h, p, v) as (values ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
f as (select b.*, (select max_by(rule, length(rule)) from rules r where (b.host = r.h or ends_with(b.host, '.' || r.h)) and starts_with(b.path, r.p)) as rule,
             host || path in (select key from l) as listed from b)
select page_id, host, path, f.rule, coalesce(r.v, case when listed then 'block' else 'allow' end) as verdict, listed
from f left join rules r on f.rule = r.rule
"""


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, _table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    found = toxicity.score(documents, model).withColumn("held_out", toxicity.held_out())
    return found.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0, 5, 3)


OP11_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
           where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_inner_product(a.e, c.e) as bigint) as score
      from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
       vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score qualify rank <= 3
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), 8)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    added = F.transform("added", lambda s: F.struct(s["start"], s["order"], s["kind"], s["end"], s["hash"]))
    spans = pii.written(F.concat("base", added))
    terms, removed = F.size("added").cast("long").alias("n_term"), F.size(F.filter("added", lambda s: s["removed"])).cast("long").alias("n_removed")
    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"), terms, removed)


def _cut_sql(order: int, kind: str, pattern: str) -> str:
    return f"""select doc_id, {order} as k, '{kind}' as kind, unnest(regexp_extract_all(t, '{pattern}')) as hit, unnest(string_split_regex(t, '{pattern}')) as gap, generate_subscripts(string_split_regex(t, '{pattern}'), 1) as i from d"""


_DIGIT = "(substr(lpad(regexp_replace(hit, '[^0-9]', '', 'g'), 19, '0'), 19 - i, 1))::int"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP13_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
e as ({_cut_sql(0, "email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+")} union all {_cut_sql(1, "ip", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+")}
      union all {_cut_sql(2, "card", "[0-9](?:[ -]?[0-9])+")} union all {_cut_sql(3, "phone", "[+][0-9][ ().0-9-]+[0-9]")}),
p as (select *, regexp_replace(hit, '[^0-9]', '', 'g') as digits, sum(length(gap) + coalesce(length(hit), 0)) over (partition by doc_id, k order by i) as upto, lead(gap) over (partition by doc_id, k order by i) as nxt from e),
m as (select row_number() over () as mid, doc_id, k, kind, case k when 0 then translate(hit, '{_UPPER}', '{_LOWER}') when 1 then hit else digits end as entity, (upto - length(hit))::bigint as a, upto::bigint as b,
      right(gap, 64) as before, left(nxt, 64) as after, length(gap) > 64 as cut_before, length(nxt) > 64 as cut_after from p where hit is not null and case k
      when 0 then true when 1 then len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 or ('0' || right(x, 3))::int > 255)) = 0
      when 2 then length(digits) between 14 and 19 and list_sum(list_transform(range(0, 19), lambda i: {_DIGIT} * (1 + i % 2) - case when i % 2 = 1 and {_DIGIT} > 4 then 9 else 0 end)) % 10 = 0
      else length(digits) between 10 and 15 end),
w as (select mid, 0 as side, before as txt, a - length(before) as base, cut_before as cut from m union all select mid, 1, after, b, cut_after from m),
x as (select mid, side, base, cut, length(txt) as n, unnest(regexp_extract_all(txt, '\p{{L}}+')) as word, unnest(string_split_regex(txt, '\p{{L}}+')) as gap, generate_subscripts(string_split_regex(txt, '\p{{L}}+'), 1) as j from w),
y as (select *, (sum(length(gap) + coalesce(length(word), 0)) over (partition by mid, side order by j))::bigint as z from x),
near as (select doc_id, entity || '/' || (k > 1)::int as entity, before || chr(0) || after as context, translate(word, '{_UPPER}', '{_LOWER}') as term, base + z - length(word) as s, base + z as e
         from y join m using (mid) where word is not null and length(word) >= 4 and not (cut and (side = 0 and z = length(word) or side = 1 and z = n))),
forms as (select form, count(*) as texts from (select distinct doc_id, unnest([u, left(u, 3) || '*']) as form from (select doc_id, unnest(regexp_extract_all(translate(t, '{_UPPER}', '{_LOWER}'), '\p{{L}}+')) as u from d) where length(u) >= 4) group by 1),
holds as (select entity || '/' || (k > 1)::int as entity, count(distinct doc_id) as held, (select count(*) from d)::double as n from m group by 1),
pairs as (select entity, form, count(distinct doc_id) as co, count(distinct context) as seen from (select entity, doc_id, context, unnest([term, left(term, 3) || '*']) as form from near) group by 1, 2),
told as (select entity, form from pairs join forms using (form) join holds using (entity) where seen >= 3 and held < n and log2(co * n / (held * texts::double)) / log2(n / held) >= 0.9),
hits as (select doc_id, s, e, max((g.form is not null)::int) as removed from near join told using (entity) left join told g on g.entity = near.entity and g.form = left(term, 3) || '*' where told.form = term group by 1, 2, 3),
added as (select h.* from hits h where not exists (select 1 from m where m.doc_id = h.doc_id and m.a < h.e and h.s < m.b)),
every as (select doc_id, k, kind, a, b, 0 as removed from m union all select doc_id, 4, 'term', s, e, removed from added),
g as (select doc_id, count(*) filter (where k = 0) as n_email, count(*) filter (where k = 1) as n_ip, count(*) filter (where k = 2) as n_card, count(*) filter (where k = 3) as n_phone, count(*) filter (where k = 4) as n_term, sum(removed)::bigint as n_removed,
      string_agg(kind || ':' || a || ':' || b, ',' order by a, k) filter (where k < 4) as base, string_agg(kind || ':' || a || ':' || b, ',' order by a, k) as spans from every group by 1)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
       coalesce(n_term, 0) as n_term, coalesce(n_removed, 0)::bigint as n_removed
from documents left join g using (doc_id)
"""


QUERIES = {"op1_exact_topk": op1_exact_topk, "op2_bpe": op2_bpe, "op3_passages": op3_passages, "op4_secrets": op4_secrets, "op5_line_dedup": op5_line_dedup, "op6_simhash": op6_simhash, "op7_url_filters": op7_url_filters, "op8_hnsw": op8_hnsw, "op9_toxicity": op9_toxicity, "op10_mixing": op10_mixing, "op11_hard_negatives": op11_hard_negatives, "op12_whitening": op12_whitening, "op13_pii": op13_pii}
ORACLE_SQL = {"op1_exact_topk": OP1_SQL, "op4_secrets": OP4_SQL, "op5_line_dedup": OP5_SQL, "op7_url_filters": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op13_pii": OP13_SQL}
