"""Operators on tables small enough to check by hand or by a loop."""

from __future__ import annotations

import functools
import math
import random
from datetime import datetime

from pyspark.sql import functions as F

from tests.compare import DATA, connect, differences
from tests.metrics import joined_rows
from trellis.functions import text as X
from trellis.operators import diff, folds, matching, ranking, review, sets, trust
from trellis.operators.keep import written
from trellis.operators.nest import nest, with_latest
from trellis.queries import ORACLE_SQL, QUERIES

AS_OF = "2000-01-31 00:00:00"


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def dice(a, b):
    a, b = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_discovery_as_a_loop(spark):
    r = random.Random(1)
    names = [f"{r.choice('abcde')}{r.choice('xyz')} camp {r.choice('pq')}" for _ in range(120)]
    rows = [(i, i, n, r.choice([None, "", f"d{r.randrange(25)}.org"])) for i, n in enumerate(names)]
    providers = [(1000 + i, f"{c}x camp p", f"d{i}.org") for i, c in enumerate("ab")]
    found = {x.id: (x.kind, x.matched) for x in matching.discover(spark.createDataFrame(rows, "id long, seq long, name string, domain string"), spark.createDataFrame(providers, "id long, name string, domain string")).collect()}
    queue = []
    for i, _, name, domain in rows:
        exact = next((p for p, n, d in [*providers, *queue] if (domain and domain == d) or n == name), None)
        first = [p for p, n, d in providers if (domain and domain == d) or n == name]
        exact = min(first) if first else exact
        near = [(dice(name, n), -p) for p, n, _ in providers if 0.8 <= dice(name, n) < 1]
        want = ("exact-duplicate", exact) if exact is not None else ("near-duplicate", -max(near)[1]) if near else ("new", None)
        assert found[i] == want, i
        if exact is None:
            queue.append((i, name, domain))


def test_near_names_as_all_pairs(spark):
    r = random.Random(3)
    names = ["".join(r.choice("abcd ") for _ in range(r.randrange(1, 14))) for _ in range(80)]
    a = spark.createDataFrame(list(enumerate(names[:40])), "i int, a string")
    b = spark.createDataFrame(list(enumerate(names[30:])), "j int, b string")
    clean = lambda s: " ".join(s.split())
    for least in (0.5, 0.8):
        want = {(i, j) for i, x in enumerate(names[:40]) for j, y in enumerate(names[30:]) if dice(clean(x), clean(y)) >= least}
        assert {(x.i, x.j) for x in matching.near_names(a, "i", "a", b, "j", "b", least).collect()} == want


def test_chunks_are_numbered_on(spark):
    rows = [(0, 0, "chars:0-5"), (1, 1, "chars:10-15"), (2, 0, "chars:20-25"), (3, 1, "chars:30-35"), (4, 0, "chars:25-26"), (5, 2, None), (6, 0, "chars:40-41")]
    df = spark.createDataFrame([("s", *x) for x in rows], "source string, seq int, item int, locator string")
    found = {r.seq: (r.global_item, r.boundary) for r in folds.global_items(df).collect()}
    assert [found[i][0] for i in range(7)] == [0, 1, 2, 3, 2, 4, 5]
    assert [i for i in range(7) if found[i][1]] == [2, 6]


def test_rows_of_items(spark):
    rows = [
        (0, "ageGroups[].minAge", "5", 0.9, "five", 1), (1, "ageGroups[].maxAge", "9", 0.7, "nine", 1), (2, "ageGroups[].minAge", "6", 0.5, "six", 1),
        (3, "ageGroups[].minAge", "3", 0.4, "three", None), (4, "ageGroups[].minAge", "4", 0.4, "four", None), (5, "ageGroups[].maxAge", "8", 0.6, "eight", None), (6, "name", "Camp", 0.9, "Camp", None), (7, "name", "Other", 0.9, "Other", None),
    ]
    df = spark.createDataFrame([("s", 0, *x) for x in rows], "source string, global_item int, seq int, path string, value string, confidence double, excerpt string, sub int")
    found = folds.item_rows(df, "ageGroups", ["minAge", "maxAge"]).orderBy("row").collect()
    assert [(r.minAge, r.maxAge, r.label, r.confidence) for r in found] == [("6", "9", "six", 0.6), ("3", "8", "three", 0.5), ("4", None, "four", 0.4)]
    assert folds.item_scalars(df, ["name"]).first()["name"] == "Camp"
    tags = [(0, "tags[]", "A", 0.5, None), (1, "tags[]", "B", 0.6, 0), (2, "tags[]", "A", 0.9, None), (3, "tags[]", "C", 0.1, 0)]
    df = spark.createDataFrame([("s", 0, *x) for x in tags], "source string, global_item int, seq int, path string, value string, confidence double, sub int")
    assert [(r.value, r.confidence) for r in folds.item_tags(df, "tags").orderBy("n").collect()] == [("C", 0.1), ("A", 0.9)]


def test_items_alike_are_dropped_in_order(spark):
    names = ["Sunny Camp", "Sunny Camps", "Other", "sunny camp!", "Otter Land", "Other"]
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate(names)], "source string, item int, name string")
    assert sorted(r.item for r in folds.distinct_items(df).collect()) == [0, 2, 4]


def test_discovery_items_must_be_grounded(spark):
    rows = [
        (0, 0, "name", "Sunny", "the Sunny camp", "chars:0-5"), (1, 0, "detailUrl", "/a", "[Sunny](/a)", "chars:1-9"), (2, 0, "snippet", "fun", "so fun", "bad"),
        (3, 1, "name", "Ghost", "nothing", "chars:5-9"), (4, 2, "name", "Moon", "Moon", "chars:9-12"), (5, 2, "detailUrl", "ftp://x/", "[Moon](ftp://x/)", "chars:9-20"),
    ]
    df = spark.createDataFrame([("s", *x) for x in rows], "source string, seq int, item int, path string, value string, excerpt string, locator string")
    found = folds.discovery_items(df, "https://h.org/list").orderBy("item").collect()
    assert [(r.name, r.detail_url, r.snippet) for r in found] == [("Sunny", "https://h.org/a", None), ("Moon", None, None)]


def test_suppression_ends_after_thirty_days(spark):
    rows = [("a", "b", 0.7, "2000-01-01 00:00:00.001"), ("a", "b", 0.7, "2000-01-01 00:00:00"), ("a", "b", 0.8, "2000-01-30 00:00:00"), ("a", " A ", 0.9, None), (None, "b", 0.9, None), ("a", None, 0.9, None), ("a", "b", 0.29, None)]
    df = spark.createDataFrame(rows, "old string, new string, confidence double, at string").withColumn("approved_at", F.col("at").cast("timestamp"))
    assert [r["mode"] for r in diff.scalar_changes(df, AS_OF).collect()] == ["suppressed", "update", "update", "none", "populate", "none", "none"]


def test_relations_as_multisets(spark):
    keys = lambda *k: list(k)
    cases = [(keys("a"), keys("a")), (keys("a"), keys("a", "a")), (keys("a"), keys("a", "b")), (keys("a", "b"), keys("b", "a")), (keys(), keys("a")), (keys("a", "a"), keys("a", "b", "c")), (keys("a", None), keys("a"))]
    df = spark.createDataFrame(cases, "o array<string>, n array<string>")
    found = df.select(diff.relation_change(F.col("o"), F.col("n")).alias("c")).collect()
    assert [(r.c.changed, r.c.added, r.c.removed, r.c.additive) for r in found] == [(False, 0, 0, False), (True, 1, 0, False), (True, 1, 0, True), (False, 0, 0, False), (True, 1, 0, False), (True, 2, 1, False), (True, 0, 0, False)]


def test_lists_compare_without_order(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "a"], 0.9), (None, ["a"], 0.9), (["a"], [], 0.9), (["a"], ["a", "a"], 0.9)], "old array<string>, new array<string>, confidence double").withColumn("approved_at", F.lit(None).cast("timestamp"))
    assert [r["mode"] for r in diff.list_changes(df, AS_OF).collect()] == ["none", "populate", "none", "update"]


def test_corroboration(spark):
    """Same run, other case, outer spaces, null runs, two that agree."""
    rows = [("a", "s", "1", "f", "X"), ("b", "s", "1", "f", "X"), ("c", "s", "2", "f", "x"), ("d", "s", "2", "f", " X "), ("e", "s", None, "f", "X"), ("f", "t", "9", "f", "X"), ("g", "s", "3", "f", "X")]
    df = spark.createDataFrame(rows, "id string, subject string, run string, field string, value string")
    assert {r.id: r.corroborations for r in review.corroborated(df, df).collect()} == {"a": 2, "b": 2, "c": 0, "d": 3, "e": 0, "f": 0, "g": 3}


def test_camp_rollup(spark):
    camps = spark.createDataFrame([(i,) for i in range(5)], "camp_id int")
    fields = list(trust.CAMP_FIELDS)
    claims = [(i, f, "verified") for i in range(5) for f in fields if not (i == 3 and f == "city")]
    claims += [(1, "city", "disputed"), (4, "pricing", "stale")]
    claims = [c if not (c[0] == 2 and c[1] == "city") else (2, "city", "assumed") for c in claims]
    sessions = spark.createDataFrame([(0, "verified"), (2, "verified")], "camp_id int, state string")
    found = trust.camp_rollup(camps, spark.createDataFrame(claims, "camp_id int, requirement string, state string"), sessions)
    assert {r.camp_id: (r.state, r.confidence) for r in found.collect()} == {0: ("verified", "VERIFIED"), 1: ("disputed", "PLACEHOLDER"), 2: ("verified", "VERIFIED"), 3: ("unknown", "PLACEHOLDER"), 4: ("stale", "STALE")}


def test_rows_of_equal_names_are_unrolled_over_many_tasks(spark, monkeypatch):
    """All pairs of rows, a missing key and a repeated one among them, from lists that the joins meet; more pairs are more tasks."""
    monkeypatch.setattr(matching, "LIST", 7)
    monkeypatch.setattr(matching, "PAIRS", 100)
    a = [(i if i else None, ("north lake camp", "south hill", "")[i % 3]) for i in range(60)] + [(4, "south hill")]
    b = [(i, ("north lake camps", "south hills", None)[i % 3]) for i in range(90)]
    found = matching.near_names(spark.createDataFrame(a, "i int, n string"), "i", "n", spark.createDataFrame(b, "j int, m string"), "j", "m", digits=3)
    key = lambda p: (p[0] is None, p[0] or 0, p[1])
    want = sorted(((i, j, 0.966 if "lake" in n else 0.947) for i, n in a for j, m in b if n and m and n in m), key=key)
    assert sorted(map(tuple, found.collect()), key=key) == want and len(want) == 1_230
    assert found.rdd.getNumPartitions() == 12


def test_rollup_tasks_grow_with_the_claims(spark, monkeypatch):
    """A task holds so many claims, however many there are; a camp's row is made without one for each requirement; a camp told twice counts twice."""
    monkeypatch.setattr("trellis.operators.spread.ROWS", 500)
    n = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)
    for name in ("n20_camp_rollup", "n35_downgrades", "a24_trust_coverage"):
        df = QUERIES[name](spark, DATA)
        assert differences(df, ORACLE_SQL[name], connect()) == ""
        assert df.rdd.getNumPartitions() == n > 4
    camps = spark.createDataFrame([(1,), (1,), (None,)], "camp_id int")
    claims = spark.createDataFrame([(1, f, "assumed") for f in trust.CAMP_FIELDS] + [(None, "city", "verified"), (1, "other", "revoked")], "camp_id int, requirement string, state string")
    found = trust.camp_rollup(camps, claims, claims.limit(0).select("camp_id", "state"))
    assert {(r.camp_id, r.state, r.n, r.met) for r in found.collect()} == {(1, "verified", 18, 18), (None, "unknown", 9, 1)}


def test_claims_go_stale_by_kind(spark):
    claims = spark.createDataFrame([(1, "camp-scalar-field"), (2, "session-registration-status"), (3, "other"), (4, "session-dates")], "claim_id int, kind string")
    events = spark.createDataFrame([(i, 1, "verified", "1999-12-01 00:00:00") for i in (1, 2, 3)] + [(1, 2, "disputed", "1999-11-01 00:00:00")], "claim_id int, event_id int, state string, t string").withColumn("at", F.col("t").cast("timestamp"))
    assert {r.claim_id: r.state for r in trust.claim_states(claims, events, AS_OF).collect()} == {1: "verified", 2: "stale", 3: "verified", 4: "unknown"}


def test_nest_and_latest(spark):
    parents = spark.createDataFrame([(1,), (2,)], "k int")
    children = spark.createDataFrame([(1, 5, "b"), (1, None, "c"), (1, 2, "a")], "p int, o int, v string")
    rows = nest(parents, "k", {"c": (children, "p", ["v"], ["o", "v"])}).orderBy("k").collect()
    assert [[x.v for x in r.c] for r in rows] == [["a", "b", "c"], []]
    assert tuples(with_latest(parents, "k", children, "p", ["o"], ["v"])) == [(1, "b"), (2, None)]


def test_tables_take_in_rows(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "n")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "m"), (3, "c", "x")], "k int, v string, w string")
    assert tuples(sets.upsert(old, new, ["k"])) == [(1, "a", None), (2, None, "m"), (3, "c", "x")]
    assert tuples(sets.upsert(old, new, ["k"], {"v": "keep", "w": "fill"})) == [(1, "a", None), (2, "b", "n"), (3, "c", "x")]
    assert tuples(sets.insert_new(old, new, ["k"])) == [(1, "a", None), (2, "b", "n"), (3, "c", "x")]
    assert tuples(sets.union_by_key(["k"], old, new)) == [(1, "a", None), (2, None, "m"), (3, "c", "x")]


def test_harvest(spark):
    listings = spark.createDataFrame([(1, "Sunny Day Camp", "https://a"), (2, "Sunny Day Camps", "https://z"), (3, "Moon", ""), (4, "Entirely New", None)], "id int, name string, url string")
    existing = spark.createDataFrame([(10, "x", "https://a"), (11, "Sunny Day Camp", "https://b"), (12, "Moonlight", "")], "camp_id int, name string, url string")
    found = matching.match_or_create(listings, existing, lambda c: X.stripped_name(c, False))
    assert tuples(found) == [(1, "skipped", 10), (2, "flagged", 11), (3, "created", None), (4, "created", None)]


def test_hosts_are_visited_in_order_and_few_at_once(spark):
    rows = spark.createDataFrame([(i, f"h{i % 7}") for i in range(70)], "id int, host string")
    placed = ranking.by_host(rows, "host", [F.asc("id")], 20).withColumn("p", F.spark_partition_id())
    parts = [[(r.host, r.turn, r.id) for r in part] for part in placed.rdd.glom().collect()]
    assert len(parts) == ranking.AT_MOST
    assert all(part == sorted(part) for part in parts) and sum(map(len, parts)) == 70
    assert placed.groupBy("host").agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0
    assert ranking.by_host(rows, "host", [F.asc("id")]).rdd.getNumPartitions() == 3


def test_only_approved_entries_are_backfilled(spark):
    entry = "struct<approvedAt:timestamp,attestedBy:string,sourceUrl:string,excerpt:string,notes:string>"
    at = datetime(2024, 1, 1)
    sources = {"city": (at, None, "https://s", None, "n"), "pricing": (at, "ann", "https://s", "e", None), "category": (None, "ann", "https://s", "e", None), "unheardOf": (at, None, "https://s", "e", None)}
    camps = spark.createDataFrame([(1, sources), (2, None)], f"camp_id int, field_sources map<string,{entry}>")
    old = [(7, "CAMP", 1, "city", "STALE", None, None, None, at, None, None, "moved"), (8, "PROVIDER", 1, "city", "ACTIVE", None, None, None, at, at, "bob", None), (9, "CAMP", 1, "nowhere", "ACTIVE", None, None, None, at, at, "bob", None), (10, "CAMP", 1, "city", "INVALIDATED", "https://x", "q", None, at, at, "bob", None)]
    attestations = spark.createDataFrame(old, "id int, entity_type string, entity_id int, field string, status string, source_url string, excerpt string, notes string, observed_at timestamp, approved_at timestamp, approved_by string, reason string")
    none = spark.createDataFrame([], "id string")
    claims, evidence, events = trust.backfill(camps, attestations, none)
    assert sorted((r.claim_id, r.kind) for r in claims.collect()) == [("camp.1.city", "camp-scalar-field"), ("camp.1.pricing", "camp-repeated-field")]
    assert sorted((r.evidence_id, r.evidence_type, r.source_ref, r.excerpt, r.collected_by) for r in evidence.collect()) == [
        ("evidence.camp.1.city.attestation.10", "attestation", "https://x", "q", "bob"), ("evidence.camp.1.city.attestation.7", "attestation", "admin:backfill", "No excerpt was recorded.", "backfill"),
        ("evidence.camp.1.city.field-source", "crawl_observation", "https://s", "n", "backfill"), ("evidence.camp.1.pricing.field-source", "attestation", "admin:ann", "e", "ann"),
    ]
    told = {r.event_id: (r.state, r.type, r.verified_at is None, r.notes) for r in events.collect()}
    assert told["event.camp.1.city.attestation.10"] == ("revoked", "invalidation", True, None) and told["event.camp.1.city.attestation.7"] == ("stale", "invalidation", True, "moved")
    assert told["event.camp.1.city.field-source"] == ("verified", "verification", False, None) and len(told) == 4
    # a second run adds nothing
    known = claims.select(F.col("claim_id").alias("id")).union(evidence.select("evidence_id")).union(events.select("event_id"))
    assert [df.count() for df in trust.backfill(camps, attestations, known)] == [0, 0, 0]


def test_near_names_are_those_of_all_pairs(spark):
    r = random.Random(3)
    name = lambda: " ".join(r.choice(["red", "reds", "blue", "big", "bag", "camp", "camps", "a", "ab", "x", "xy", ""]) for _ in range(r.randrange(1, 4)))
    a, b = [(i, name()) for i in range(70)], [(i, name()) for i in range(70)]
    left, right = spark.createDataFrame(a, "i int, n string"), spark.createDataFrame(b, "j int, m string")
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    plain = lambda t: " ".join(t.split())
    for least in (0.5, 0.8, 1.0):
        want = {(i, j) for i, n in a for j, m in b if (x := grams(plain(n))) and (y := grams(plain(m))) and 2 * len(x & y) / (len(x) + len(y)) >= least}
        assert {(p.i, p.j) for p in matching.near_names(left, "i", "n", right, "j", "m", least).collect()} == want, least


def test_most_alike_is_that_of_all_pairs(spark):
    r = random.Random(5)
    name = lambda: " ".join(r.choice(["red", "redder", "blue", "big", "camp", "camping", "zoo", "q"]) for _ in range(r.randrange(1, 4)))
    a, b = [(i, name()) for i in range(40)], [(i, name()) for i in range(60)]
    threes = lambda t: {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}
    found: dict = {}
    for x in matching.most_alike(spark.createDataFrame(a, "i int, n string"), "i", "n", spark.createDataFrame(b, "j int, m string"), "j", "m").collect():
        found.setdefault(x.i, []).append((x.rank, x.j))
    for i, n in a:
        x = threes(n)
        scored = sorted((-len(x & threes(m)) / len(x | threes(m)), j) for j, m in b if x & threes(m))[:5]
        assert sorted(found.get(i, [])) == [(k + 1, j) for k, (_, j) in enumerate(scored)], (i, n)


def test_a_chain_of_candidates_is_decided_in_order(spark):
    # each shares its domain with the one before and its name with the one after
    rows = [(i, i, f"n{(i + 1) // 2}", f"d{i // 2}") for i in range(9)]
    queue = spark.createDataFrame(rows, "id int, seq int, name string, domain string")
    found = {x.id: (x.kind, x.matched) for x in matching.discover(queue, queue.limit(0).drop("seq")).collect()}
    taken, want = [], {}
    for i, _, n, d in rows:
        by = next((j for j, m, e in taken if m == n or e == d), None)
        want[i] = ("new", None) if by is None else ("exact-duplicate", by)
        if by is None:
            taken.append((i, n, d))
    assert found == want


def test_names_of_few_words_meet_seldom(spark):
    """Names that share most bigrams: joins write a small part of all pairs, and the pairs are right."""
    r = random.Random(7)
    words = ["large", "small", "hot", "blue", "old", "ring", "bolt", "plate", "gear", "nut", "economy", "standard", "promo", "medium"]
    a, b = ([(i, " ".join([*r.sample(words, 3), f"brand {r.randrange(30)}"])) for i in range(n)] for n in (400, 500))
    left, right = spark.createDataFrame(a, "i int, n string"), spark.createDataFrame(b, "j int, m string")
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    want = {(i, j) for i, n in a for j, m in b if 2 * len(grams(n) & grams(m)) / (len(grams(n)) + len(grams(m))) >= 0.8}
    found = set()
    joined = joined_rows(spark, lambda: found.update((p.i, p.j) for p in matching.near_names(left, "i", "n", right, "j", "m").collect()))
    assert found == want
    assert max(joined) < 0.1 * len(a) * len(b), (joined, len(want))


def test_queries_like_nothing_meet_few_rows(spark):
    """Queries that share one common trigram with all rows, or none: a bound of their own keeps most rows away."""
    a = [(i, f"q{i:04d} zz") for i in range(300)]
    b = [(i, f"camp zy{i % 7} {'x' * (i % 50)}w{i}") for i in range(1500)]
    found: dict = {}
    run = lambda: [found.setdefault(x.i, []).append((x.rank, x.j)) for x in matching.most_alike(spark.createDataFrame(a, "i int, n string"), "i", "n", spark.createDataFrame(b, "j int, m string"), "j", "m").collect()]
    joined = joined_rows(spark, run)
    threes = lambda t: {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}
    for i, n in a[:20]:
        x = threes(n)
        scored = sorted((-len(x & threes(m)) / len(x | threes(m)), j) for j, m in b if x & threes(m))[:5]
        assert len(scored) == 5 and sorted(found[i]) == [(k + 1, j) for k, (_, j) in enumerate(scored)], (i, n)
    assert max(joined) < 0.1 * len(a) * len(b), joined


def test_long_chains_of_candidates(spark):
    """Each candidate shares its domain with the one before and its name with the one after; some share with many. Decided as a loop does."""
    r = random.Random(11)
    chain = [(i, i, f"n{(i + 1) // 2}", f"d{i // 2}") for i in range(1500)]
    crowd = [(i, i, f"m{r.randrange(60)}", r.choice([None, f"e{r.randrange(60)}"])) for i in range(1500, 1900)]
    rows = chain + crowd
    queue = spark.createDataFrame(rows, "id int, seq int, name string, domain string").repartition(4)
    tables = []
    keep = lambda df: tables.append(1) or written(df)
    found = {x.id: (x.kind, x.matched) for x in matching.discover(queue, queue.limit(0).drop("seq"), keep=keep).collect()}
    names, domains, want = {}, {}, {}
    for i, _, n, d in rows:
        by = min((t for t in (names.get(n), domains.get(d) if d else None) if t is not None), default=None)
        want[i] = ("new", None) if by is None else ("exact-duplicate", by)
        if by is None:
            names[n] = i
            if d:
                domains[d] = i
    assert found == want and len(tables) < 120


def test_distinct_items_of_a_large_page(spark):
    r = random.Random(13)
    words = ["red", "blue", "camp", "club", "art", "chess", "robot", "swim", "dance", "drum"]
    rows = [("p", i, " ".join(r.choice(words) for _ in range(r.randrange(1, 4)))) for i in range(400)] + [("q", i, n) for i, n in enumerate([None, "", "a", "a", "red camp", "red camps", None])]
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)} if t else set()
    kept: list = []
    for s, i, n in rows:
        g = grams(n)
        if not any(k[0] == s and g and k[2] and 2 * len(g & k[2]) / (len(g) + len(k[2])) >= 0.75 for k in kept):
            kept.append((s, i, g))
    found = folds.distinct_items(spark.createDataFrame(rows, "source string, item int, name string").repartition(3)).collect()
    assert sorted((x.source, x.item) for x in found) == sorted((s, i) for s, i, _ in kept)


def test_means_add_up_in_their_order(spark):
    """Doubles whose mean lies on a half: the order of adding decides, not how the rows are split."""
    said = [0.0, 0.2, 0.25, 0.45]
    rows = [(k, i, c, "update") for k in range(200) for i, c in enumerate(said if k % 2 else said[::-1])] + [(k, 9, 5.0, "suppressed") for k in range(200)]
    half = lambda cs: math.floor(functools.reduce(lambda a, b: a + b, cs, 0.0) / len(cs) * 100 + 0.5) / 100
    want = {k: half(said if k % 2 else said[::-1]) for k in range(200)}
    assert set(want.values()) == {0.22, 0.23}
    for parts, seed in ((1, 1), (7, 2), (16, 3)):
        df = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "k int, i int, confidence double, mode string").repartition(parts)
        found = diff.overall_confidence(df, ["k"], F.col("i")).collect()
        assert {r.k: r.confidence for r in found} == want and all(r.changes == 4 for r in found)


def test_many_rows_of_one_name_or_site_are_no_pairs(spark):
    """What many candidates and providers share is looked up once: joins write rows as there are candidates, not all pairs."""
    n = 400
    rows = [(i, i, "sunny camp", "a.org") for i in range(n)] + [(n + i, n + i, "sunny campy", "") for i in range(n)]
    providers = [(9000 + i, "sunny campo", "b.org") for i in range(n)] + [(8000 + i, "sunny camp", "a.org") for i in range(n)]
    c, p = spark.createDataFrame(rows, "id long, seq long, name string, domain string"), spark.createDataFrame(providers, "id long, name string, domain string")
    found: dict = {}
    joined = joined_rows(spark, lambda: found.update({x.id: (x.kind, x.matched) for x in matching.verdicts(c, p, c.limit(0)).collect()}))
    assert found == {i: ("exact-duplicate", 8000) if i < n else ("near-duplicate", 8000) for i in range(2 * n)}
    assert max(joined, default=0) <= 4 * n, joined
    listings, camps = c.select("id", "name", F.col("domain").alias("url")), p.select(F.col("id").alias("camp_id"), "name", F.col("domain").alias("url"))
    found.clear()
    joined = joined_rows(spark, lambda: found.update({x.id: (x.action, x.camp_id) for x in matching.match_or_create(listings, camps, lambda t: X.stripped_name(t, False)).collect()}))
    assert found == {i: ("skipped" if i < n else "flagged", 8000) for i in range(2 * n)}
    assert max(joined, default=0) <= 4 * n, joined


def test_names_of_many_pages_are_cut_up_once(spark):
    """The grams of a name are made once, not once for each page that has it."""
    names = ["alpha camp", "alpha campy", "beta ring", "gamma wood", "delta lake"]
    rows = spark.createDataFrame([(p, i, names[(p + i) % 5]) for p in range(500) for i in range(3)], "source int, item int, name string")
    found: set = set()
    joined = joined_rows(spark, lambda: found.update((x.source, x.item) for x in folds.distinct_items(rows).collect()))
    want = set()
    for p in range(500):
        kept: list = []
        for i in range(3):
            if all(dice(names[(p + i) % 5], k) < 0.75 for k in kept):
                kept.append(names[(p + i) % 5])
                want.add((p, i))
    assert found == want and max(joined, default=0) <= 3 * 1500, joined


def test_keys_of_a_relation_are_made_once(spark):
    price = "array<struct<label:string,amount:double,unit:string,durationWeeks:double,ageQualifier:string,discountNotes:string>>"
    df = spark.createDataFrame([([], [])], f"old {price}, new {price}").withColumns({"confidence": F.lit(0.9), "approved_at": F.lit(None).cast("timestamp")})
    plan = diff.relation_changes(df, "pricing", AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("to_json") <= 2 * 2 * 2
