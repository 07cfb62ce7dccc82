"""What goes on where it stopped, streams and roll-ups: the same rows as of one run."""

from __future__ import annotations

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from trellis.operators import trust
from trellis.operators.rollups import RollUp
from trellis.streaming import metrics as stream
from trellis.streaming import snapshots
from trellis.streaming.deliveries import Deliveries

PAGES = "source string, fetched_at timestamp, body string"


def put(spark, base, rows, schema, cast=()):
    df = spark.createDataFrame(rows, schema)
    for c in cast:
        df = df.withColumn(c, F.col(c).cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(f"file://{base}/in")


def changed_of_the_loop(rows):
    last, out = {}, []
    for s, at, body in rows:
        if s is None:
            continue
        body = body or ""
        if s in last and at < last[s][0]:
            continue
        if s not in last or last[s][1] != body:
            out.append((s, at, "changed" if s in last else "first"))
        last[s] = (at, body)
    return out


def test_only_changed_pages_go_on_also_after_a_restart(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    batches = [
        [("a", "2024-01-01 00:00:00", "one"), ("b", "2024-01-01 00:00:00", "x"), (None, "2024-01-01 00:00:00", "x")],
        [("a", "2024-01-02 00:00:00", "one"), ("b", "2024-01-02 00:00:00", "y"), ("c", "2024-01-02 00:00:00", None)],
        [("a", "2024-01-03 00:00:00", "two"), ("a", "2024-01-04 00:00:00", "one"), ("b", "2024-01-01 12:00:00", "late"), ("c", "2024-01-03 00:00:00", "")],
        [("a", "2024-01-05 00:00:00", "one"), ("b", "2024-01-05 00:00:00", "y"), ("c", "2024-01-04 00:00:00", "z")],
    ]
    for rows in batches:  # a run of the query for each, from the checkpoint of the last
        put(spark, base, rows, "source string, fetched_at string, body string", ["fetched_at"])
        pages = stream.read_events(spark, f"file://{base}/in", PAGES)
        stream.write(snapshots.changed_pages(pages), f"file://{base}/out", f"file://{base}/check").awaitTermination()
    found = spark.read.parquet(f"file://{base}/out").select("source", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "change", "body_hash", "previous_hash").collect()
    assert sorted((r.source, r.at, r.change) for r in found) == sorted(changed_of_the_loop([r for b in batches for r in b]))
    hashes = {(r.source, r.at): (r.body_hash, r.previous_hash) for r in found}
    assert hashes["a", "2024-01-04 00:00:00"] == (hashes["a", "2024-01-01 00:00:00"][0], hashes["a", "2024-01-03 00:00:00"][0])


def test_sources_are_forgotten(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    days = [[("a", 1, "one"), ("b", 1, "x")], [("b", 15, "x")], [("b", 20, "x")], [("a", 21, "one"), ("b", 21, "x"), ("c", 5, "late")]]
    for rows in days:
        put(spark, base, [(s, f"2024-01-{d:02d} 00:00:00", body) for s, d, body in rows], "source string, fetched_at string, body string", ["fetched_at"])
    stream.write(snapshots.changed_pages(stream.read_events(spark, f"file://{base}/in", PAGES), 10), f"file://{base}/out", f"file://{base}/check").awaitTermination()
    found = spark.read.parquet(f"file://{base}/out").select("source", F.dayofmonth("fetched_at").alias("d"), "change").collect()
    assert sorted(map(tuple, found)) == [("a", 1, "first"), ("a", 21, "first"), ("b", 1, "first")]


def test_a_batch_that_dies_between_its_steps_counts_once(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    table = Deliveries(spark, f"file://{base}/table", ("url",), "url string, name string")
    put(spark, base, [("u1", "a"), ("u2", "b"), ("u2", "c")], "url string, name string")
    put(spark, base, [("u2", "again"), ("u3", "d"), (None, "e")], "url string, name string")
    read = lambda: stream.read_events(spark, f"file://{base}/in", "url string, name string")

    def dies(staged):
        if staged["batch"] == 1:
            raise RuntimeError("the driver is gone")

    with pytest.raises(Exception, match="the driver is gone"):
        table.start(read(), f"file://{base}/check", dies).awaitTermination()
    assert sorted(r.url for r in table.rows().collect()) == ["u1", "u2"]
    for _ in range(2):  # the second finds nothing to do
        table.start(read(), f"file://{base}/check").awaitTermination()
        assert sorted((r.url or "", r.name, r.batch) for r in table.rows().collect()) == [("", "e", 1), ("u1", "a", 0), ("u2", "b", 0), ("u3", "d", 1)]
    assert [(m["batch"], m["inserted"], m["ignored"]) for m in table.manifests()] == [(0, 2, 1), (1, 2, 1)]
    assert table.reconcile() == 1 and table.reconcile() == 0
    assert table.rows().count() == 4


def test_one_attempt_finishes_a_batch(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    table = Deliveries(spark, f"file://{base}/table", ("k",), "k int, v string")
    batch = spark.createDataFrame([(1, "a")], "k int, v string")
    first, second = table.stage(batch, 7), table.stage(batch, 7)
    assert table.finish(second) and not table.finish(first)
    table.deliver(batch, 7)
    assert [tuple(r) for r in table.rows().collect()] == [(1, "a", 7)] and table.reconcile() == 1


def test_a_roll_up_after_each_batch_is_that_of_all_events(spark):
    base, r, every = tempfile.mkdtemp(prefix="spark-"), random.Random(4), []
    schema = "camp_id long, claim_id string, requirement string, kind string, event_id long, state string, t string"
    derive = lambda as_of: lambda subjects, events: trust.rollup_of_events(subjects, events, as_of)
    out = "camp_id long, state string, n long, met long, confidence string, due timestamp"
    for batch in range(10):
        as_of = f"2024-{batch + 1:02d}-28 00:00:00"
        camps = [r.randrange(1, 60) for _ in range(12)]
        rows = []
        for camp in camps if batch != 5 else []:  # one batch has no events
            for field in r.sample(trust.CAMP_FIELDS, r.choice([2, 8])):
                rows.append((camp, f"{camp}.{field}", field, r.choice(list(trust.VALID_DAYS)), len(every) + len(rows), r.choice(["verified", "verified", "disputed", "assumed"]), f"2024-{batch + 1:02d}-{r.randrange(1, 28):02d} 00:00:00"))
        kinds = {c: k for _, c, _, k, *_ in [*rows[::-1], *every[::-1]]}
        rows = [(a, c, q, kinds[c], *rest) for a, c, q, _, *rest in rows]
        every += rows
        of = lambda x: spark.createDataFrame(x, schema).withColumn("at", F.col("t").cast("timestamp")).drop("t")
        kept = RollUp(spark, f"file://{base}/r", "camp_id", out, derive(as_of), "due", 16)
        before = kept.versions()
        written = kept.add(of(rows), batch, as_of)
        want = derive(as_of)(of(every).select("camp_id").distinct(), of(every)).select(*kept.rows().columns)
        assert sorted(map(str, kept.rows().collect())) == sorted(map(str, want.collect())), batch
        assert all(kept.versions()[b] == v for b, v in before.items() if b not in written)
        assert kept.add(of(rows), batch, as_of) == []
    assert len(written) < 16
