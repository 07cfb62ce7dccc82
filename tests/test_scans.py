"""Running values, numbers and slugs over many ranges, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trellis.operators import folds, ranking, scans
from trellis.operators.slugs import unique_slugs


@pytest.fixture
def many(spark):
    """Ranges so small that large keys span several."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_running_values_go_on_over_ranges(many):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.7 else r.choice(["a", "b", None]), i, r.randrange(-5, 50)) for i in range(600)]
    df = many.createDataFrame(rows, "k string, i int, v int").repartition(3)
    dealt = scans.in_ranges(df, ["k"], [F.col("i")])
    assert dealt.where("k = 'hot'").select("part_").distinct().count() > 2
    order = [F.col("i")]
    got = scans.running(dealt, ["k"], order, {"s": (scans.SUM, F.col("v")), "m": (scans.MAX, F.col("v"))})
    past = scans.running(dealt, ["k"], order, {"s": (scans.SUM, F.col("v")), "m": (scans.MAX, F.col("v"))}, before=True)
    want, before, at = {}, {}, {}
    for k, i, v in rows:
        before[i] = at.get(k, (None, None))
        at[k] = (at[k][0] + v, max(at[k][1], v)) if k in at else (v, v)
        want[i] = at[k]
    assert {x.i: (x.s, x.m) for x in got.collect()} == want
    assert {x.i: (x.s, x.m) for x in past.collect()} == before
    assert [x.n for x in scans.numbered(df, [], [F.desc("i")], "n").orderBy(F.desc("i")).collect()] == list(range(1, 601))


def loop(rows, taken=()):
    """rows: (order, slug)."""
    held, out = set(taken), {}
    for i, s in sorted(rows):
        if s is None:
            out[i] = None
            continue
        new, n = s, 2
        while new in held:
            new, n = f"{s}-{n}", n + 1
        held.add(new)
        out[i] = new
    return out


def slugs_of(spark, rows, taken=()):
    df = spark.createDataFrame([(i, s, "x") for i, s in rows], "i int, s string, g string").repartition(3)
    held = spark.createDataFrame([(t,) for t in taken], "s string") if taken else None
    found = unique_slugs(df, "s", [F.asc("i")], held)
    assert found.columns == ["i", "s", "g"]
    return {r.i: r.s for r in found.collect()}


def test_slugs_of_the_loop(many):
    for slugs, taken in [(["a", "a", "a-2"], []), (["b"], ["b", "b-2"]), (["a-2", "a", "a", "a-2-2", "a-2", "a-2"], []), (["", "", "-2", None, None], [""]), (["x-1", "x-1", "x-02", "x", "x"], ["x-3"])]:
        rows = list(enumerate(slugs))
        assert slugs_of(many, rows, taken) == loop(rows, taken), (slugs, taken)


@pytest.mark.parametrize("seed", range(3))
def test_random_slugs_of_the_loop(many, seed):
    r = random.Random(seed)
    name = lambda: r.choice("ab") + "".join(f"-{r.choice([2, 2, 3, 4, 7, 12])}" for _ in range(r.choice([0, 0, 0, 1, 1, 2, 3])))
    rows = [(i, name()) for i in range(250)]
    taken = {name() for _ in range(12)}
    found = slugs_of(many, rows, taken)
    assert found == loop(rows, taken)
    assert len(set(found.values())) == len(rows)


def test_one_slug_of_all_rows(many):
    rows = [(i, "camp") for i in range(2000)] + [(2000 + i, f"camp-{i}") for i in range(0, 4000, 3)]
    random.Random(5).shuffle(rows)
    rows = [(i, s) for i, (_, s) in enumerate(rows)]
    taken = [f"camp-{i}" for i in range(2, 900, 2)]
    assert slugs_of(many, rows, taken) == loop(rows, taken)


def numbers_of_the_loop(rows):
    """rows: (seq, item, place) of one source."""
    base, most, at, out = 0, -1, -1, {}
    for seq, item, place in sorted(rows):
        i, p = item or 0, -1 if place is None else place
        anew = i < most and p >= at
        if anew:
            base, most = base + most + 1, -1
        most, at = max(most, i), max(at, p)
        out[seq] = (base + i, anew)
    return out


def test_item_numbers_of_one_long_source(many):
    r = random.Random(2)
    place, sources = 0, {"long": [], "other": [], None: []}
    for seq in range(900):
        place += r.choice([-3, 0, 1, 5])
        s = "long" if r.random() < 0.8 else r.choice(["other", None])
        sources[s].append((seq, r.choice([None, 0, 1, 2, 3, 4]), place if r.random() < 0.8 else None))
    rows = [(s, seq, i, f"chars:{max(0, p)}-{max(0, p) + 4}" if p is not None else None) for s, mine in sources.items() for seq, i, p in mine]
    found = folds.global_items(many.createDataFrame(rows, "source string, seq int, item int, locator string").repartition(3)).collect()
    assert len(found) == len(rows)
    for s, mine in sources.items():
        got = {x.seq: (x.global_item, x.boundary) for x in found if x.source == s}
        assert got == numbers_of_the_loop([(seq, i, None if p is None else max(0, p)) for seq, i, p in mine]), s


def test_deep_pages_read_their_ranges(many):
    r = random.Random(3)
    rows = [(i, r.randrange(50)) for i in range(3000)]
    df = many.createDataFrame(rows, "k int, v int").repartition(5)
    pages = ranking.in_pages(df, [F.desc("v"), F.asc("k")])
    want = sorted(rows, key=lambda x: (-x[1], x[0]))
    for limit, offset in ((10, 0), (10, 2995), (25, 1500), (3000, 0), (5, 4000), (600, 700)):
        assert [(x.k, x.v) for x in pages.page(limit, offset).collect()] == want[offset : offset + limit]
    assert len(pages.counts) > 3 and len(pages.ranges(10, 1700)[0]) <= 2
    assert ranking.in_pages(df.limit(0), [F.asc("k")]).page(5).count() == 0
