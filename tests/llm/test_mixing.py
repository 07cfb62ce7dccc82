"""The mix: targets by hand, bounds, and expected copies."""

from __future__ import annotations

import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import documents, odd_texts, words
from trellis.llm import mixing


def targets(sizes, weights=(1, 2, 3), most=3.0):
    """By sharing out and taking back until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        target |= {s: most * sizes[s] for s in over} if over else share
        free -= over or free
    return target


def run(spark, texts, sources, **how):
    return mixing.mix(documents(spark, texts, sources), **how).collect()


def test_targets_bounds_and_totals(spark):
    texts = [" ".join(words(1 + i * 7 % 50, i)) for i in range(900)] + odd_texts()
    sources = [None if i % 11 == 0 else f"s{i * i % 7}" if i % 3 else "big" for i in range(len(texts))]
    found = run(spark, texts, sources, bucket=8)
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    per: dict = {}
    for s, n in zip(sources, size, strict=True):
        per[s] = per.get(s, 0) + n
    want = targets(per)
    taken: dict = {}
    for r in found:
        assert r.size == size[r.doc_id] and r.source_size == per[r.source]
        assert abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.copies <= 3 and (r.size or not r.copies)
        rate = r.target / r.source_size
        assert int(rate) <= r.copies <= int(rate) + 1 or not r.size
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s, t in want.items():  # half a document at most
        assert abs(taken[s] - t) <= max(n for n, of in zip(size, sources, strict=True) if of == s) / 2
    assert sorted(map(tuple, found)) == sorted(map(tuple, run(spark, texts, sources, bucket=8)))


def test_mixed_documents_are_the_copies(spark):
    texts = [" ".join(words(5 + i % 9, i)) for i in range(60)] + [None, ""]
    sources = ["a" if i % 4 else None for i in range(len(texts))]
    df = documents(spark, texts, sources)
    df = df.unionAll(df.where("doc_id < 3"))
    copies = {}
    for r in mixing.mix(df).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    got: dict = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert r.text == texts[r.doc_id]
    assert got == {k: v for k, v in copies.items() if v}


def test_copies_are_fair(spark):
    """Over many seeds a document's copies average to its share."""
    texts, sources = ["a b c d"] * 40 + ["x y"] * 40, ["a"] * 40 + ["b"] * 40
    total = {0: 0, 40: 0}
    rate = {}
    for seed in range(12):
        for r in run(spark, texts, sources, seed=seed, bucket=8):
            rate[0 if r.doc_id < 40 else 40] = r.target / r.source_size
            total[0 if r.doc_id < 40 else 40] += r.copies
    for k, n in total.items():
        assert abs(n / (12 * 40) - rate[k]) < 0.1


def test_empty_and_wordless(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert [r.copies for r in run(spark, [None, "", " "], ["a", "b", None])] == [0, 0, 0]
    assert mixing.mixed_documents(documents(spark, [None, "", " "])).count() == 0


def unit(*longs):
    """As Spark's xxhash64 of longs, the last an int, made a number in [0, 1)."""
    h = 42
    for x in longs[:-1]:
        h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
    h = xxhash.xxh64_intdigest(struct.pack("<i", longs[-1]), h)
    return h % (1 << 40) / float(1 << 40)


def replay(items, seed):
    """Pivotal rounding of a bucket, pair by pair."""
    done, left = [], None
    for k, i, n, q in items:
        if left is None:
            left = (k, i, n, q)
            continue
        lk, li, a, p = left
        up, down = min(1 - p, q * n / a), min(p, (1 - q) * n / a)
        if unit(lk, li, k, i, seed) * (up + down) < down:
            p2, q2 = (1.0 if up == 1 - p else p + up), (0.0 if up == q * n / a else q - up * a / n)
        else:
            p2, q2 = (0.0 if down == p else p - down), (1.0 if down == (1 - q) * n / a else q + down * a / n)
        settled = [(x[0], x[1], x[2], 0.0 if v <= 1e-12 else 1.0 if v >= 1 - 1e-12 else v) for x, v in (((lk, li, a), p2), ((k, i, n), q2))]
        done += [x for x in settled if x[3] in (0.0, 1.0)]
        open_ = [x for x in settled if x[3] not in (0.0, 1.0)]
        done += [(*x[:3], float(round(x[3]))) for x in open_[1:]]
        left = open_[0] if open_ else None
    return done, left


def test_fold_as_pair_by_pair(spark):
    r = random.Random(3)
    for _ in range(6):
        items = [(r.randrange(1, 4), r.getrandbits(62), r.randrange(1, 500), r.random() * 0.98 + 0.01) for _ in range(r.randrange(1, 40))]
        df = spark.createDataFrame([(items,)], "x array<struct<k:long,id:long,n:long,p:double>>")
        f = df.select(mixing._fold(F.col("x"), F.lit(7)).alias("f")).first().f
        done, left = replay(items, 7)
        assert [tuple(x) for x in f.done] == done and (f.left and tuple(f.left)) == left
        # what was traded away and what was gained are the same words
        assert abs(sum(n * p for *_, n, p in items) - sum(n * p for *_, n, p in [*done, *([left] if left else [])])) < 1e-6 * sum(n for *_, n, _ in items)
