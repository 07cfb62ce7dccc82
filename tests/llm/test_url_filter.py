"""Rules and the cascade against plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.llm import url_filter
from trellis.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://Example.ORG/es/1?q#f", "https://a.b.example.org/en/12", "http://example.org/en/2", "http://xexample.org/es/", "http://EXAMPLE.com/fr/a", "https://x.com/de/", "https://x.net/de/",
    "http://h?x", "http://h#x", "a://b://c/d", "http:///p", "http://üÄ.org", "http://com/fr/", "ftp://user@host:80/p?x#y", "http://org",
]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    m = next((i for i, c in enumerate(rest[n:]) if c in "?#"), len(rest) - n)
    path = rest[n : n + m]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_rules(spark):
    rows = [*enumerate(URLS), (3, URLS[3]), (None, URLS[8])]
    df = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([("x.net/de/",), ("x.com/de/",), ("h",), ("nowhere",), (None,)], "key string")
    found = sorted(url_filter.judge_urls(df, URL_RULES, listed).collect(), key=str)
    want = []
    for i, url in rows:
        host, path, rule, verdict = judge(url)
        there = host + path in ("x.net/de/", "x.com/de/", "h")
        want.append((i, url, host, path, rule, verdict or ("block" if there else "allow"), there))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_cascade_is_exact(spark):
    universe = spark.range(6000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"))
    listed = universe.where(F.crc32("key") % 5 == 0)
    for shard_keys in (100, 5000):  # many shards, and one
        cascade = url_filter.build_cascade(universe.unionAll(universe), listed, bits_per_key=4, shard_keys=shard_keys)
        assert len(cascade.bits) > 2 and (cascade.shards > 1) == (shard_keys == 100)
        told = cascade.judge(universe, "key", "got")
        assert told.count() == 6000 and told.where(F.col("got") != (F.crc32("key") % 5 == 0)).count() == 0


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "page_id long, url string, host string, listed int")
    assert url_filter.judge_urls(df, URL_RULES, spark.createDataFrame([], "key string")).count() == 0
    df = spark.createDataFrame([(1, "http://a.net/x", "h", 7, "s", 5, "k")], "page_id long, url string, host string, c0 int, shard string, w0 int, key string")
    r = url_filter.judge_urls(df, URL_RULES, spark.createDataFrame([("a.net/x",)], "key string")).collect()
    assert [(x.page_id, x.host, x.c0, x.shard, x.w0, x.key, x.verdict, x.listed) for x in r] == [(1, "a.net", 7, "s", 5, "k", "block", True)]
