"""URL filters: prefix rules, then a Bloom filter cascade over the corpus's own keys.

The cascade encodes a list of keys, so that judging never looks a url up in the list. Level 1 holds the
listed keys; level 2 holds the unlisted keys of the corpus that level 1 lets through by mistake; level
3 the listed ones that level 2 lets through, and so on until a level makes no mistake. The corpus is the
whole key universe, so the answer is exact for every url in it.

Keys are dealt over shards of about SHARD_KEYS listed ones by a hash, and each shard has levels of its
own, a few KB in one row. A url meets its shard's row: a table of shards that Spark sends to all tasks
while it is small, and deals out by shard where the list is too long for that. There is one way at
every size. Everything here is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.shared import ascii_lower, materialize

#: Bits of a filter for each key, and hashes of a key; a level errs on about 1 key in 120.
BITS_PER_KEY, HASHES = 10, 7
#: Listed keys of a shard, on average: its first level has 5 KB.
SHARD_KEYS = 4_096


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none does. Ties go to the earlier rule."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):  # the last one set wins
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * HASHES + i), key), F.lit(bits)) for i in range(HASHES)]


def _filters(keys: DataFrame, level: int, bits: int, shards: int) -> DataFrame:
    """keys: shard, key. shard and w{level}, an array of bits / 64 longs, for every shard."""
    n = bits // 64
    at = F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("at")
    set_words = keys.select("shard", at).groupBy((F.col("shard") * n + F.expr("at div 64")).alias("id")).agg(F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("word"))
    every = keys.sparkSession.range(shards * n).join(set_words, "id", "left").select(F.expr(f"id div {n}").alias("shard"), "id", F.coalesce("word", F.lit(0)).alias("word"))
    return every.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("id", "word"))).alias("w")).select("shard", F.col("w.word").alias(f"w{level}"))


def _contains(key: Column, level: int, bits: int) -> Column:
    hit = F.lit(True)
    for at in _positions(key, level, bits):
        word = F.element_at(F.col(f"w{level}"), F.floor(at / 64).cast("int") + 1)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
        hit = hit & (word.bitwiseAND(bit) != 0)
    return hit


@dataclass
class Cascade:
    """table: shard, w0, w1, …, a row a shard; bits: of each level."""

    table: DataFrame | None
    shards: int
    bits: list[int]

    def judge(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """``rows`` with the boolean ``name``: whether ``key``, one of the universe, is listed. A null key isn't."""
        if self.table is None:
            return rows.withColumn(name, F.lit(False))
        names = rows.columns
        plain = rows.toDF(*[f"c{i}" for i in range(len(names))])
        k = F.col(f"c{names.index(key)}")
        answer = F.lit(len(self.bits) % 2 == 1)
        for level in range(len(self.bits) - 1, -1, -1):
            answer = F.when(_contains(k, level, self.bits[level]), answer).otherwise(F.lit(level % 2 == 1))
        met = plain.withColumn("shard", F.coalesce(_shard(k, self.shards), F.lit(0))).join(self.table, "shard")
        met = met.select(*plain.columns, (k.isNotNull() & answer).alias("listed"))
        kept = [i for i, n in enumerate(names) if n != name]
        return met.select(*[F.col(f"c{i}").alias(names[i]) for i in kept], F.col("listed").alias(name))


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards))


def build_cascade(universe: DataFrame, listed: DataFrame, bits_per_key: int = BITS_PER_KEY, shard_keys: int = SHARD_KEYS) -> Cascade:
    """universe and listed have a string column ``key``; listed keys outside the universe are of no use
    and are left out. Null keys are in neither. An empty list gives a cascade that lists nothing."""
    universe = universe.select("key").where("key is not null").distinct()
    listed = listed.select("key").where("key is not null").distinct().withColumn("yes", F.lit(True))
    keys = materialize(universe.join(listed, "key", "left").select("key", F.coalesce("yes", F.lit(False)).alias("yes")), "url-keys")
    n = keys.where("yes").count()
    shards, bits, table = max(1, -(-n // shard_keys)), [], None
    keys = keys.withColumn("shard", _shard(F.col("key"), shards))
    encode, other = keys.where("yes").select("shard", "key"), keys.where("not yes").select("shard", "key")
    while True:
        # one size for all shards, which have about as many keys
        most = encode.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if not most:
            return Cascade(table, shards, bits)
        level = len(bits)
        bits.append(-(-most * bits_per_key // 64) * 64)
        more = materialize(_filters(encode, level, bits[-1], shards), "url-bits")
        wrong = materialize(other.join(more, "shard").where(_contains(F.col("key"), level, bits[-1])).select("shard", "key"), "url-wrong")
        table = more if table is None else materialize(table.join(more, "shard"), "url-levels")
        encode, other = wrong, encode


def judge_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict and listed to ``pages``.

    listed: key, the host and path of pages. rules come first (longest wins); else a listed page is
    blocked and any other is allowed. A null url, or one without ``://``, has an empty host and path;
    no rule fits it, and it is allowed unless the empty key is listed. An empty table gives an empty
    table. Repeated rows are judged alike. Columns of these names that pages already has are replaced;
    no other name matters."""
    names = pages.columns
    kept = [i for i, n in enumerate(names) if n not in ("host", "path", "rule", "verdict", "listed")]
    plain = pages.toDF(*[f"c{i}" for i in range(len(names))])
    address = plain[f"c{names.index(url)}"]
    parsed = plain.select(*[f"c{i}" for i in kept], host_of(address).alias("host"), path_of(address).alias("path"))
    parsed = parsed.withColumn("key", page_key(F.col("host"), F.col("path")))
    cascade = build_cascade(parsed.select("key"), listed)
    judged = cascade.judge(parsed, "key", "listed")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select(*[F.col(f"c{i}").alias(names[i]) for i in kept], "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "listed")


def page_key(host: Column, path: Column) -> Column:
    """What a page is listed by."""
    return F.concat(host, path)
