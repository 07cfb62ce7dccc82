"""Secret scans: spans of candidates in every text, and how widely the corpus copies them.

Base kinds are found by fixed patterns. The method adds spans of its own: long mixed tokens are
candidates, and each candidate, base or mixed, is hashed and counted by the distinct owners and
repositories that hold it. What many owners share is an example that gets copied; what stays with
one owner looks live. A mixed token that looks live is added as kind ``live``; base spans stay either way.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.shared import materialize, text_or_empty
from trellis.llm.spans import SPAN, Kind, apart_from_base, found, written  # noqa: F401  written is for those who scan

#: The base kinds, in their order. The last two match whole runs, so their least length is in the pattern.
BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, lambda v: F.length(v) >= 8),
    Kind("access", r"AKIA[A-Z0-9]{12,}"),
    Kind("hex", r"[0-9a-f]{32,}"),
)
#: A run of 24 and more of a key's letters; it must hold a digit, a capital and a small letter.
MIXED = Kind("live", r"[A-Za-z0-9+/_-]{24,}", stays=lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]"))
#: A candidate that at most so many owners hold looks live.
MOST_OWNERS = 1
_SPANS = f"array<struct<{SPAN}>>"


def candidate_spans(documents: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """doc_id, owner, repository, base and mixed (arrays of spans), for every document."""
    text = text_or_empty("text")
    base = F.concat(*[found(text, kind, i) for i, kind in enumerate(BASE)])
    return documents.select("doc_id", owner.alias("owner"), repository.alias("repository"), base.alias("base"), found(text, MIXED, len(BASE)).alias("mixed"))


def ownership(spans: DataFrame) -> DataFrame:
    """hash, owners, repositories, uses: of each candidate value over the corpus. Counted in two steps, each
    combined before it is shuffled, so that a value in a third of all texts is no hot key."""
    each = spans.select("owner", "repository", F.explode(F.concat("base", "mixed")).alias("s")).select(F.col("s.hash").alias("hash"), "owner", "repository")
    once = each.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("uses"))
    by_owner = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("uses").alias("uses"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("uses").alias("uses"))


def scan(documents: DataFrame, owner: Column, repository: Column, most_owners: int = MOST_OWNERS) -> DataFrame:
    """One row for each row of ``documents``: doc_id, base and added (arrays of spans), n_copied, n_live (base
    spans whose value more than most_owners owners hold, and the others).

    owner and repository are columns of ``documents``; nulls count as one owner of their own. A null
    text is an empty one, without spans. Rows that repeat a doc_id are each scanned, and told
    apart by a hash of what was found. Values are told apart by 64 bits of hash. An empty table gives an empty table. Other columns
    aren't read."""
    whole = candidate_spans(documents, F.coalesce(owner, F.lit("")), F.coalesce(repository, F.lit("")))
    spans = materialize(whole.withColumn("row", F.xxhash64("doc_id", "owner", "repository", "base", "mixed")), "secret-spans")
    rare = ownership(spans).where(F.col("owners") <= most_owners).select("hash")
    base = lambda of, yes: F.transform(of, lambda s: F.struct(s.alias("s"), F.lit(yes).alias("base")))
    each = spans.where(F.size("base") + F.size("mixed") > 0).select(F.col("doc_id").alias("id_"), F.col("row").alias("row_"), F.explode(F.concat(base("base", True), base("mixed", False))).alias("e")).select("id_", "row_", "e.*")
    # rows that repeat all are told apart by nothing, so each has the spans of all of them; they are made one here
    each = apart_from_base(each.distinct())
    live = each.hint("merge").join(rare, F.col("s.hash") == rare["hash"], "left_semi").groupBy("id_", "row_")
    live = live.agg(F.count_if("base").alias("live"), F.collect_list(F.when(~F.col("base") & F.col("free"), F.col("s"))).alias("added"))
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("row") == F.col("row_"))
    n_live = F.coalesce("live", F.lit(0)).cast("long")
    return spans.join(live, same, "left").select("doc_id", "base", F.coalesce("added", F.array().cast(_SPANS)).alias("added"), n_live.alias("n_live"), (F.size("base") - n_live).alias("n_copied"))
