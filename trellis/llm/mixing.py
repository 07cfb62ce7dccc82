"""Mixing sources to target weights by pivotal dependent rounding, as a distributed reduction tree.

Each source has a target number of words; every document of a source gets the same expected number
of copies, target / size of the source. The whole part of that is given outright. The fraction is
settled by pivotal rounding: two documents with fractional copies trade mass, weighted by their
sizes so that the expected words stay put, until one of them is 0 or 1. Buckets of a few dozen
documents of a source are folded this way, each leaves one document at most, and those are bucketed
and folded again, up to one per source. So no task ever sees more than a bucket.

DataFrame functions only. A fold is an array aggregate inside a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.llm.shared import materialize, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a bucket, on average; a bucket's fold grows with its square.
BUCKET = 48
WEIGHTS, MOST = (1, 2, 3), 3.0
_ITEM = "struct<k:long,id:long,n:long,p:double>"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sizes: source, size. One row a source: source, source_size, target.

    Sources in order of their code points, null last, take the weights in turn. The shared total is
    all words. A target stops at ``most`` times the source's size; the excess goes to the others by
    weight. That is a water level: source i is at its cap iff cap / weight is under the level."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = W.orderBy("ratio", F.col("source").isNull(), "source")
    upto, onward = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(onward)
    per = per.withColumn("level", level)
    # the level of the first source that isn't at its cap holds for all of those
    per = per.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return per.select("source", "source_size", target.alias("target"))


def _unit(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _fold(items: Column, seed: Column) -> Column:
    """items: array of (k, id, n, p), p strictly between 0 and 1. Gives (done: array of items whose p
    is 0 or 1, left: the one item that may remain)."""

    def step(acc: Column, x: Column) -> Column:
        left = acc["left"]
        a, b, p, q = left["n"].cast("double"), x["n"].cast("double"), left["p"], x["p"]
        up = F.least(1 - p, q * b / a)  # left gains up, or loses down
        down = F.least(p, (1 - q) * b / a)
        gains = _unit(left["k"], left["id"], x["k"], x["id"], seed) * (up + down) < down
        left_p = F.when(gains, F.when(up == 1 - p, F.lit(1.0)).otherwise(p + up)).otherwise(F.when(down == p, F.lit(0.0)).otherwise(p - down))
        x_p = F.when(gains, F.when(up == q * b / a, F.lit(0.0)).otherwise(q - up * a / b)).otherwise(F.when(down == (1 - q) * b / a, F.lit(1.0)).otherwise(q + down * a / b))
        settle = lambda p: F.when(p <= 1e-12, F.lit(0.0)).when(p >= 1 - 1e-12, F.lit(1.0)).otherwise(p)
        put = lambda i, p: F.struct(i["k"].alias("k"), i["id"].alias("id"), i["n"].alias("n"), p.alias("p"))
        pair = F.array(put(left, settle(left_p)), put(x, settle(x_p)))
        over, open_ = F.filter(pair, lambda i: i["p"].isin(0.0, 1.0)), F.filter(pair, lambda i: ~i["p"].isin(0.0, 1.0))
        # of two that are still open (rounding of doubles), the first goes on and the other is rounded
        spare = F.transform(F.slice(open_, 2, 1), lambda i: put(i, F.round(i["p"])))
        traded = F.struct(F.concat(acc["done"], over, spare).alias("done"), F.try_element_at(open_, F.lit(1)).alias("left"))
        return F.when(left.isNull(), F.struct(acc["done"].alias("done"), x.alias("left"))).otherwise(traded)

    start = F.struct(F.array().cast(f"array<{_ITEM}>").alias("done"), F.lit(None).cast(_ITEM).alias("left"))
    return F.aggregate(items, start, step)


def pivotal_round(docs: DataFrame, seed: int = 7, bucket: int = BUCKET) -> DataFrame:
    """docs: source, id, k (together a row's key), n > 0, p strictly between 0 and 1.
    Gives id, k, extra (0 or 1).

    The tree has as many levels as it takes for the largest source to come down to one bucket."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("of"))
    most = counts.agg(F.max("of")).first()[0] or 0
    if not most:
        return docs.select("id", "k", F.lit(0).alias("extra"))
    docs = _with(docs, counts)
    # about a bucket of documents a source waits for the root, to make up for what is left there
    waits = _unit(F.lit(seed + 99), F.col("id"), F.col("k")) * F.col("of") < bucket
    settled, open_, level = [], docs.where(~waits), 0
    while True:
        root = bucket ** (level + 1) >= most
        buckets = F.ceil(F.col("of") / F.lit(float(bucket ** (level + 1))))
        key = F.pmod(F.xxhash64(F.lit(seed + level), "id", "k"), buckets)
        here = open_.unionByName(docs.where(waits)) if root else open_
        ranked = F.struct(F.col("n").alias("by"), _unit(F.lit(seed), F.col("id"), F.col("k")).alias("u"), F.struct("k", "id", "n", "p").alias("i"))
        items = here.groupBy("source", "of", key.alias("b")).agg(F.sort_array(F.collect_list(ranked), asc=False).alias("x"))
        folded = items.select("source", "of", _fold(F.transform("x", lambda x: x["i"].cast(_ITEM)), F.lit(seed)).alias("f"))
        if root:
            settled.append(folded.select(F.explode(_even_out(F.col("f"))).alias("i")))
            break
        folded = materialize(folded, "mix-level")
        settled.append(folded.select(F.explode("f.done").alias("i")))
        open_ = folded.where("f.left is not null").select("source", "of", "f.left.*")
        level += 1
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    return every.select("i.id", "i.k", F.col("i.p").cast("int").alias("extra"))


def _even_out(f: Column) -> Column:
    """The root's documents, the remaining one rounded to the nearer side; the words that this gives
    too few or too many are made up by turning over shorter documents of the root, longest first,
    each only where that comes closer to the target. These few dozen documents of a source are so
    chosen for the total, and their expected copies are no longer exactly their share."""
    rounded = F.transform(F.filter(F.array(f["left"]), lambda i: i.isNotNull()), lambda i: i.withField("p", F.round(i["p"])))
    items = F.concat(f["done"], rounded)
    miss = F.coalesce(f["left"]["n"] * (f["left"]["p"] - F.round(f["left"]["p"])), F.lit(0.0))
    by_size = F.transform(F.sort_array(F.transform(items, lambda i: F.struct(i["n"].alias("by"), i.alias("i"))), asc=False), lambda x: x["i"])

    def step(acc: Column, i: Column) -> Column:
        gain = F.when(i["p"] == 0, i["n"]).otherwise(-i["n"]).cast("double")
        turn = F.abs(acc["miss"] - gain) < F.abs(acc["miss"])
        put = i.withField("p", F.when(turn, 1 - i["p"]).otherwise(i["p"]))
        return F.struct(F.concat(acc["out"], F.array(put)).alias("out"), F.when(turn, acc["miss"] - gain).otherwise(acc["miss"]).alias("miss"))

    start = F.struct(F.array().cast(f"array<{_ITEM}>").alias("out"), miss.alias("miss"))
    return F.aggregate(by_size, start, step)["out"]


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equi-join on source in which null meets null. The right side has one row a source; Spark may
    broadcast it where its size at run time is small enough."""
    right = right.withColumnRenamed("source", "source_")
    return left.join(right, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")


def _keyed(rows: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Adds size, and id and k, together a row's key: a hash of key, source and text, and a number within that. Rows that
    repeat all three are alike, so which of them has which number doesn't matter."""
    hashed = F.xxhash64(F.col(key).isNull(), key, F.col(source).isNull(), source, F.col(text).isNull(), text)
    rows = rows.withColumns({"id": hashed, "size": word_count(text_or_empty(text))})
    within = W.partitionBy("id").orderBy(key, source, "size")
    return rows.withColumn("k", F.row_number().over(within).cast("long"))


def _copies(rows: DataFrame, key: str, text: str, source: str, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, bucket: int = BUCKET) -> DataFrame:
    """doc, id, k, size, source, source_size, target, copies for each row."""
    sizes = _keyed(rows.select(key, text, source), key, text, source)
    sizes = materialize(sizes.select(F.col(key).alias("doc"), F.col(source).alias("source"), "id", "k", "size"), "mix-sizes")
    docs = _with(sizes, source_targets(sizes, weights, most))
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    docs = docs.withColumn("sure", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    open_ = docs.where("p > 0").select("source", "k", "id", F.col("size").alias("n"), "p")
    docs = docs.join(pivotal_round(open_, seed, bucket), ["id", "k"], "left")
    return docs.select("doc", "id", "k", "size", "source", "source_size", "target", (F.col("sure") + F.coalesce("extra", F.lit(0))).alias("copies"))


def mix(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """Copies of each document: the key, k, size, source, source_size, target, copies. how: seed, weights, most, bucket.

    size counts ``[^\\x20\\x09-\\x0D]+`` in the text (null: 0). A null source is a source of its own,
    the last. Documents without words get no copies. Each row gets copies of its own: those that repeat
    key, source and text are told apart by k, and a null key is a key like any other. Reruns agree,
    whatever the partitioning. A source's words differ from its target by half a document's size at
    most, that of the last document of its tree, and as a rule by a few words, as shorter ones make up
    for it. Sources are taken for few: the windows over them, one row each, run in one task. An empty
    table gives an empty table. Only key, text and source are read; other columns don't matter."""
    found = _copies(documents.select(F.col(key).alias("c0"), F.col(text).alias("c1"), F.col(source).alias("c2")), "c0", "c1", "c2", **how)
    return found.select(F.col("doc").alias(key), "k", "size", F.col("source").alias(source), "source_size", "target", "copies")


def mixed_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: each document as often as mix() gives it copies, with the columns it has."""
    names = documents.columns
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])  # so no column is called as one made here
    at = [f"c{names.index(c)}" for c in (key, text, source)]
    copies = _copies(plain, *at, **how).groupBy(F.col("id").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("k", "copies"))).alias("times"))
    rows = _keyed(plain, *at).join(copies, F.col("id") == F.col("of"))
    times = F.array_repeat(F.lit(True), F.col("times")[F.col("k")].cast("int"))
    return rows.select(*plain.columns, F.explode(times).alias("copy")).select(*plain.columns).toDF(*names)
