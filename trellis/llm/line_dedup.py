"""Line dedup by a deletion-neighbourhood join: of lines within one edit of each other the earliest stays.

A line is dropped iff an earlier one of the corpus, in order of document and line, equals it or is one
insertion, deletion or substitution away, where both have FUZZY_FROM = 5 code points: one edit in
fewer leaves them alike in less than 0.8. The earlier line may itself have been dropped.

Equal lines first become one, by hash, with the earliest place. Of those, only lines that can have a
neighbour go on: two lines one edit apart share their first or last half, so a line whose four half
keys meet no other line has none. The rest emit every variant with one character deleted, as hashed
keys: with the place of the deletion, which meet for a substitution there, and without, which meet
the line that is the variant itself. Every line in a group is one edit from the group's earliest, so
a minimum for each key is enough, and no pairs within a group are listed. A group has only distinct
lines that one edit makes of one text, so it is bounded by the line's length and the alphabet. The
edit distance to the earliest is verified before a line goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.deploy import ship
from trellis.llm.shared import discard, let_go, materialize, spread, text_or_empty

FUZZY_FROM = 5
#: Where a line is: its document's key (null last), the hash of its text, as rows may repeat a key, and its number in it.
PLACE = ("late", "doc", "row", "line")
#: Odd numbers for hashing modulo 2**64, and the inverse of the base.
MIX, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _hash(*cols: Column) -> Column:
    """128 bits."""
    return F.struct(F.xxhash64(F.lit(11), *cols).alias("x"), F.xxhash64(F.lit(23), *cols).alias("y"))


def lines_of(documents: DataFrame, key: str, text: str) -> DataFrame:
    """late, doc, row, line (from 0) and l, of the lines that aren't blank."""
    t = text_or_empty(text)
    rows = documents.select(F.col(key).isNull().alias("late"), F.col(key).alias("doc"), F.xxhash64(t).alias("row"), F.posexplode(F.split(t, "\n")).alias("line", "l"))
    return rows.where(F.trim("l") != "")


def _halves(line: Column) -> Column:
    """Four keys, of which two lines one edit apart have one in common: the first and the last half, for the
    line's own length and for that less one."""
    n = F.length(line)
    keys = []
    for less in (0, 1):
        m = n - less
        half = F.floor(m / 2).cast("int")
        keys += [F.xxhash64(F.lit("a"), m, F.substring(line, F.lit(1), half)), F.xxhash64(F.lit("z"), m, F.substring(line, n - (m - half) + 1, m - half))]
    return F.array(*keys)


def variants(lines: DataFrame) -> DataFrame:
    """lines: place, l. place, key, role for each variant: role 0 the line itself, 1 one with a deletion, 2 one with
    a deletion and its place. The key of a text is a sum over its code points, mixed and times a power
    for the place; so all deletions of a line take time and room in its length."""
    ship(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(0)
            for i, text in enumerate(batch.column(1).to_pylist()):
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
                n = len(points)
                mixed = (points + np.uint64(1)) * MIX
                mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX
                upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * np.cumprod(np.full(n, BASE), dtype=np.uint64))])
                gone = upto[:-1] + (upto[-1] - upto[1:]) * BASE_INVERSE
                placed = (gone ^ (np.arange(n, dtype=np.uint64) * MIX)) * BASE
                keys = np.concatenate([upto[-1:], gone, placed]).view(np.int64)
                roles = np.repeat(np.array([0, 1, 2], np.int8), [1, n, n])
                for at in range(0, len(keys), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    same = places.take(pa.array(np.full(len(keys[part]), i)))
                    yield pa.RecordBatch.from_arrays([same, pa.array(keys[part]), pa.array(roles[part])], names=["place", "key", "role"])

    schema = lines.select("place").schema.add("key", "long").add("role", "byte")
    return lines.select("place", "l").mapInArrow(run, schema)


def kept_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", fuzzy_from: int = FUZZY_FROM) -> DataFrame:
    """late, doc, row, line: the lines that stay, without the blank ones."""
    spark = documents.sparkSession
    places = lines_of(documents, key, text).withColumn("place", F.struct(*PLACE))
    long = F.length("l") >= fuzzy_from
    first = places.select(_hash(F.col("l")).alias("h"), "place", F.when(long, _halves(F.col("l"))).alias("halves"))
    # a line's halves are those of any line equal to it
    first = first.groupBy("h").agg(F.min("place").alias("place"), F.first("halves").alias("halves"))
    first = materialize(first.select("place", "halves"), "lines")
    let_go(spark)
    half = first.where("halves is not null").select("place", F.explode("halves").alias("k"))
    shared = half.groupBy("k").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo <> hi").select("k")
    may = materialize(half.hint("merge").join(shared, "k", "left_semi").select("place").distinct(), "lines-may")
    let_go(spark)
    # rows that repeat key and text have one line at a place
    on = [places[c].eqNullSafe(may.place[c]) for c in PLACE]
    near = places.drop("place").join(may.hint("merge"), on[0] & on[1] & on[2] & on[3]).select("place", "l").dropDuplicates(["place"])
    near = materialize(near, "lines-near")
    discard(may)
    let_go(spark)

    points = near.agg(F.sum(2 * F.length("l") + 1)).first()[0] or 0
    every = variants(spread(near, points, "place"))
    own = W.partitionBy("key")
    earliest = lambda role: F.min(F.when(F.col("role") == role, F.col("place"))).over(own)
    # a line meets those cut from it, a cut line the line that is left, one with a place changed those changed there
    by = F.when(F.col("role") == 0, earliest(1)).when(F.col("role") == 1, earliest(0)).otherwise(earliest(2))
    pairs = every.select("place", by.alias("by")).where("by is not null and by < place").distinct()
    pairs = pairs.join(near, "place").join(near.select(F.col("place").alias("by"), F.col("l").alias("by_l")), "by")
    gone = materialize(pairs.where(F.levenshtein("l", "by_l", 1) >= 0).select("place").distinct(), "lines-gone")
    discard(near)
    let_go(spark)
    return first.join(gone, "place", "left_anti").select("place.*")


def dedup_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", fuzzy_from: int = FUZZY_FROM) -> DataFrame:
    """``documents``, row for row and with the columns it has; of the text, the lines that stay.

    Lines end at ``\\n``. Blank lines (of spaces, or none) are no lines to compare; they stay where some
    other line of the text does. A text whose every line goes, or that is blank, becomes empty; a null
    text stays null. The order is that of the keys, a null key after all others; rows that repeat a key
    are in order of a hash of their texts, and those that repeat the text too in order of a hash of
    their other columns. An empty table gives an empty table."""
    names = documents.columns
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])  # so no column is called as one made here
    k, t = (f"c{names.index(c)}" for c in (key, text))
    kept = kept_lines(plain, k, t, fuzzy_from).groupBy("doc", "row").agg(F.collect_list("line").alias("kept"))
    rows = plain.withColumn("r", F.xxhash64(text_or_empty(t)))
    slim = rows.where(F.col(t).isNotNull()).groupBy(F.col(k).alias("doc"), F.col("r").alias("row")).agg(F.count(F.lit(1)).alias("n"))
    twice = materialize(slim.where("n > 1").select("doc", "row"), "lines-twice")
    same = lambda right: F.col(k).eqNullSafe(right["doc"]) & (F.col("r") == right["row"])
    once = rows.withColumn("first", F.lit(True))
    if not twice.isEmpty():  # of rows that repeat key and text the first is as any row; the others lose every line
        others = [c for c, kind in plain.dtypes if c not in (k, t) and "map<" not in kind and "variant" not in kind]
        again = rows.where(F.col(t).isNotNull()).join(twice, same(twice), "left_semi").withColumn("o", F.xxhash64(F.lit(0), *others))
        each = again.groupBy(k, "r", "o").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*plain.columns)).alias("all"))
        least = each.groupBy(F.col(k).alias("doc"), F.col("r").alias("row")).agg(F.min("o").alias("least"))
        each = each.join(least, same(least)).select("all", "r", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: (i == 1) & (F.col("o") == F.col("least")))).alias("first"))
        once = once.join(twice, same(twice) & F.col(t).isNotNull(), "left_anti").unionByName(each.select("all.*", "r", "first"))
    # the numbers of the lines that stay, then the lines at those: a text takes time in its lines, not in their square
    split = once.withColumn("lines", F.split(F.col(t), "\n")).drop(t)
    blank = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.trim(F.col("lines")[i]) == "")
    stays = F.array_join(F.transform(F.array_sort(F.concat("kept", blank)), lambda i: F.col("lines")[i]), "\n")
    told = F.when(F.col("lines").isNull(), F.lit(None).cast("string")).when(F.col("kept").isNull() | ~F.col("first"), F.lit("")).otherwise(stays)
    found = split.join(kept, same(kept), "left")
    return found.select(*[told.alias(c) if c == t else F.col(c) for c in plain.columns]).toDF(*names)
