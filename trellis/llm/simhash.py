"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints link at RADIUS = 3 or fewer differing bits. Instead of comparing pairs, every
fingerprint emits the points around it: those one bit away or nearer (its inner ball) and those two
bits away (its outer ball). If two link, one's inner ball meets the other's outer or inner ball in a
point. Of three differing bits two lie in the same half of the 64, so the outer ball only needs
pairs of bits of a half. Points are shuffled; all that meet in a point where at least one has it in
its inner ball are within reach of that one, so a star around it holds the same groups as all the
links, in a number of rows that is linear in what was emitted. No pair within a group is listed.

Before that, fingerprints that can't link are set aside: with the bits in BLOCKS = 6 blocks, three
differing bits leave three blocks alike, so a fingerprint that shares no three blocks with another
has no partner. This is exact, and mostly only true neighbours go on to emit about 1,000 points.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.deploy import ship
from trellis.llm.components import components
from trellis.llm.shared import in_pieces, let_go, materialize, spread

BITS, RADIUS, BLOCKS = 64, 3, 6


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_of(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, A-Z lower-cased, repeats included."""
    parts = (text or "").encode().lower().split()  # of bytes: ASCII letters and white space only
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends])[:n].tolist()
    stops = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)
    on = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        on += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(on * 2 > n))


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = 3) -> DataFrame:
    """The columns in ``keep`` and fp, the fingerprint as a signed long. A null or blank text has 0."""
    ship(df.sparkSession)
    schema = df.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            found = [_signed(fingerprint_of(t.as_py(), words)) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.int64())], names=schema.names)

    return df.select(*keep, df[text].alias("text_")).mapInArrow(run, schema)


def _block_masks() -> list[int]:
    edges = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(c)) for c in combinations(blocks, BLOCKS - RADIUS)]


def _may_link(points: DataFrame) -> DataFrame:
    """The rows of ``points`` (fp, distinct) that share enough blocks with another."""
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(_block_masks())])
    rows = points.select("fp", F.explode(keys).alias("key")).select("fp", "key.i", "key.k")
    shared = rows.groupBy("i", "k").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("i", "k")
    # Spark takes exploded rows for as few as their source has; the hint keeps it from broadcasting them
    return rows.hint("merge").join(shared, ["i", "k"], "left_semi").select("fp").distinct()


def ball_links(points: DataFrame) -> DataFrame:
    """points: fp, distinct. Links (a, b), each at RADIUS or fewer differing bits; their connected groups
    are those of all such links. At most 1,057 fingerprints can meet in a point."""
    inner = [0, *(1 << b for b in range(BITS))]
    outer = [1 << p | 1 << q for half in (range(32), range(32, 64)) for p, q in combinations(half, 2)]
    flips = F.array(*[F.lit(_signed(m)) for m in inner + outer])
    near = materialize(_may_link(points), "simhash-near")
    moved = spread(near, near.count() * len(inner + outer), "fp").select("fp", F.posexplode(flips))
    moved = moved.select("fp", F.col("fp").bitwiseXOR(F.col("col")).alias("z"), (F.col("pos") < len(inner)).alias("inside"))
    met = moved.select("fp", F.min(F.when(F.col("inside"), F.col("fp"))).over(W.partitionBy("z")).alias("hub"))
    pairs = met.where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def _named(rows: DataFrame, key: str) -> DataFrame:
    """rows: key, fp. fp, component_id for each fingerprint."""
    points = rows.groupBy("fp").agg(F.min(key).alias("first"))
    roots = materialize(components(ball_links(points), "a", "b"), "simhash-roots")
    of = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return of.join(first, "root").select("fp", "component_id")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3) -> DataFrame:
    """One row for each row of ``df``: the key, fp (signed long) and component_id, the smallest key that can
    be reached over links, its own included.

    Rows with equal fingerprints are linked. A null or blank text has fingerprint 0 and is linked
    like any other. Rows with a null key have a component_id too, unless they are alone in theirs.
    Repeated rows give repeated rows; an empty table gives an empty table."""
    rows = materialize(fingerprints(df, text, (key,), words), "simhash-fp")
    return rows.join(_named(rows, key), "fp").select(key, "fp", "component_id")


# Texts alike in 8 shingles of 10. Their fingerprints of 64 bits differ in about 10, far beyond a ball. So a text
# gets PRINTS shorter ones of SHORT bits, each with an anchor, the least of its shingles by a hash of the print's
# own: texts alike at 0.8 have an anchor in common 8 times of 10, and differ there in 2 bits or fewer 4 times of 10.
# Only texts with one anchor meet, however many there are in all.
WORDS, ALIKE = 5, 0.8
PRINTS, SHORT = 6, 20
# Where more than CROWD meet in a point, they also meet by the least shingle of each of CORNERS ranges of hashes.
CROWD, CORNERS = 3, 32
ODD = np.uint64(0x9E3779B97F4A7C15)
STEPS = np.random.default_rng(42).integers(1 << 63, size=PRINTS, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles of a text, ascending; A-Z lower-cased; fewer words are one shingle, none are none."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends])[: max(1, len(parts) - words + 1)].tolist()
    stops = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64))


def prints_of(h: np.ndarray) -> tuple[list[int], list[int]]:
    """Anchors and short fingerprints of a set of shingles, which isn't empty."""
    anchors = [int(_mixed(h + step).min()) for step in STEPS]
    on = np.zeros(3 * BITS, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        bits = np.stack([_mixed(part * ODD + np.uint64(i)) for i in range(3)], 1).view(np.uint8)
        on += np.unpackbits(bits, axis=1, bitorder="little").sum(0, dtype=np.int64)
    high = on * 2 > len(h)
    return anchors, [int(sum(1 << b for b in np.flatnonzero(high[i * SHORT : (i + 1) * SHORT]).tolist())) for i in range(PRINTS)]


def _sketched(plain: DataFrame, text: str) -> DataFrame:
    """``plain`` with id (a hash of the text's set of shingles, 0 if it has none), anchors and prints."""
    ship(plain.sparkSession)
    n = len(plain.columns)
    schema = plain.select("*").schema.add("id", "long").add("anchors", T.ArrayType(T.LongType())).add("prints", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            ids, anchors, prints = [], [], []
            for value in batch.column(n):
                h = shingles(value.as_py())
                a, p = prints_of(h) if len(h) else ([], [])
                ids.append(_signed(xxhash.xxh3_64_intdigest(h.tobytes())) if len(h) else 0)
                anchors.append([_signed(x) for x in a])
                prints.append(p)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(ids, pa.int64()), pa.array(anchors, pa.list_(pa.int64())), pa.array(prints, pa.list_(pa.int32()))], names=schema.names)

    return plain.select(*plain.columns, plain[text].alias("text_")).mapInArrow(run, schema)


def _sets(texts: DataFrame) -> DataFrame:
    """texts: id, text. id and its shingles."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 64):
            found = [shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "set"])

    return texts.mapInArrow(run, "id long, set array<long>")


def corners_of(h: np.ndarray) -> np.ndarray:
    """The least of a text's shingles in each of CORNERS ranges of hashes; h: all of them, ascending."""
    edges = np.searchsorted(h, np.arange(CORNERS, dtype=np.uint64) << np.uint64(BITS - CORNERS.bit_length() + 1))
    return h[edges[edges < np.append(edges[1:], len(h))]]


def _verified(pairs: DataFrame, texts: DataFrame, alike: float) -> DataFrame:
    """Of the pairs (a, b) those whose sets of shingles are alike."""
    nodes = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = materialize(_sets(texts.join(nodes, "id", "left_semi")), "alike-sets")
    let_go(texts.sparkSession)
    side = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"{c}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(both >= alike * (F.size("a_set") + F.size("b_set") - both)).select("a", "b")


def alike_links(heads: DataFrame, texts: DataFrame, alike: float = ALIKE) -> tuple[DataFrame, DataFrame]:
    """heads: id, anchors, prints, distinct; texts: id, text, for each id one. Links (a, b), each with a Jaccard
    similarity of the shingles of ``alike`` or more, and the ids that were in a crowd: a text is held against the
    first and the last of those it meets in a point, which are all there are where up to CROWD meet."""
    flips = [0, *(1 << b for b in range(SHORT))]
    each = F.transform("prints", lambda p, i: F.struct(i.alias("i"), F.col("anchors")[i].alias("a"), p.alias("p")))
    rows = heads.select("id", F.explode(each).alias("e")).select("id", F.xxhash64("e.i", "e.a", "e.p").alias("own"), "e.*")
    # texts with one print and anchor move alike, so they are one point until its hubs are known
    points = rows.groupBy("own").agg(*[F.first(c).alias(c) for c in ("i", "a", "p")], F.min("id").alias("least"), F.max("id").alias("most"), F.count("id").alias("n"))
    points = materialize(points, "alike-points")
    ball = F.array(*[F.xxhash64("i", "a", F.col("p").bitwiseXOR(F.lit(m))) for m in flips])
    moved = spread(points, points.count() * len(flips), "own").select("own", "least", "most", "n", F.explode(ball).alias("z"))
    met = moved.groupBy("z").agg(F.min("least").alias("lo"), F.max("most").alias("hi"), (F.sum("n") > CROWD).alias("crowded")).where("lo <> hi")
    hubs = moved.select("own", "z").hint("merge").join(met, "z").select("own", "crowded", F.explode(F.array("lo", "hi")).alias("hub"))
    hubs = materialize(hubs.groupBy("own", "hub").agg(F.max("crowded").alias("crowded")), "alike-hubs")
    pairs = rows.select("id", "own").hint("merge").join(hubs, "own").where("id <> hub")
    pairs = materialize(pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "alike-pairs")
    let_go(heads.sparkSession)
    crowd = rows.join(hubs.where("crowded").select("own").distinct(), "own", "left_semi").select("id").distinct()
    return _verified(pairs, texts, alike), materialize(crowd, "alike-crowd")


def crowd_links(crowd: DataFrame, roots: DataFrame, texts: DataFrame, alike: float = ALIKE) -> DataFrame:
    """Links as above between texts of the crowd (id) that ``roots`` (node, root) holds apart.

    What the texts of a crowd have in common brought them to one point; what two of them share beyond that tells
    them from the rest. Each gives its corners as keys, and is held against the least and the greatest of another
    root in each. Corners that all have are again crowds, those that only copies have are not: pairs alike at 0.8
    in a family alike at 0.6 share 0.2 of their corners with nobody else, and miss all 32 once in a thousand times."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 64):
            found = [corners_of(shingles(t.as_py())).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "keys"])

    cut = texts.join(crowd, "id", "left_semi").select("id", "text").mapInArrow(run, "id long, keys array<long>")
    cut = cut.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    cut = materialize(cut, "alike-corners")
    rows = cut.select("id", "root", F.explode("keys").alias("k"))
    ends = F.struct("root", "id")
    met = rows.groupBy("k").agg(F.min(ends).alias("lo"), F.max(ends).alias("hi")).where("lo.root <> hi.root")
    pairs = rows.hint("merge").join(met, "k").select("id", "root", F.explode(F.array("lo", "hi")).alias("hub")).where("root <> hub.root")
    pairs = pairs.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()
    return _verified(materialize(pairs, "alike-pairs"), texts, alike)


def one_of_alike(df: DataFrame, text: str = "text", key: str = "doc_id", alike: float = ALIKE) -> DataFrame:
    """The rows of ``df``, with its columns, that stand for their group: of the texts that links of ``alike``
    similarity of their five-word shingles join, the row with the smallest key.

    Texts with one set of shingles are one text, told by 64 bits of hash; null and blank texts are one
    too. A text of fewer than five words is one shingle. A null key comes after all others. Rows that
    repeat the key and the text give one row, the first by a hash of their other columns. An empty table
    gives an empty table."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])  # so no column is called as one made here
    k, t = (f"c{names.index(c)}" for c in (key, text))
    rows = materialize(_sketched(plain, t), "alike-rows")
    order = F.struct(F.col(k).isNull().alias("late"), F.col(k).alias("k"))
    heads = rows.groupBy("id").agg(F.min(order).alias("head"), F.first("anchors").alias("anchors"), F.first("prints").alias("prints"))
    heads = materialize(heads, "alike-heads")
    on = lambda right: (F.col("id") == right["id_"]) & F.col(k).eqNullSafe(right["k_"])
    named = heads.select(F.col("id").alias("id_"), F.col("head.k").alias("k_"))
    texts = rows.select("id", k, F.col(t).alias("text")).join(named, on(named), "left_semi").select("id", "text")
    links, crowd = alike_links(heads.where(F.size("prints") > 0), texts, alike)
    links = materialize(links, "alike-links")
    let_go(df.sparkSession)
    roots = materialize(components(links, "a", "b"), "alike-roots")
    if not crowd.isEmpty():
        more = crowd_links(crowd, roots, texts, alike).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = materialize(components(more, "a", "b"), "alike-roots")
        let_go(df.sparkSession)
    of = heads.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    best = of.groupBy("root").agg(F.min(F.struct("head", "id")).alias("m")).select(F.col("m.id").alias("id_"), F.col("m.head.k").alias("k_"))
    kept = rows.join(best, on(best), "left_semi")
    if not kept.groupBy("id", k).count().where("count > 1").isEmpty():  # rows that repeat key and text
        others = [c for c, kind in plain.dtypes if c not in (k, t) and "map<" not in kind and "variant" not in kind]
        least = kept.groupBy("id", k).agg(F.min_by(F.struct(*plain.columns), F.xxhash64(F.lit(0), *others)).alias("row"))
        kept = least.select("row.*")
    return kept.select(*plain.columns).toDF(*names)
