"""Hard negatives by an exact kNN join over Voronoi cells.

Inner products become distances: candidates get a last coordinate that makes all of them as long as the longest, anchors a
zero, and the nearest is then the one with the largest product. Bounded sampled rows are pivots; each candidate belongs to the
cell of its nearest one and knows its distance to it. Anchors are dealt over groups of neighbouring cells. An anchor first
searches a part of its own cell; what it finds there bounds how far it still has to look. By the triangle inequality only
candidates of a cell at certain distances from its pivot can be so near, and by the plane halfway between two pivots some cells
hold none at all. Those bounds, a row for each group and cell, replicate candidates only to groups they might serve, where
a join in integers is exact. That runs twice: for each anchor's positives, then for the negatives within their windows.

Cells of more rows than a task should hold are cut by a hash of the id, small neighbouring ones make up one zone. A group is
never a label or a cell as such, so neither a hot label nor a crowd of equal vectors is one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.deploy import ship
from trellis.llm.shared import discard, in_pieces, let_go, materialize
from trellis.llm.vectors import pairs_to_best, rows_within, usable

SCALE = 256.0
#: A pivot for so many rows, at most so many; the pivots, of bounded width together, go to every task.
ROWS_PER_PIVOT, MOST_PIVOTS, PIVOT_CELLS = 512, 1_024, 1 << 21
ZONE_ROWS, GROUP_ROWS, CHUNK = 16_384, 1_024, 4_096
#: Bounds are in doubles; distances count as equal within this share of the longest vectors.
MARGIN = 1e-6
LONG = (1 << 63) - 1


def whole(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) as doubles, a row for each list; short ones end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(float)[offsets[0] : offsets[-1]]
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return np.floor(SCALE * out)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows that hold integers, exact as longs; beyond a long they stop at its ends."""
    if float(np.linalg.norm(a, axis=1).max(initial=0)) * float(np.linalg.norm(b, axis=1).max(initial=0)) < 2**53:
        return (a @ b.T).astype(np.int64)
    left, right = (np.array([int(v) for v in x.ravel()], object).reshape(x.shape) for x in (a, b))
    return np.array([[max(-LONG, min(LONG, int(s))) for s in row] for row in left @ right.T], np.int64).reshape(len(a), len(b))


@dataclass(frozen=True)
class Cells:
    """Pivots (with their last coordinate), the square of the longest candidate's length, and where each cell's rows go."""

    pivots: np.ndarray
    longest: float
    #: of each cell: the least and the largest distance from its pivot
    near: np.ndarray
    far: np.ndarray
    #: of each cell: its zone, and into how many parts it is cut
    zone: np.ndarray
    parts: np.ndarray

    @property
    def slack(self) -> float:
        return MARGIN * (1 + self.longest**0.5)

    def distances(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        """From each row, with its last coordinate, to each pivot."""
        full = np.hstack([x, last[:, None]])
        square = (full**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * full @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def of_candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance of each; where lengths don't fit a double there is one cell, and no bound holds anything off."""
        if not np.isfinite(self.longest):
            return np.zeros(len(x), np.int32), np.zeros(len(x))
        d = self.distances(x, np.sqrt(np.maximum(self.longest - (x**2).sum(1), 0)))
        cell = d.argmin(1)
        return cell.astype(np.int32), d[np.arange(len(x)), cell]

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x, np.zeros(len(x))) if np.isfinite(self.longest) else np.zeros((len(x), 1))

    def reach(self, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For anchors x that look for scores of ``least`` and up: from each pivot the least and largest distance at which
        one of the cell's rows can have it; least above largest where none can."""
        d = self.of_anchors(x)
        if not np.isfinite(self.longest):
            return np.full(d.shape, -np.inf), np.full(d.shape, np.inf)
        length = (x**2).sum(1)
        slack = self.slack + MARGIN * np.sqrt(length)
        radius = np.sqrt(np.maximum(length + self.longest - 2 * least, 0)) + slack
        home = d.argmin(1)
        apart = np.sqrt(np.maximum((self.pivots**2).sum(1)[home][:, None] + (self.pivots**2).sum(1) - 2 * self.pivots[home] @ self.pivots.T, 0))
        # how far the plane halfway between the anchor's own pivot and another is from it
        plane = (d**2 - d[np.arange(len(x)), home][:, None] ** 2) / (2 * np.maximum(apart, slack[:, None]))
        low, high = d - radius[:, None], d + radius[:, None]
        gone = (plane > radius[:, None]) & (apart > slack[:, None])
        return np.where(gone, np.inf, low), np.where(gone, -np.inf, high)


def _order(pivots: np.ndarray, ids: np.ndarray, out: list[int]) -> list[int]:
    """The pivots in an order that keeps neighbours together: halved along their widest direction, again and again."""
    if len(ids) <= 2:
        out += ids.tolist()
    else:
        off = pivots[ids] - pivots[ids].mean(0)
        along = off @ off[np.argmax((off**2).sum(1))]
        ids = ids[np.argsort(along, kind="stable")]
        _order(pivots, ids[: len(ids) // 2], out)
        _order(pivots, ids[len(ids) // 2 :], out)
    return out


def packed(counts: np.ndarray, order: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and number of parts of each cell: neighbours share a bin while it holds at most so many rows; a cell of more
    has one of its own, in parts."""
    bins, parts, at, held = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32), 0, 0
    for c in order:
        if held and held + counts[c] > most:
            at, held = at + 1, 0
        bins[c], parts[c], held = at, max(1, -(-int(counts[c]) // most)), held + int(counts[c])
    return bins, parts


def _by_cell(cells: Cells, width: int) -> Callable:
    """Adds cell and away (the distance) to rows id, label, v, anchor; cell is the anchor's own for anchors in home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, rows_within(4096, max(width, len(cells.pivots)))):
            x = whole(batch.column("v"), width)
            cell, away = cells.of_candidates(x)
            home = cells.of_anchors(x).argmin(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away), pa.array(home)], names=[*batch.schema.names, "cell", "away", "home"])

    return run


def _part(of: str, parts: np.ndarray, salt: int) -> Column:
    """Which part of its cell a row belongs to, by a hash of its id."""
    hot = {int(c): int(p) for c, p in enumerate(parts) if p > 1}
    if not hot:
        return F.lit(0)
    many = F.create_map(*[F.lit(x) for c, p in hot.items() for x in (c, p)])[F.col(of)]
    return F.coalesce(F.pmod(F.xxhash64(F.lit(salt), "id"), many).cast("int"), F.lit(0))


def _mapped(of: str, to: np.ndarray) -> Column:
    return F.element_at(F.lit([int(x) for x in to]), F.col(of) + 1)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keep = pairs_to_best(query, ids, scores, k)
    return query[keep], ids[keep], scores[keep]


def _top(may: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, id and score of each row's k best columns among those that may; ties to smaller ids."""
    held = np.where(may, scores, -LONG - 1)
    if held.shape[1] > 4 * k:
        may = may & (held >= np.partition(held, -k, axis=1)[:, -k][:, None])
    q, c = np.nonzero(may)
    return _best(q, ids[c], scores[q, c], k)


def find_positives(a: pa.Table, b: pa.Table, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the anchor, id and score of its k best rows with its label."""
    ids, labels, x = a.column("id").to_numpy(), a.column("label").to_numpy(), whole(a.column("v"), width)
    found = [np.zeros(0, np.int64)] * 3
    for at in range(0, b.num_rows, CHUNK):
        c = b.slice(at, CHUNK)
        other, s = c.column("id").to_numpy(), products(x, whole(c.column("v"), width))
        new = _top((labels[:, None] == c.column("label").to_numpy()) & (ids[:, None] != other), s, other, k)
        found = _best(*(np.concatenate(y) for y in zip(found, new, strict=True)), k)
    return found


def find_negatives(a: pa.Table, b: pa.Table, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the anchor, place of the positive among its own, id and score of the k best rows of other labels in the
    positive's window. a has low and high, an array each: the windows' ends."""
    labels, x = a.column("label").to_numpy(), whole(a.column("v"), width)
    windows = list(zip(a.column("low").to_pylist(), a.column("high").to_pylist(), strict=True))
    most = max(len(w[0]) for w in windows)
    low = np.array([[*w[0], *[LONG] * (most - len(w[0]))] for w in windows], np.int64)
    high = np.array([[*w[1], *[-LONG] * (most - len(w[1]))] for w in windows], np.int64)
    found = [np.zeros(0, np.int64)] * 3
    for at in range(0, b.num_rows, CHUNK):
        c = b.slice(at, CHUNK)
        other, s = c.column("id").to_numpy(), products(x, whole(c.column("v"), width))
        differs, new = labels[:, None] != c.column("label").to_numpy(), []
        for p in range(most):
            q, i, v = _top(differs & (s >= low[:, p, None]) & (s <= high[:, p, None]), s, other, k)
            new.append((q * most + p, i, v))
        found = _best(*(np.concatenate(y) for y in zip(found, *new, strict=True)), k)
    return found[0] // most, found[0] % most, found[1], found[2]


def _meet(rows: DataFrame, anchors: DataFrame, wanted: DataFrame, cells: Cells, search: Callable, schema: str) -> DataFrame:
    """search(anchors of a group, candidates of a zone it might be served by). wanted: group, cell, low, high."""
    parts, zone = F.sequence(F.lit(0), _mapped("cell", cells.parts) - 1), _mapped("cell", cells.zone)
    # a cell's parts are keys of their own, so that a crowded cell's candidates meet the groups in many tasks
    each = wanted.select("cell", F.explode(parts).alias("part"), "group", "low", "high")
    some = rows.withColumn("part", _part("cell", cells.parts, 3)).join(each, ["cell", "part"]).where(F.col("away").between(F.col("low"), F.col("high")))
    left = some.select("group", zone.alias("zone"), "part", "id", "label", "v").toDF("group", "zone", "part", "id", "label", "v")
    right = anchors.join(each.select("group", zone.alias("zone"), "part").distinct(), "group")
    return right.groupBy("group", "zone", "part").cogroup(left.groupBy("group", "zone", "part")).applyInArrow(search, schema)


def _wanted(anchors: DataFrame, cells: Cells, width: int) -> DataFrame:
    """anchors: group, v, least. A row for each group and cell whose rows might serve it: how far from the pivot they are."""

    def bounds(table: pa.Table) -> pa.Table:
        x, least = whole(table.column("v"), width), table.column("least").to_numpy(zero_copy_only=False).astype(float)
        low, high = cells.reach(x, least)
        low, high = np.maximum(low.min(0), cells.near - cells.slack), np.minimum(high.max(0), cells.far + cells.slack)
        c = np.flatnonzero(low <= high)
        return pa.table({"group": np.full(len(c), table.column("group")[0].as_py(), np.int64), "cell": pa.array(c, pa.int32()), "low": low[c], "high": high[c]})

    return anchors.select("group", "v", "least").groupBy("group").applyInArrow(bounds, "group long, cell int, low double, high double")


def _cells(rows: DataFrame, width: int, per_pivot: int, zone_rows: int, group_rows: int) -> tuple[Cells, DataFrame, np.ndarray, np.ndarray]:
    """The cells, the rows with theirs (written), and each cell's bin and parts of anchors. Pivots are the first rows by a hash."""
    floor = lambda x: x * SCALE - F.pmod(x * SCALE, F.lit(1.0))  # noqa: E731  in doubles: F.floor gives longs, which end
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + floor(x) * floor(x)))).first()
    longest = float(longest or 0.0) * (1 + 1e-12)
    m = max(1, min(n // per_pivot, MOST_PIVOTS, PIVOT_CELLS // (width + 1)))
    picked = rows.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(m).select("v").toArrow() if np.isfinite(longest) else None
    pivots = np.unique(whole(picked.column("v"), width), axis=0) if picked and picked.num_rows else np.zeros((1, width))
    pivots = np.hstack([pivots, np.sqrt(np.maximum(longest - (pivots**2).sum(1), 0))[:, None]])
    none = np.zeros(len(pivots))
    cells = Cells(pivots, longest, none, none, none, none)
    placed = rows.mapInArrow(_by_cell(cells, width), "id long, label long, v array<double>, anchor boolean, cell int, away double, home int")
    placed = materialize(placed, "negative-cells")
    counts, owned, near, far = (np.zeros(len(pivots)) for _ in range(4))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).collect():
        counts[r.cell], near[r.cell], far[r.cell] = r.n, r.near, r.far
    far[counts == 0], near[counts == 0] = -np.inf, np.inf
    for r in placed.where("anchor").groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect():
        owned[r.home] = r.n
    order = _order(pivots, np.arange(len(pivots)), [])
    return Cells(pivots, longest, near, far, *packed(counts, order, zone_rows)), placed, *packed(owned, order, group_rows)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int, negatives: int, key: str = "vec_id", vector: str = "embedding", label: str = "label", window: tuple[int, int] = (50, 95),
    per_pivot: int = ROWS_PER_PIVOT, zone_rows: int = ZONE_ROWS, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """anchor_id, positive_id long, rank int, negative_id, positive_score, negative_score long.

    For each row that is_anchor holds for, its best rows of the same label are its
    positives; for each of those the best rows of other labels come whose score, in percent of the positive's, lies in the window (no
    row, where the positive's score is below zero). A score is the inner product of floor(256 * x); ties go to the smaller id.

    Rows with a null id or label, and vectors that are null or hold null or non-finite components, take no part. Of rows
    that repeat an id the least vector, then the least label counts. Vectors shorter than the longest end in zeros; an empty one scores
    0. Scores beyond a long stop at its ends, and windows are of those. An empty table, or one without anchors, gives no
    rows. Only the three columns are read."""
    spark = rows.sparkSession
    ship(spark)
    fine = usable(vector) & F.col(key).isNotNull() & F.col(label).isNotNull()
    row = F.struct(F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(fine).select(F.col(key).cast("long").alias("id"), row.alias("row"))
    rows = rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v", "row.anchor")
    rows = materialize(rows, "negative-rows")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    cells, placed, bins, blocks = _cells(rows, width, per_pivot, zone_rows, group_rows)
    discard(rows)
    many, most = int(bins.max()) + 1, int(blocks.max())
    candidates = placed.select("id", "label", "v", "cell", "away")
    group = F.col("bin") * most + F.col("block")
    bare = placed.where("anchor").select("id", "label", "v", "home", _mapped("home", bins).cast("long").alias("bin"), _part("home", blocks, 4).cast("long").alias("block"))

    def at_home(anchors: DataFrame) -> DataFrame:
        """Groups by cell, each with the first part of its own cell: rows enough for a bound, never more than a task holds."""
        own = anchors.withColumn("group", F.col("home") * most + F.col("block"))
        first = candidates.where(_part("cell", cells.parts, 3) == 0).join(own.select(F.col("home").alias("cell"), "group").distinct(), "cell")
        return own.groupBy("group").cogroup(first.toDF(*first.columns).groupBy("group"))

    def search_positives(a: pa.Table, b: pa.Table) -> pa.Table:
        q, ids, s = find_positives(a, b, width, positives)
        return pa.table({"anchor_id": a.column("id").to_numpy()[q].astype(np.int64), "positive_id": ids, "score": s})

    def bound_positives(a: pa.Table, b: pa.Table) -> pa.Table:
        q, _, s = find_positives(a, b, width, positives)
        full, lowest = np.bincount(q, minlength=a.num_rows) >= positives, np.full(a.num_rows, np.inf)
        np.minimum.at(lowest, q, s.astype(float))
        return pa.table({"id": a.column("id"), "least": np.where(full, lowest, -np.inf)})

    def by_group(anchors: DataFrame, least: DataFrame) -> DataFrame:
        """Those without a bound are groups of their own, as they must look everywhere."""
        return anchors.join(least, "id").withColumn("group", group + F.when(F.col("least") == float("-inf"), many * most).otherwise(0))

    score = "anchor_id long, positive_id long, score long"
    one = materialize(by_group(bare, at_home(bare).applyInArrow(bound_positives, "id long, least double")), "negative-anchors")
    wanted = materialize(_wanted(one, cells, width), "negative-bounds")
    found = _meet(candidates, one.select("group", "id", "label", "v"), wanted, cells, search_positives, score)
    order = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    best = materialize(found.withColumn("place", order).where(F.col("place") <= positives), "negative-positives")
    discard(one)
    discard(wanted)
    let_go(spark)

    down, up = window
    # exact beyond what a long holds times a hundred: 100 * score is down at least, up at most
    wide = F.col("score").cast("decimal(38,0)")
    low, high = F.ceil(wide * down / 100).cast("long"), F.floor(wide * up / 100).cast("long")
    windows = best.where(F.col("score") >= 0).groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("place", low.alias("low"), high.alias("high")))).alias("w"))
    seeking = materialize(bare.join(windows.select("id", F.col("w.place").alias("place"), F.col("w.low").alias("low"), F.col("w.high").alias("high")), "id"), "negative-windows")

    def search_negatives(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return pa.table({"anchor_id": pa.array([], pa.int64()), "place": pa.array([], pa.int32()), "negative_id": pa.array([], pa.int64()), "negative_score": pa.array([], pa.int64())})
        q, p, ids, s = find_negatives(a, b, width, negatives)
        places = a.column("place").to_pylist()
        return pa.table({"anchor_id": a.column("id").to_numpy()[q].astype(np.int64), "place": pa.array([places[i][j] for i, j in zip(q, p, strict=True)], pa.int32()), "negative_id": ids, "negative_score": s})

    def bound_negatives(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "least": pa.array([], pa.float64())})
        q, p, _, s = find_negatives(a, b, width, negatives)
        low = a.column("low").to_pylist()
        wide = max(map(len, low))
        least = np.array([[float(x) for x in r] + [np.inf] * (wide - len(r)) for r in low])
        slot = q * wide + p
        full = np.bincount(slot, minlength=least.size) >= negatives
        lowest = np.full(least.size, np.inf)
        np.minimum.at(lowest, slot, s.astype(float))
        return pa.table({"id": a.column("id"), "least": np.where(full, lowest, least.ravel()).reshape(least.shape).min(1)})

    two = materialize(by_group(seeking, at_home(seeking).applyInArrow(bound_negatives, "id long, least double")), "negative-anchors")
    wanted = materialize(_wanted(two, cells, width), "negative-bounds")
    found = _meet(candidates, two.select("group", "id", "label", "v", "place", "low", "high"), wanted, cells, search_negatives, "anchor_id long, place int, negative_id long, negative_score long")
    order = F.row_number().over(W.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    found = found.withColumn("rank", order).where(F.col("rank") <= negatives)
    found = found.join(best.select("anchor_id", "place", "positive_id", F.col("score").alias("positive_score")), ["anchor_id", "place"])
    found = materialize(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    for used in (placed, best, seeking, two, wanted):
        discard(used)
    let_go(spark)
    return found
