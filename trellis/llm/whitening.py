"""Whitening of integer vectors: components by a randomised range finder, refined by passes over all centred rows.

A pass multiplies the centred rows' covariance by a few directions: each task sums, over its rows, the row times its
projections, and only those sums, as wide as a vector and as deep as there are directions, are shuffled and meet on the
driver. It starts with random directions, some more than components are asked for, and repeats with what a pass gave, made
orthonormal. Rayleigh-Ritz on the span gives eigenvalues and vectors, and the residual of each tells whether it holds to
double precision. Where the spectrum is too flat for that the range grows to the whole space, in one more pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.deploy import ship
from trellis.llm.shared import in_pieces
from trellis.llm.vectors import rows_within, usable

SCALE, SHIFT = 1024.0, 100_000
OVERSAMPLE, PASSES, SEED = 8, 12, 12
#: A component holds when the residual of its eigenpair, over the largest eigenvalue, is below this.
RESIDUAL = 1e-13
#: Eigenvalues below this share of the largest are no spread but rounding.
NO_SPREAD = 1e-12
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    n: int
    #: exact sums of x, one for each dimension
    sums: tuple[int, ...]
    #: sum of V's diagonal
    trace: float
    #: eigenvalues, largest first, and their unit vectors as columns
    values: np.ndarray
    vectors: np.ndarray
    #: whether the range had to grow to the whole space
    grown: bool

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def scaled(column: pa.Array, width: int) -> np.ndarray:
    """x, as doubles that hold integers: a row for each list; short ones end in the x of 0."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(float)[offsets[0] : offsets[-1]]
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return np.floor(SCALE * out) + SHIFT


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in in_pieces(batches, rows_within(4096, width)):
        yield batch, scaled(batch.column("v"), width)


def _sums(rows: DataFrame, width: int, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of of(x), where x are some of them: an array of that shape, summed within tasks first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in _pieces(batches, width):
            total += of(x)
        for i in range(shape[0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(shape[1], i), pa.int32()), pa.array(np.arange(shape[1]), pa.int32()), pa.array(total[i])], names=["i", "j", "s"])

    found = rows.select("v").mapInArrow(part, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros(shape)
    out[found["i"], found["j"]] = found["s"]
    return out


def _exact_sums(rows: DataFrame, width: int) -> list[int]:
    """S, as Python integers: tasks send decimal texts of what they summed, a row a dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for _, x in _pieces(batches, width):
            small = np.abs(x).max(initial=0) < 2**40
            each = x.astype(np.int64).sum(0).tolist() if small else [sum(map(int, c)) for c in x.T]
            total = [a + b for a, b in zip(total, each, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(map(str, total), pa.string())], names=["i", "s"])

    sent = rows.select("v").mapInArrow(part, "i int, s string")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + int(s)
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(map(str, total.values()), pa.string())], names=["i", "s"])

    out = [0] * width
    for r in sent.repartition("i").mapInArrow(add, sent.schema).collect():
        out[r["i"]] += int(r["s"])
    return out


def _rayleigh_ritz(q: np.ndarray, vq: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues on the span of q, their vectors, and the largest residual over the largest value."""
    t = q.T @ vq
    values, turn = np.linalg.eigh((t + t.T) / 2)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    rest = np.linalg.norm(vq @ turn - (q @ turn) * values, axis=0)
    return values, q @ turn, float(rest.max(initial=0) / values[0]) if len(values) and values[0] > 0 else 0.0


def fit(rows: DataFrame, k: int, vector: str = "embedding", passes: int = PASSES) -> Whitening | None:
    """What to whiten with, from every usable vector; None where there is none.

    Beyond passes, or where the residuals of two passes tell that the next ones won't do, the range grows to the whole
    space. Only sums of the width of a vector, times itself at most, reach the driver."""
    ship(rows.sparkSession)
    rows = rows.where(usable(vector)).select(F.col(vector).cast("array<double>").alias("v"))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return None
    width = width or 0
    sums = _exact_sums(rows, width)
    mean = np.array([s / n for s in sums])
    trace = float(_sums(rows, width, (1, width), lambda x: ((x - mean) ** 2).sum(0, keepdims=True)).sum()) / n if width else 0.0
    wide, k = min(width, k + OVERSAMPLE), min(width, k)
    if not trace > 0:
        return Whitening(n, tuple(sums), 0.0, np.zeros(0), np.zeros((width, 0)), False)
    covary = lambda q: _sums(rows, width, q.shape, lambda x: (x - mean).T @ ((x - mean) @ q)) / n
    q, rest, grown = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, wide)))[0], [], wide == width
    for at in range(0 if grown else passes):
        vq = covary(q)
        values, vectors, residual = _rayleigh_ritz(q, vq, k)
        rest.append(residual)
        if residual < RESIDUAL:
            break
        # as much as the last pass gained each of the next ones will
        falls = rest[-1] / rest[-2] if at else 0.0
        grown = at + 1 == passes or at > 1 and (falls >= 1 or residual * falls ** (passes - at - 1) > RESIDUAL)
        if grown:
            break
        q = np.linalg.qr(vq)[0]
    if grown:
        q = np.eye(width)
        values, vectors, _ = _rayleigh_ritz(q, covary(q), k)
    fine = values > NO_SPREAD * values[0]
    vectors = vectors[:, fine]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
    return Whitening(n, tuple(sums), trace, values[fine], vectors, grown)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Sum over dimensions of (n * x - S)^2, exact; beyond a long it stops at its end."""
    off = n * np.abs(x).max(initial=0) + max(map(abs, sums), default=0)
    if off < 2**62:
        d = n * x.astype(np.int64) - np.array(sums, np.int64)
        if float(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) < 2**62:
            return (d * d).sum(1)
    return np.array([min(LONG, sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True))) for r in x], np.int64)


def identity_error(rows: DataFrame, by: Whitening, vector: str = "embedding") -> float:
    """The largest entry, either sign, of the covariance of the whitened rows less the identity; over all rows again."""
    ship(rows.sparkSession)
    rows = rows.where(usable(vector)).select(F.col(vector).cast("array<double>").alias("v"))
    mean, turn = by.mean, by.vectors / np.sqrt(by.values)
    width, k = turn.shape
    outer = _sums(rows, width, (k, k), lambda x: (w := (x - mean) @ turn).T @ w) / by.n
    return float(np.abs(outer - np.eye(k)).max(initial=0))


def whiten(rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key as long, component int (from 1), n, deviation long, whitened, explained, identity_error double: a row for each
    usable vector and each of the k components of most spread, all of them where a vector has fewer dimensions.

    Vectors that are null or hold null or non-finite components take no part. Vectors shorter than the longest are
    taken to end in zeros. Rows that repeat, and rows with a null id, each count and are each given. A component in which
    the rows don't differ (its eigenvalue is below 1e-12 of the largest) can't be whitened and isn't given; so tables
    with no rows, one row or equal rows give none. Deviations beyond a long stop at its end. Only the id and
    the vector are read."""
    out = "long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    by = fit(rows, k, "v")
    if by is None or not len(by.values):
        return rows.sparkSession.createDataFrame([], f"{key} {out}")
    error, mean, turn, share = identity_error(rows, by, "v"), by.mean, by.vectors / np.sqrt(by.values), by.values / by.trace
    n, sums, (width, k) = by.n, by.sums, turn.shape

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _pieces(batches, width):
            b = len(x)
            made = [
                pa.array(np.tile(np.arange(1, k + 1), b), pa.int32()), pa.array(np.full(b * k, n), pa.int64()), pa.array(np.repeat(_deviations(x, n, sums), k), pa.int64()),
                pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(share, b)), pa.array(np.full(b * k, error)),
            ]
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(b), k)))
            yield pa.RecordBatch.from_arrays([ids, *made], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    used = rows.where(usable("v")).select("id", F.col("v").cast("array<double>").alias("v"))
    return used.mapInArrow(project, f"id {out}").withColumnRenamed("id", key)
