"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate, and the L1 term keeps most weights at exactly zero, so
the model that is sent out is a short list of (feature, weight). Features of a text are its words,
the first letters of longer words (word forms share them), pairs of neighbours, and pairs with one
word between; each counts once a text. They are hashed to 2**BITS numbers.

It is fitted on at most MAX_SAMPLE labelled rows, the first by a hash of the key; everything else
runs over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.deploy import ship
from trellis.llm.shared import in_pieces

BITS = 20
#: The bound of the fitting sample, in rows.
MAX_SAMPLE = 16_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 4.0, 0.1, 5
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
#: Words and characters that the cache of a worker holds; beyond either it starts anew.
CACHE_WORDS, CACHE_CHARS = 80_000, 2_000_000
#: What is stripped from a word's ends.
MARKS = ".,;:!?\"'()[]{}<>|*#%&+-_=/\\…“”«»¡¿"


class Words(dict):
    """word as written -> its number in the table of hashes (word, then one for each prefix)."""

    def __init__(self):
        super().__init__()
        self.table, self.chars = np.zeros((1024, 1 + len(PREFIXES)), np.uint64), 0

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        plain = word.lower().strip(MARKS)
        for i, text in enumerate([plain, *(plain[:n] if len(plain) > n else "" for n in PREFIXES)]):
            self.table[k, i] = xxhash.xxh64_intdigest(text.encode(), i) if text else 0
        self[word] = k
        self.chars += len(word)
        return k


_words = Words()


def features(text: str | None) -> np.ndarray:
    """The numbers of a text's features, perhaps with repeats; none for an empty text."""
    global _words
    parts = (text or "").split()
    if not parts:
        return np.zeros(0, np.int32)
    if len(_words) > CACHE_WORDS or _words.chars > CACHE_CHARS:
        _words = Words()
    numbers = list(map(_words.__getitem__, parts))  # first, as it may replace the table
    table = _words.table[numbers]
    h, mixed = table[:, 0], np.uint64(0x9E3779B97F4A7C15)
    pairs = (h[:-1] * mixed) ^ (h[1:] >> np.uint64(1))
    skips = (h[:-2] * mixed) ^ (h[2:] >> np.uint64(3))
    every = np.concatenate([h, table[:, 1:][table[:, 1:] > 0], pairs, skips]) * mixed
    return (every >> np.uint64(64 - BITS)).astype(np.int32)


class Model:
    """The weights that aren't zero, and the bias; no bias: fitted on nothing, every score is 0."""

    def __init__(self, index: np.ndarray, weight: np.ndarray, bias: float | None):
        self.index, self.weight, self.bias, self.dense = index, weight, bias, None

    def score(self, text: str | None) -> float:
        if self.bias is None:
            return 0.0
        if self.dense is None:
            self.dense = np.zeros(1 << BITS)
            self.dense[self.index] = self.weight
        found = features(text)
        hit = np.unique(found[self.dense[found] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.dense[hit].sum(), -35, 35))))

    def __getstate__(self):
        return self.index, self.weight, self.bias

    def __setstate__(self, state):
        self.__init__(*state)


def ftrl(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights of all features and the bias, from (distinct features, label)."""
    bias = 1 << BITS  # the last coordinate, on in every row
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)
    for _ in range(EPOCHS):
        for found, label in rows:
            at = np.append(found, bias)
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > L1, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2), 0.0)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            step = (np.sqrt(ni + g * g) - root) / ALPHA
            z[at] = zi + g - step * w
            n[at] = ni + g * g
    w = np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return w[:-1], float(w[-1])


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", most: int = MAX_SAMPLE, seed: int = 5) -> Model:
    """Fit on the rows of ``documents`` that ``labels`` marks, at most ``most`` of the labels: the first by
    a hash of the key. A key with several labels has the largest; null keys and labels are left out."""
    ship(documents.sparkSession)
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null")
    marked = marked.groupBy("k").agg(F.max("y").alias("y")).withColumn("at", F.xxhash64(F.lit(seed), "k"))
    marked = F.broadcast(marked.orderBy("at", "k").limit(most))  # of ``most`` rows of three numbers
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).join(marked, "k").select("at", "k", "y", "t")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            found = [np.unique(features(t.as_py())) for t in batch.column(3)]
            lists = pa.array(found, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["at", "k", "y", "f"])

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        # by position within equal keys too: repeated rows come in one order
        every = pd.concat(frames)
        every["size"] = every["f"].map(len)
        every = every.sort_values(["at", "k", "size"], kind="stable")
        w, bias = ftrl([(np.asarray(f), int(y)) for f, y in zip(every["f"], every["y"], strict=True)])
        at = np.flatnonzero(w)
        yield pd.DataFrame({"i": [-1, *at.tolist()], "w": [bias, *w[at].tolist()]})

    sample = rows.mapInArrow(extract, "at long, k long, y int, f array<int>")
    found = sample.repartition(1).mapInPandas(train, "i int, w double").toPandas()
    if not len(found):
        return Model(np.zeros(0, np.int64), np.zeros(0), None)
    rest = found[found["i"] >= 0].sort_values("i")
    return Model(rest["i"].to_numpy(), rest["w"].to_numpy(), float(found.loc[found["i"] < 0, "w"].iloc[0]))


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the column ``name``: 0 to 1, higher where the label is likelier to be 1.

    A null or empty text has the score of the bias alone. Repeated rows score alike; an empty table
    gives an empty table. A column of that name that ``df`` already has is replaced."""
    spark = df.sparkSession
    ship(spark)
    names = [c for c in df.columns if c != name]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # so no column is called as the text is here
    kept = [f"c{i}" for i, c in enumerate(df.columns) if c != name]
    sent = spark.sparkContext.broadcast(model)  # at most 2**BITS weights, 12 MB
    schema = plain.select(*kept).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            found = [sent.value.score(t.as_py()) for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, pa.float64())], names=schema.names)

    scored = plain.select(*kept, F.col(f"c{df.columns.index(text)}").alias("text")).mapInArrow(run, schema)
    return scored.toDF(*names, name)


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the key as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))
