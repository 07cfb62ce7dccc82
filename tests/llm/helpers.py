"""Small tables with what real ones hold: nulls, empty and long texts, ties, repeated rows and clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, texts: list, sources: list | None = None) -> DataFrame:
    rows = [(i, t, "en", sources[i] if sources else f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(n: int, seed: int, of: int = 5000) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(of)}" for _ in range(n)]


def odd_texts() -> list:
    """Texts that tend to break things."""
    return [None, "", " \n\t ", "one", "one two", "a\n\nb\n", "éü ß – 漢字 🙂", "\x00\x1f", "x" * 5000, " ".join(words(3000, 1)), "same text here", "same text here", "Same TEXT here"]


def rows(df: DataFrame) -> list[tuple]:
    return [tuple(r) for r in df.collect()]
