"""Columns called as one that an operator makes change nothing, in any operator and stage."""

from __future__ import annotations

import re
from pathlib import Path

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import DATA
from tests.llm.helpers import documents, odd_texts, words
from trellis.llm import bpe, hnsw, line_dedup, mixing, negatives, passages, pii, secrets, simhash, spans, topk, toxicity, url_filter, whitening

LLM = Path(line_dedup.__file__).parent
OWN = {"doc_id", "text", "source", "lang", "vec_id", "embedding", "label", "page_id", "url"}


def names(*modules) -> list[str]:
    """Every name that the modules' code has in quotes."""
    found = set()
    for m in modules:
        found |= set(re.findall(r"""["']([a-z_][a-z_0-9]*)["']""", Path(m.__file__).read_text()))
    return sorted(found - OWN)


def wider(df, *modules):
    """``df`` with a column of each of these names, and some of plain numbering."""
    extra = sorted({*names(*modules), "c0", "c1", "c2"})
    return df.select("*", *[F.lit(f"extra {n}").alias(n) for n in extra]), extra


def rows(df):
    return sorted(map(str, df.collect()))


def docs(spark):
    texts = [*odd_texts(), *(" ".join(words(60, i)) + f"\nline {i % 4}" for i in range(20)), *(" ".join(words(60, i)) for i in range(3))]
    return documents(spark, texts).drop("n_chars")


def test_those_that_return_the_columns_they_get(spark):
    df = docs(spark)
    model = toxicity.fit(df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    for run, module in (
        (line_dedup.dedup_lines, line_dedup), (simhash.one_of_alike, simhash), (mixing.mixed_documents, mixing), (lambda d: toxicity.score(d, model), toxicity),
    ):
        wide, extra = wider(df, module)
        extra = [n for n in extra if n != "score"]
        got = run(wide)
        assert rows(got.drop(*extra)) == rows(run(df)), module.__name__
        for n in extra:
            assert got.where(F.col(n) != f"extra {n}").isEmpty(), (module.__name__, n)


def test_those_that_return_their_own(spark):
    df = docs(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    for run, module in (
        (passages.shared_passages, passages), (mixing.mix, mixing), (simhash.near_duplicates, simhash), (lambda d: bpe.encode(d, path), bpe),
        (lambda d: secrets.scan(d, F.col("source"), F.col("lang")), secrets), (pii.scan, pii), (lambda d: pii.sanitise(d).select("doc_id", "text", "source", "lang"), spans), (lambda d: toxicity.score(d, toxicity.fit(d, d.select("doc_id", F.lit(1).alias("toxic")))).select("doc_id", "score"), toxicity),
    ):
        wide, _ = wider(df, module)
        assert rows(run(wide)) == rows(run(df)), module.__name__


def test_kept_columns_of_encoding(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = docs(spark).withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "text_")
    got = bpe.encode(df, path, keep=("doc_id", "n_tokens", "text_"))
    assert got.columns == ["doc_id", "text_", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    back = bpe.decode(got.withColumn("text", F.lit("old")), path, keep=("doc_id", "text_", "text"))
    assert back.columns == ["doc_id", "text_", "text"] and back.where("text = 'old'").isEmpty()


def test_vectors_and_urls(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)]) for i in range(30)], "vec_id long, embedding array<double>")
    for run, module in ((topk.top_k, topk), (hnsw.nearest, hnsw)):
        wide, _ = wider(vectors, module)
        assert rows(run(wide, F.col("vec_id") % 10 == 0, 3)) == rows(run(vectors, F.col("vec_id") % 10 == 0, 3))
    named = vectors.withColumn("label", (F.col("vec_id") % 3).cast("int"))
    for run, module in ((lambda d: negatives.hard_negatives(d, F.col("vec_id") % 10 == 0, 3, 2), negatives), (lambda d: whitening.whiten(d, 2).select("vec_id", "component", "n", "deviation"), whitening)):
        wide, _ = wider(named.withColumnRenamed("label", "other"), module) if module is whitening else wider(named, module)
        assert rows(run(wide)) == rows(run(named)), module.__name__
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    listed = spark.createDataFrame([("a.net/x",)], "key string")
    wide, extra = wider(pages, url_filter)
    got = url_filter.judge_urls(wide, [], listed)
    assert rows(got.select("page_id", "host", "path", "rule", "verdict", "listed")) == rows(url_filter.judge_urls(pages, [], listed).drop("url"))


def test_stages(spark):
    """Each stage on odd rows: nulls, empty and long texts, repeats, no rows at all, and extra columns."""
    df = docs(spark).withColumn("n_chars", F.length("text").cast("long"))
    odd = df.unionAll(df.limit(6)).unionAll(spark.createDataFrame([(None, "null key", None, None, 8), (None, None, "en", "a", None)], df.schema))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), DATA).count() == 0, name
        got = stage(spark, odd, DATA)
        assert got.count() <= 3 * odd.count(), name
        wide, extra = wider(odd, line_dedup, simhash, mixing, toxicity)
        wide = stage(spark, wide.drop("toxicity_"), DATA)
        keep = [c for c in wide.columns if c not in extra]
        # of two rows alike in key and text, which has which other columns is open
        assert rows(wide.select("doc_id", *[c for c in keep if c != "doc_id"])) == rows(got.select("doc_id", *[c for c in keep if c != "doc_id"])), name
