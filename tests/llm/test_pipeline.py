"""The pipeline's stages on the test tables: each on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.compare import DATA
from tests.llm.test_line_dedup import brute
from tests.llm.test_simhash import alike_groups
from trellis.llm.shared import materialize


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(materialize(stage(spark, kept[-1], DATA), f"test-{i}"))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert kept[-1].columns == columns
    before, clean, lines, once, mixed, tokens = [d.collect() for d in kept]
    assert {r.doc_id for r in clean} <= {r.doc_id for r in before} and len(clean) >= 0.8 * len(before)

    clean = sorted(clean, key=lambda r: r.doc_id)
    stripped = {r.doc_id: r.text for r in lines}
    assert [stripped[r.doc_id] for r in clean] == brute([r.text for r in clean])
    assert all(r.n_chars == len(r.text) for r in lines if r.text is not None)

    group, links = alike_groups({r.doc_id: r.text for r in lines})
    stays = {r.doc_id for r in once}
    assert set(group.values()) <= stays  # the first of each group
    missed = stays - set(group.values())
    assert len(missed) <= 0.1 * max(1, len(group) - len(set(group.values())))

    assert {r.doc_id for r in mixed} <= {r.doc_id for r in once}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in mixed}
    assert sorted(r.doc_id for r in tokens) == sorted(r.doc_id for r in mixed)
    for r in tokens[:50]:
        assert r.ids == t.encode(text[r.doc_id], add_special_tokens=False).ids


def test_run_is_the_stages_in_a_row(spark):
    found = corpus_pipeline.run(spark, DATA)
    assert found.count() > 0 and "ids_sha256" in found.columns
