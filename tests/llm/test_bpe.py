"""BPE against the tokenizers library, and round trips."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import documents, odd_texts, words
from trellis.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [*odd_texts(), "  two  spaces \n\n and\ttabs ", "<|endoftext|> in a text<|endoftext|>", "don't we'll I'M", "1234567 3.14", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "​ zero width", "Straße größer ñandú", " ".join(words(50, 3)).upper()]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_as_the_library_does(spark, reference):
    found = bpe.encode(documents(spark, TEXTS), PATH).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        ids = reference.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n'st.")), max_size=60))
def test_any_text(reference, text):
    ids, said = bpe.encoder(PATH).encode(text)
    assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids
    assert said == ",".join(map(str, ids))
    assert bpe.encoder(PATH).vocabulary.decode(ids).decode() == text


def test_round_trip_and_edges(spark):
    df = documents(spark, TEXTS)
    back = bpe.decode(bpe.encode(df, PATH), PATH)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encode(df.limit(0), PATH).count() == 0
    assert bpe.encode(df.withColumnRenamed("lang", "ids_sha256").unionAll(df), PATH).count() == 2 * len(TEXTS)
