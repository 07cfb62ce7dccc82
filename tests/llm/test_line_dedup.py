"""Line dedup against a comparison of all pairs of lines."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from tests.llm.helpers import documents, odd_texts
from trellis.llm import line_dedup


def one_edit(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(texts, fuzzy_from=5):
    seen, out = [], []
    for text in texts:
        if text is None:
            out.append(None)
            continue
        kept = []
        some = False
        for line in text.split("\n"):
            if not line.strip(" "):
                kept.append(line)
                continue
            gone = any(line == s or (len(line) >= fuzzy_from and len(s) >= fuzzy_from and one_edit(line, s)) for s in seen)
            seen.append(line)
            if not gone:
                kept.append(line)
                some = True
        out.append("\n".join(kept) if some else "")
    return out


def test_as_comparing_all_lines(spark):
    r = random.Random(2)
    letters = "abcdefgh äö🙂"
    pool = ["".join(r.choice(letters) for _ in range(r.choice([3, 4, 5, 6, 31, 40, 80]))) for _ in range(40)]
    texts = odd_texts()
    for _ in range(60):
        lines = []
        for _ in range(r.randrange(1, 6)):
            line = list(r.choice(pool))
            kind = r.randrange(5)
            at = r.randrange(len(line))
            if kind == 1:
                del line[at]
            elif kind == 2:
                line.insert(at, "z")
            elif kind == 3:
                line[at] = "q"
            elif kind == 4:
                line[at], line[0] = "q", "r"
            lines.append("".join(line))
        texts.append("\n".join(lines))
    found = {row.doc_id: row.text for row in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts)


def test_edges(spark):
    df = documents(spark, odd_texts())
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    twice = line_dedup.dedup_lines(df.unionAll(df)).collect()
    assert len(twice) == 2 * len(odd_texts())
    # of two equal rows one keeps its lines
    once = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    for i, text in once.items():
        assert sorted(str(r.text) for r in twice if r.doc_id == i) == sorted(map(str, [text, text and ""]))


def test_null_and_repeated_keys(spark):
    run = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, tag string")).collect())
    assert run([(None, "x", "a"), (1, "x", "b"), (None, "x", "c")]) == [(False, 1, "x"), (True, 0, ""), (True, 0, "")]
    assert run([(1, "dup line", "a"), (2, "uniq", "b"), (2, "dup line", "c")]) == [(False, 1, "dup line"), (False, 2, ""), (False, 2, "uniq")]
    assert run([(3, "same", "a"), (3, "same", "b"), (3, "same", "b")]) == [(False, 3, ""), (False, 3, ""), (False, 3, "same")]


def test_lines_that_are_set_aside_first_have_no_neighbour(spark, monkeypatch):
    """The links with the half keys in front are those without."""
    r = random.Random(9)
    pool = ["".join(r.choice("abc") for _ in range(r.choice([5, 6, 9]))) for _ in range(60)]
    df = documents(spark, ["\n".join(r.choice(pool) for _ in range(4)) for _ in range(30)])
    with_halves = sorted(map(tuple, line_dedup.kept_lines(df).collect()))
    monkeypatch.setattr(line_dedup, "_halves", lambda line: F.array(F.lit(1).cast("long")))  # all share a key
    assert sorted(map(tuple, line_dedup.kept_lines(df).collect())) == with_halves


def test_a_text_of_very_many_lines(spark):
    r = random.Random(2)
    text = "\n".join(x for _ in range(30_000) for x in ("".join(r.choices("abcdefghij", k=20)), " "))
    began = time.perf_counter()
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, [text, text + "\nsomething else"])).collect()}
    assert found[0] == text
    assert found[1].strip() == "something else"
    assert time.perf_counter() - began < 60
