"""SimHash links against brute force over all pairs."""

from __future__ import annotations

import random

import xxhash

from tests.llm.helpers import documents, odd_texts, words
from trellis.llm import simhash


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    parts = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, prints):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


def test_groups_are_those_of_all_pairs(spark):
    r = random.Random(4)
    texts = odd_texts()
    for i in range(25):
        base = words(200, i)
        texts.append(" ".join(base))
        for _ in range(r.randrange(4)):
            near = base[:]
            for _ in range(r.randrange(3)):
                near[r.randrange(200)] = f"x{r.randrange(99)}"
            texts.append(" ".join(near))
    found = {row.doc_id: row for row in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = {i: fingerprint(t) for i, t in enumerate(texts)}
    assert {i: row.fp % (1 << 64) for i, row in found.items()} == prints
    assert {i: row.component_id for i, row in found.items()} == groups(list(prints), prints)


def test_links_at_three_bits_and_not_at_four(spark):
    r = random.Random(0)
    prints = []
    for _ in range(150):
        p = r.getrandbits(64)
        prints.append(p)
        for n in (1, 2, 3, 4):
            prints.append(p ^ sum(1 << b for b in r.sample(range(64), n)))
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    links = simhash.ball_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    from trellis.llm.components import components

    got = {row.node: row.root for row in components(links, "a", "b").collect()}
    unsigned = {p: p % (1 << 64) for p in signed}
    want = groups(signed, unsigned)
    assert {p: got.get(p, p) for p in signed} == want


def test_those_set_aside_first_have_no_link(spark, monkeypatch):
    """The links with the block keys in front are those without."""
    r = random.Random(1)
    prints = {p ^ sum(1 << b for b in r.sample(range(64), n)) for p in (r.getrandbits(64) for _ in range(60)) for n in range(5)}
    points = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    filtered = {tuple(x) for x in simhash.ball_links(points).collect()}
    monkeypatch.setattr(simhash, "_may_link", lambda points: points)
    assert {tuple(x) for x in simhash.ball_links(points).collect()} == filtered


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    parts = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]
    return {" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def alike_groups(texts: dict) -> tuple[dict, list]:
    """Groups over all pairs alike at 0.8 or more, and those pairs."""
    sets, ids = {i: shingle_set(t) for i, t in texts.items()}, sorted(texts)
    root, links = {i: i for i in ids}, []
    of: dict = {}
    for i in ids:
        for s in sets[i] or {None}:
            of.setdefault(s, []).append(i)
    counts: dict = {}
    for members in of.values():
        for n, i in enumerate(members):
            for j in members[n + 1 :]:
                counts[i, j] = counts.get((i, j), 0) + 1

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), n in counts.items():
        if n >= 0.8 * (len(sets[i] or {0}) + len(sets[j] or {0}) - n):
            links.append((i, j))
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return {i: top(i) for i in ids}, links


def test_shingles_and_similarity(spark):
    assert len(simhash.shingles("a b c d e f")) == 2 == len(shingle_set("A b C d e f"))
    assert len(simhash.shingles("a b")) == 1 and len(simhash.shingles(" ")) == 0


def test_texts_alike_at_eight_of_ten_are_found(spark):
    """Pairs alike at 0.8, 0.85, 0.9 and 0.95: those below the bound never, those above mostly."""
    texts, pairs = [], {}
    for i in range(240):
        base = words(150 + i % 90, 7000 + i)
        want = (0.8, 0.85, 0.9, 0.95)[i % 4]
        near, at = base[:], 0
        while at < len(base):  # change words, five shingles each, until the next would go below
            changed = [*near[:at], f"x{i}", *near[at + 1 :]]
            a, b = shingle_set(" ".join(base)), shingle_set(" ".join(changed))
            if len(a & b) < want * len(a | b):
                break
            near, at = changed, at + 7
        pairs[len(texts), len(texts) + 1] = want
        texts += [" ".join(base), " ".join(near)]
    kept = {r.doc_id for r in simhash.one_of_alike(documents(spark, texts)).collect()}
    found = {w: sum(a in kept and b not in kept for (a, b), x in pairs.items() if x == w) / 60 for w in (0.8, 0.85, 0.9, 0.95)}
    print(found)
    assert all(a in kept for a, _ in pairs)
    assert found[0.95] == 1 and found[0.9] >= 0.95 and found[0.85] >= 0.9 and found[0.8] >= 0.75


def in_a_crowd(pages: int, pairs: int, want: float) -> tuple[list, list]:
    """Template pages, alike in 0.6 with each other, and among them pairs alike in ``want``."""
    r = random.Random(pages)
    template = words(150, 1)
    page = lambda i: template + [f"p{i}x{j}" for j in range(50)]
    texts, planted = [" ".join(page(i)) for i in range(pages)], []
    for i in range(pairs):
        base = page(pages + i)
        near = base[:]
        while True:
            changed = near[:]
            changed[r.randrange(150, 200)] = f"y{r.randrange(10**6)}"
            a, b = shingle_set(" ".join(base)), shingle_set(" ".join(changed))
            if len(a & b) < want * len(a | b):
                break
            near = changed
        planted.append((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(near)]
    order = list(range(len(texts)))
    r.shuffle(order)
    at = {old: new for new, old in enumerate(order)}
    return [texts[i] for i in order], [tuple(sorted((at[a], at[b]))) for a, b in planted]


def test_pairs_in_a_crowd_are_found(spark):
    """Among template pages a text meets thousands in a point; pairs alike beyond the template are still caught, and no page else."""
    texts, pairs = in_a_crowd(3000, 60, 0.85)
    kept = {r.doc_id for r in simhash.one_of_alike(documents(spark, texts)).select("doc_id").collect()}
    caught = sum(b not in kept for _, b in pairs)
    print(caught)
    assert caught >= 57
    assert set(range(len(texts))) - kept <= {b for _, b in pairs}


def test_corners_are_the_least_of_their_ranges():
    h = simhash.shingles(" ".join(words(400, 3)))
    of: dict = {}
    for x in h.tolist():
        of.setdefault(x >> 59, []).append(x)
    assert simhash.corners_of(h).tolist() == [min(of[i]) for i in sorted(of)]
    assert simhash.corners_of(h[:1]).tolist() == h[:1].tolist() and simhash.corners_of(h[:0]).tolist() == []


def test_one_of_alike(spark):
    texts = ["a b c d", "a b c d", None, "", "other words entirely here now", "A B c d", " ".join(words(300, 1)), " ".join([*words(300, 1)[:299], "end"]), " ".join(words(300, 2))]
    df = documents(spark, texts)
    assert sorted(r.doc_id for r in simhash.one_of_alike(df).collect()) == [0, 2, 4, 6, 8]
    assert simhash.one_of_alike(df.unionAll(df)).count() == 5
    assert simhash.one_of_alike(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "other"), (4, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.text) for r in simhash.one_of_alike(nulls).collect()) == [(False, "a b c"), (True, "other")]
