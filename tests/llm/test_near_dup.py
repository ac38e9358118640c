"""Near-duplicates against brute force; the signatures' estimates; components; odd rows."""

import random
from collections import Counter

import numpy as np
import pytest

from glimset.llm import near_dup as nd


def bag(pairs):
    pairs = sorted(pairs.items())
    return np.array([k for k, _ in pairs], np.uint64), np.array([v for _, v in pairs], np.int64)


@pytest.mark.parametrize("a,b", [({1: 1, 2: 1, 3: 1}, {2: 1, 3: 1, 4: 1}), ({1: 7, 2: 3}, {1: 5, 2: 6, 9: 1}), ({k: 1 + k % 4 for k in range(60)}, {k: 1 + k % 3 for k in range(20, 80)}), ({5: 1000}, {5: 600})])
def test_registers_agree_as_weighted_jaccard(a, b):
    want = nd.similarity(bag(a), bag(b))
    low = sum(min(v, b.get(k, 0)) for k, v in a.items())
    assert want == low / (sum(a.values()) + sum(b.values()) - low)
    agree = []
    for shift in range(0, 40_000, 1000):  # other elements, other draws
        x, y = (nd.signatures([bag({k + shift: v for k, v in s.items()})])[0] for s in (a, b))
        agree.append((x == y).mean())
    assert abs(np.mean(agree) - want) < 0.03


def test_signature_does_not_depend_on_company():
    bags = [bag({k: 1 + k % 5 for k in range(n)}) for n in (1, 3, 400)]
    together = nd.signatures([*bags, bag({})])
    assert np.isinf(together[3]).all()
    for k, b in enumerate(bags):
        assert (nd.signatures([b])[0] == together[k]).all()


def brute(rows, threshold=0.8):
    """Classes by comparing all pairs of texts."""
    group = {}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    def join(x, y):
        x, y = find(x), find(y)
        group[max(x, y)] = min(x, y)

    texts = {}
    for i, text in rows:
        group.setdefault(i, i)
        if text is not None:
            if text in texts:
                join(texts[text], i)
            texts.setdefault(text, i)
    bags = [(i, nd.shingles(t.encode())) for t, i in texts.items()]
    for k, (i, a) in enumerate(bags):
        for j, b in bags[:k]:
            if len(a[0]) and len(b[0]) and nd.similarity(a, b) >= threshold:
                join(i, j)
    return {i: find(i) for i, _ in rows}


def test_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_BYTES", 16 << 10)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, base = [], [word() for _ in range(150)]
    for _ in range(150):  # a family that spreads over the threshold
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            own[rng.randrange(150)] = word()
        rows.append(" ".join(own))
    for n in (3, 4, 5, 6, 40, 700):
        text = [word() for _ in range(n)]
        rows += [" ".join(text), " ".join(text), " ".join(text).upper() + "!", " ".join(text[: max(1, n * 9 // 10)])]
    rows += [" ".join([word()] * 30) for _ in range(10)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r.doc_id: r.class_id for r in nd.classes(documents(*rows)).collect()}
    assert got == brute(rows)
    assert max(Counter(got.values()).values()) > 40


def test_odd_rows(spark, documents):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "?"), (6, "a b"), (7, "A, b"), (8, "a b c"), (9, "x " * 50_000), (10, "x " * 50_000), (11, "q w"), (11, "a b"), (None, "a b"), (12, "a b")]
    got = sorted((r.doc_id or 0, r.class_id) for r in nd.classes(documents(*rows)).collect())
    assert got == [(0, 6), (1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 6), (7, 6), (8, 8), (9, 9), (10, 9), (11, 6), (11, 11), (12, 6)]
    kept = nd.classes(documents(*rows, (None, "no id has this"), (None, "no id has this"), (6, "a b"))).filter("keep").collect()
    # a row without an id is kept only where no copy has one; rows that repeat a kept one are marked as well
    assert sorted((r.doc_id or 0) for r in kept) == [0, 0, 1, 2, 3, 5, 6, 6, 8, 9, 11]
    assert nd.classes(documents((1, "a")).limit(0)).count() == 0


def test_several_texts_of_an_id(spark, documents, monkeypatch):
    """Each text is compared as itself, whichever rows share its id."""
    monkeypatch.setattr(nd, "BLOCK_BYTES", 2 << 10)
    rng = random.Random(9)
    words = [["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)] for _ in range(12)]
    near = [w[:-1] + ["other"] for w in words]
    rows = [(7, " ".join(w)) for w in words] + [(None if k % 2 else k, " ".join(w)) for k, w in enumerate(near)]
    found = nd.classes(documents(*rows)).collect()
    assert len(found) == 24 and sum(r.keep for r in found) == 12
    of = {r.copy: r.class_id for r in found}
    assert len(set(of)) == 24 and sorted(of.values()) == sorted(2 * [min(7, k) if k % 2 == 0 else 7 for k in range(12)])


@pytest.mark.parametrize("threshold,least", [(0.8, 0.99), (0.4, 0.9)])
def test_recall_of_near_copies(spark, threshold, least):
    """Of all pairs of different texts that brute force finds at a threshold, those that end in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.class_id for r in nd.classes(docs, threshold).collect()}
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.text, r.doc_id)
    bags = [(i, nd.shingles(t.encode())) for t, i in texts.items()]
    holders = {}
    for k, (_, b) in enumerate(bags):
        for h in b[0].tolist():
            holders.setdefault(h, []).append(k)
    pairs = {(x, y) for own in holders.values() if len(own) < 60 for n, y in enumerate(own) for x in own[:n]}
    true = [(bags[x][0], bags[y][0]) for x, y in pairs if nd.similarity(bags[x][1], bags[y][1]) >= threshold]
    assert len(true) >= 5 and sum(got[a] == got[b] for a, b in true) / len(true) >= least
    want = brute([(r.doc_id, r.text) for r in docs.collect()], threshold) if threshold == 0.8 else None
    assert want is None or got == want


def test_rows_of_a_band():
    assert [nd.rows_for(t) for t in (0.95, 0.8, 0.5, 0.4, 0.01)] == [10, 5, 2, 2, 1]  # (1 - 0.95**10)**16 is 5e-7, (1 - 0.95**16)**10 is 3e-3


def test_components(spark):
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(40)]
    got = {r.id: r["class"] for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        group[max(a, b)] = min(a, b)
    assert got == {k: find(k) for e in edges if e[0] != e[1] for k in e}
    assert nd.components(spark.createDataFrame([], "a long, b long")).count() == 0
