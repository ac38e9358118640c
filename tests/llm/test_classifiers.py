"""Language ID, quality, toxicity: brute force, held-out accuracy, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimset.llm import langid, quality, toxicity
from glimset.llm._common import held_out

MEDIUM = "/root/testdata/sf0.01"


def phrases(text, learnt):
    """The greedy cross parse of normalised text, by searching for each phrase."""
    n = 0
    for start in range(0, len(text), langid.BLOCK):
        phrase = ""
        for c in text[start : start + langid.BLOCK]:
            if phrase + c in learnt:
                phrase += c
            else:
                n += 1
                phrase = c if c in learnt else ""
        n += phrase != ""
    return n


def test_parse_is_brute_force():
    rng = np.random.default_rng(3)
    make = lambda n, of: "".join(rng.choice(list(of), n))
    learnt = {"a": make(300, "abc "), "b": make(300, "bcdé")}
    model = langid.Model({k: np.array([ord(c) for c in v], np.uint32) for k, v in learnt.items()})
    texts = [make(n, "abcdéx ") for n in (0, 1, 5, 90, 3000)]
    points = np.array([ord(c) for t in texts for c in t], np.uint32)
    got = model.phrases(model.coded(points), np.cumsum([len(t) for t in texts]))
    assert got.tolist() == [[phrases(t, learnt[k]) for k in "ab"] for t in texts]


def test_symbols():
    points, ends = langid.symbols_of(["", "..", "Ab1c", " é, ", "x"])
    assert "".join(map(chr, points)) == "ab cé x" and ends.tolist() == [0, 0, 4, 6, 7]


def accuracy(rows, truth):
    own = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(own) > 50
    return sum(truth[r.doc_id] == got for r, got in ((r, getattr(r, "lang_pred", None) or r.predicted) for r in own)) / len(own)


def test_language_held_out(spark):
    rows = langid.op10_langid(spark, MEDIUM).collect()
    truth = dict(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect())
    assert len(rows) == len(truth) and accuracy(rows, truth) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, documents):
    docs = documents((1, "aaa bbb aaa", "x", "s"), (2, "cdcdcd", "y", "s"), (3, None, "z", "s"), (4, "zz", None, "s"), (5, "", "x", "s"), (6, "123 !", "x", "s"), (7, "aa", "x", "s"), (7, "aa", "x", "s"), (None, "CDC", "y", "s"))
    model = langid.fit(docs)
    assert model.langs == ["x", "y"]
    got = sorted((r.row.doc_id or 0, r.lang_pred) for r in langid.identify(docs, model).collect())
    assert got == [(0, "y"), (1, "x"), (2, "y"), (3, "und"), (4, "y"), (5, "und"), (6, "und"), (7, "x"), (7, "x")]
    assert langid.identify(docs, model).select("row.*").columns == docs.columns
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs.select("doc_id", "text"), empty).collect()} == {"und"}
    assert langid.fit(docs, most_langs=1).langs == ["x"]  # the one with the most documents
    assert {r.lang_pred for r in langid.identify(documents((1, "x " * 300_000), (2, "y" * 700_000)), model).collect()} <= {"x", "y"}


def test_large_alphabets_stay_small():
    """3,000 symbols and 40,000 of text for each of three languages; dense rows would take 500 MB each."""
    rng = np.random.default_rng(8)
    texts = {k: rng.integers(0x4E00 + 700 * n, 0x4E00 + 700 * n + 3000, 40_000).astype(np.uint32) for n, k in enumerate("abc")}
    model = langid.Model(texts)
    assert model.table.nbytes < 20_000_000
    some = [texts[k][500:900] for k in "abc"]
    own = model.phrases(model.coded(np.concatenate(some)), np.cumsum([400] * 3))
    assert own.argmin(axis=1).tolist() == [0, 1, 2] and own.min(axis=1).tolist() == [1, 1, 1]


def test_all_sampled_documents_teach(documents):
    """Each document gives its share, from anywhere in it: one long text doesn't make a language."""
    rows = [(k, chr(97 + k % 20) * 3000 if k else "z" * 900_000, "x", "s") for k in range(40)]
    model = langid.fit(documents(*rows), docs_per_lang=40, symbols_per_lang=4000)
    assert len(model.alphabet) == 22  # 20 letters, z and the space
    tail = [(k, "a" * 5000 + "b" * 5000, "x", "s") for k in range(40)]
    assert "".join(map(chr, langid.fit(documents(*tail)).alphabet)) == " ab"


def test_forest_is_what_the_trees_say():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    forest = quality.grow(x, y, trees=20)
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.97

    def walk(row):  # one row, one node at a time
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += leaf[k - len(f)]
        return total

    assert forest.margin(x[:50]) == pytest.approx([walk(r) for r in x[:50]])


def test_quality_held_out(spark):
    rows = quality.op3_quality(spark, MEDIUM).collect()
    truth = dict(spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "quality").collect())
    assert len(rows) == 1000 and accuracy(rows, truth) > 0.9
    assert {r.predicted for r in rows} == {0, 1} and all((r.score >= 0.7) == bool(r.predicted) for r in rows)


def labels(spark, *rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_odd_rows(spark, documents):
    docs = documents((1, None), (2, ""), (3, "word " * 100_000), (4, "a"), (4, "a"), (None, "b"))
    given = labels(spark, (1, 1, 0), (2, None, 0), (3, 0, None), (3, 0, 0), (9, 1, 0), (None, 1, 1))
    found = quality.score(docs, quality.fit(docs, given), ["doc_id"]).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in quality.score(docs, quality.fit(docs, given.limit(0)), ["doc_id"]).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs, given), ["doc_id"]).count() == 0


def test_toxic_words_are_found(spark, documents):
    rng = np.random.default_rng(5)
    bad = ["vile", "foul", "vilest"]
    rows = []
    for k in range(900):
        words = ["".join(rng.choice(list("abcdefg"), 4)) for _ in range(30)]
        if k % 6 == 0:
            words[int(rng.integers(30))] = bad[k // 6 % 3]
        rows.append((k, " ".join(words)))
    given = labels(spark, *[(k, int(k % 12 > 0), int(k % 6 == 0)) for k in range(900)]).select("doc_id", (1 - F.col("quality")).alias("low"), "toxic")
    docs = documents(*rows)
    chain = toxicity.fit(docs.drop("lang"), given, ["low", "toxic"])
    found = toxicity.predict(docs, chain, ["doc_id"]).select("row.doc_id", "p_toxic").withColumn("held_out", held_out(F.col("doc_id"))).collect()
    own = [r for r in found if r.held_out]
    assert sum((r.p_toxic >= 0.5) == (r.doc_id % 6 == 0) for r in own) / len(own) > 0.97
    assert len(chain.models[1].earlier) == 1  # the second model sees the first one's probability


def test_chain_is_brute_force(spark):
    """The query's probabilities, worked out again text by text from the models' weights."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    given = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit(docs, given, ["low_quality", "toxic"])
    got = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in toxicity.op9_toxicity(spark, "/root/testdata/sf0.001").collect()}
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for r in docs.collect():
        known, earlier = toxicity.features_of(r.text.encode()), []
        for model in chain.models:
            z = model.bias + sum(w for f, w in zip(model.features.tolist(), model.weights, strict=True) if f in known)
            z += sum(v * np.log(p / (1 - p)) for v, p in zip(model.earlier, np.clip(earlier, 1e-4, 1 - 1e-4), strict=True))
            earlier.append(sigmoid(np.clip(z, -30, 30)))
        assert got[r.doc_id] == pytest.approx(earlier, abs=1e-9)


def test_toxicity_held_out(spark):
    """What the chain says of labelled documents that it didn't learn from, having learnt from 2,990: recall 0.83."""
    rows = [r for r in toxicity.op9_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    truth = dict(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic").collect())
    own = [(truth[r.doc_id], r.predicted) for r in rows if r.doc_id in truth]
    hits = sum(t and p for t, p in own)
    assert len(own) > 500 and hits / sum(t for t, _ in own) > 0.8 and hits / sum(p for _, p in own) > 0.9


def test_toxicity_odd_rows(spark, documents):
    docs = documents((1, None), (2, ""), (3, "word " * 100_000), (4, "a"), (4, "a"), (None, "b"))
    given = labels(spark, (1, 1, None), (2, None, 0), (3, 0, 1), (3, 0, 1), (4, None, None), (9, 1, 0), (None, 1, 1))
    for some in (given, given.limit(0)):
        found = toxicity.predict(docs, toxicity.fit(docs, some, ["quality", "toxic"]), ["doc_id"]).collect()
        assert len(found) == 6 and all(0 <= p <= 1 for r in found for p in (r.p_quality, r.p_toxic))
    assert toxicity.predict(docs.limit(0), toxicity.fit(docs, given, ["toxic"]), ["doc_id"]).count() == 0
