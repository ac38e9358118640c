"""Decontamination against SQL and brute force, proximity, and odd rows."""

import random
import re
import time

from glimset.llm import decontaminate as d
from tests.conftest import same_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    out = {}
    for i, text in docs:
        own, hit, found = words(text), set(), set()
        for item, test in items:
            w = words(test)
            for k in range(max(1, len(w) - n + 1) if w else 0):
                window = w[k : k + n]
                for at in range(len(own) - len(window) + 1):
                    if own[at : at + len(window)] == window:
                        hit |= set(range(at, at + len(window)))
                        found.add(str(item))
        out[i] = (len(own), len(hit), sorted(found))
    return out


def test_matches_sql(spark, duck, sf_dir):
    same_rows(d.op4_decontaminate(spark, sf_dir), duck.sql(d.ORACLE))


def run(spark, docs, items, **options):
    df = d.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), **options)
    return {r.doc_id: r for r in df.collect()}


def test_brute_force_in_chunks_and_blocks(spark, documents, tmp_path):
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choice("aBcdé") for _ in range(n))
    items = [(k, some(rng.choice([2, 5, 12]))) for k in range(12)]
    docs = [(k, f"{some(30)}, {items[k % 12][1]}! {some(20)}") for k in range(40)]
    index = d.build_index(documents(*docs), str(tmp_path / "i"), block_docs=7, block_bytes=900)
    assert index.count() > 6
    asked = spark.createDataFrame(items, "item_id long, text string")
    for chunk in (1 << 20, 64):
        got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in d.search(index, asked, words=4, chunk_bytes=chunk).collect()}
        assert got == brute(docs, items, 4)


def test_proximity(spark, documents):
    docs = [(1, "one two three"), (2, "x one very two three"), (3, "three two one"), (4, "one a b c two three"), (5, "two three")]
    got = run(spark, documents(*docs), [(9, "one two three")], slack=1)
    assert {k: (r["items"], r.near_items) for k, r in got.items()} == {1: (["9"], []), 2: ([], ["9"]), 3: ([], []), 4: ([], []), 5: ([], [])}
    assert [tuple(s) for s in got[2].near] == [(1, 4)] or [tuple(s) for s in got[2].near] == [(2, 5)]


def test_odd_rows(spark, documents):
    long = "z " * 300_000 + "needle in hay"
    docs = [(1, None), (2, ""), (3, "?!"), (4, "The Needle, in HAY"), (4, "none"), (5, long), (None, "needle in hay")]
    items = [(1, "needle in hay"), (1, "needle in hay"), (2, None), (3, ""), (None, "none")]
    found = d.contamination(documents(*docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, len(r.spans)) for r in found) == [(0, 3, 1), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0), (4, 4, 1), (5, 300_003, 1)]
    assert run(spark, documents((1, "a")).limit(0), items) == {}
    none = d.contamination(documents((1, "a")), spark.createDataFrame([], "item_id long, text string")).collect()
    assert [(r.doc_id, r.spans) for r in none] == [(1, [])]


def brute_near(docs, items, n=10, slack=1):
    out = {}
    for i, text in docs:
        own, near, found = words(text), set(), set()
        for item, test in items:
            w = words(test)
            for k in range(max(1, len(w) - n + 1) if w else 0):
                window = w[k : k + n]
                for at in range(len(own)):
                    fits = own[at] == window[0] and all(t in own[max(0, at + o - slack) : at + o + slack + 1] for o, t in enumerate(window) if o)
                    if fits and own[at : at + len(window)] != window:
                        near |= set(range(at, min(len(own), at + len(window))))
                        found.add(str(item))
        out[i] = (len(near), sorted(found))
    return out


def test_near_query(spark, tmp_path):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice("abcdefghijklmn") + str(k) for _ in range(14))) for k in range(6)]
    docs = []
    for k in range(30):
        w = words(items[k % 6][1])
        for _ in range(k // 6):
            w.insert(rng.randrange(1, len(w)), "more")
        docs.append((k, " ".join(["x", *w, "y"] if k % 2 else w)))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = d.QUERIES["op4_decontaminate_near"](spark, str(tmp_path)).collect()
    want, exact = brute_near(docs, items), brute(docs, items)
    assert {r.doc_id: (r.n_near, r.near_items) for r in got} == {i: (n, ",".join(x)) for i, (n, x) in want.items()}
    assert {r.doc_id: r.n_hit for r in got} == {i: x[1] for i, x in exact.items()}
    assert sum(r.n_near > 0 and not r.contaminated for r in got) > 3


def test_clean_against_brute_force_in_chunks_and_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_DOCS", 7)
    rng = random.Random(7)
    some = lambda n: " ".join(rng.choice("aBcdé") for _ in range(n))
    items = [(rng.choice([k, None]), some(rng.choice([4, 6, 12]))) for k in range(12)] + [(50, None), (51, "?!")]
    docs = [(k, f"{some(30)}, {items[k % 12][1]}! {some(20)}" if k % 3 else some(40)) for k in range(40)] + [(90, None), (91, ""), (None, items[0][1]), (92, "z " * 600_000 + items[1][1])]
    table, asked = documents(*docs), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i or 0, t or "") for (i, t), x in zip(docs, brute(list(enumerate(t for _, t in docs)), items, 4).values(), strict=True) if not x[1])
    for chunk in (1 << 20, 64):
        got = d.clean(table, asked, words=4, chunk_bytes=chunk)
        assert got.columns == table.columns
        rows = got.collect()
        assert sorted((r.doc_id or 0, r.text or "") for r in rows) == want and 3 < len(want) < len(docs) - 3
        assert {tuple(r)[4:] for r in rows} == {tuple(r)[4:] for r in table.collect()}


def test_index_serves_other_items(spark, documents, tmp_path):
    """The index holds all tokens: a second benchmark is found in it as well."""
    docs = [(1, "one two three four"), (2, "five six seven")]
    path = str(tmp_path / "index")
    d.contamination(documents(*docs), spark.createDataFrame([(1, "two three")], "item_id long, text string"), index_path=path).collect()
    index = spark.read.parquet(path)
    found = d.search(index, spark.createDataFrame([(9, "six seven")], "item_id long, text string")).collect()
    assert {r.doc_id: r["items"] for r in found} == {1: [], 2: ["9"]}


def test_larger_benchmarks_cost_little():
    """Indexing and searching a block with a benchmark 100 times as large takes less than 10 times as long."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(4)) for _ in range(20_000)]
    texts = [" ".join(rng.choices(vocabulary, k=600)).encode() for _ in range(256)]
    took = []
    for n in (20, 2000):
        known = d.Windows([(str(k), " ".join(rng.choices(vocabulary, k=150)).encode()) for k in range(n)], 10)
        best = 9e9
        for _ in range(5):
            began = time.perf_counter()
            batch = d.index_block(list(range(256)), texts)
            block = d.Block.unpacked([batch.column(c)[0] for c in (3, 4, 5, 6)], known.vocabulary)
            d.found_in("b", batch.column(1)[0].values, batch.column(2)[0].values, block, known, 0)
            best = min(best, time.perf_counter() - began)
        took.append(best)
    assert took[1] < 10 * took[0], took
