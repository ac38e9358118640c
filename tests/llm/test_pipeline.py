"""The pipeline against brute force of each stage."""

from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from glimset.llm import langid
from glimset.llm._common import held_out
from glimset.sources.shared import shared_dir
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_dup import brute as classes


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(-1, "12 34 !", "en", "src0", 7), (-2, None, "en", "src0", 0), (-3, "Кот сидит на окне", None, "src0", 17)], docs.schema)
    docs = docs.union(odd)
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert k == 4 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        kept.append((docs.collect(), spark.read.parquet(f"{tmp_path}/{k}")))
        docs = kept[-1][1]
    texts = lambda rows: [(r.doc_id, r.text) for r in rows]
    outs = [o.collect() for _, o in kept]
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet").union(odd).filter(~held_out(F.col("doc_id"))))
    said = {r.doc_id: model.predict([r.text])[0] for r in kept[0][0]}
    told = lambda p: p[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE and p[2] <= corpus_pipeline.MOST_BITS
    lost = [r.text for r in kept[0][0] if not told(said[r.doc_id])]
    assert {r.doc_id for r in kept[0][0]} - {r.doc_id for r in outs[0]} == {i for i, p in said.items() if not told(p)}
    assert "Кот сидит на окне" in lost and all(len(t or "") < 150 for t in lost)  # clean documents stay
    assert sorted(r.doc_id for r in outs[1]) == sorted(i for i, c in classes(texts(kept[1][0])).items() if i == c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in outs[2]) == sorted(i for i, (_, hit, _) in contaminated(texts(kept[2][0]), items).items() if not hit)
    copies = Counter(r.doc_id for r in outs[3])
    assert set(copies) <= {r.doc_id for r in outs[2]} and max(copies.values()) <= 3
    assert sorted(texts(outs[4]), key=str) == sorted(texts(outs[3]), key=str)
    assert len(outs[1]) < len(outs[0]) and len(outs[2]) < len(outs[1])
    assert langid.UNKNOWN == "und"


def test_run_agrees_with_itself(spark, sf_dir):
    one, two = (sorted(Counter(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()).items()) for _ in range(2))
    assert one == two and one


def test_languages_to_keep(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, sf_dir, ("en", "de")).collect()
    assert sum(r.lang in ("en", "de") for r in kept) / len(kept) > 0.99 and len(kept) > 80


def test_repeated_ids(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (1, "other text", "en", "s", 5), (None, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5), (3, "x y z", "en", "s", 5), (None, "q", "en", "s", 1), (None, "q", "en", "s", 1), (4, None, "en", "s", 0), (None, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept) == [(0, ""), (0, "q"), (1, "a b c"), (1, "other text"), (3, "x y z"), (4, "")]


CLASHES = ["gone", "again", "copy", "row", "class_id", "keep", "shard", "generation", "in", "goes_to", "__gone", "__again", "__hit", "__rows", "__level", "__doc_id", "spans", "size", "repeats", "score", "lang_pred", "shard_rows"]


def test_clashing_names_and_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs = docs.union(docs.limit(3)).select("*", *[F.lit(c).alias(c) for c in CLASHES])
    for start in (docs, docs.limit(0)):
        some = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            some = stage(spark, some, sf_dir)
            assert some.columns[: len(docs.columns)] == docs.columns and (k == 4) == (len(some.columns) > len(docs.columns))
        rows = some.collect()
        assert bool(rows) == (start is docs) and all(r[c] == c for r in rows for c in CLASHES)


def test_contaminated_without_id(spark, tmp_path):
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, "so One, two three!", "en", "s", 1), (None, "one two", "en", "s", 2), (1, "one two three", None, "s", 3), (1, "three", "en", None, 4), (2, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "three", "en", None, 4), (2, None, "en", "s", None), (None, "one two", "en", "s", 2)]


def test_items_without_id(spark, tmp_path):
    spark.createDataFrame([(None, "one two three"), (7, "four five")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "so One, two three!", "en", "s", 1), (2, "four five", "en", "s", 2), (3, "one two", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()] == [3]


def test_decontamination_stores_neither_index_nor_rows(spark, sf_dir, tmp_path):
    """Rows of an index that hold the texts of 256 documents, read and sent to Python by the 64 MB, took an executor over its memory."""
    own = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = own()
    kept = corpus_pipeline.decontamination(spark, docs, sf_dir)
    kept.write.parquet(f"{tmp_path}/kept")
    assert own() == before
    assert 0 < spark.read.parquet(f"{tmp_path}/kept").count() < docs.count()
