"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), and its docs are what the stage before it kept, written as
Parquet and read again. All but the last return documents as they were, with their columns.

1. language ID: documents whose language the model cannot tell go: those without text or letters, those of
   which two languages explain as much (a score under ``LEAST_SCORE``), those that none explains (more than
   ``MOST_BITS`` bits a symbol, as in a script that was never learnt; texts take about 2.5), and those of a
   language that isn't in ``LANGUAGES``, if that is set. The model learns from the
   documents that no model is barred from learning from.
2. MinHash near-dedup: of each class of near-duplicates one row stays: the one with the smallest id, one
   without an id only where none has one. Null texts stay.
3. benchmark decontamination: documents that hold a window of ten words of a benchmark item, or a
   whole shorter item, go.
4. mixing sources to target weights: each document comes as often as the mix takes it.
5. sharding: the corpus is written as shards; rows come with their shard, and its level, rows and bytes.

Defined cases: rows without an id, rows that share an id and repeated rows are documents of their own in all
stages (near-dedup leaves one of those whose texts agree); very long texts are taken whole; an empty table gives
an empty result with the same columns; columns of any name are carried, as inner columns get free names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimset.llm import decontaminate, langid, mixing, near_dup, sharding
from glimset.llm._common import held_out, joined_few
from glimset.sources.shared import removed, shared_path, write_table, written

#: Two stages learn or draw in ways that SQL can't express.
ORACLE_SQL = None
#: Languages to keep; None: all that are learnt.
LANGUAGES: tuple[str, ...] | None = None
#: A score of 0.5 says that two languages explain a text equally well.
LEAST_SCORE = 0.501
#: Bits a symbol at which phrases are shorter than about two symbols.
MOST_BITS = 7.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = LANGUAGES) -> DataFrame:
    model = langid.fit(docs.filter(~held_out(F.col("doc_id"))))
    found = langid.identify(docs, model).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & (F.col("bits") <= MOST_BITS))
    return (found if languages is None else found.filter(F.col("lang_pred").isin(*languages))).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dup.classes(docs)
    gone = written(found.filter("NOT keep").select("doc_id", "copy").distinct(), "dedup-gone")
    again = written(found.filter("keep AND copy IS NOT NULL").groupBy("doc_id", "copy").count().filter("count > 1").select("doc_id", "copy"), "dedup-repeated")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), near_dup.copy_of(F.col("text")).alias("copy"))
    rows = joined_few(rows, gone, ["doc_id", "copy"], "gone").filter("NOT gone").drop("gone")
    if again.isEmpty():
        return rows.select("row.*")
    rows = write_table(joined_few(rows, again, ["doc_id", "copy"], "again"), shared_path(spark, "dedup-marked"))
    once = rows.filter("again").dropDuplicates(["doc_id", "copy"])
    return rows.filter("NOT again").union(once).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, carry=docs.columns)
    return mixed.filter("repeats > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("copy")).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = sharding.sharded(docs)
    place = found.columns[-1]
    named = [F.col(f"{place}.{c}").alias(sharding.free_name(n, docs.columns)) for c, n in (("shard", "shard"), ("level", "shard_level"), ("rows", "shard_rows"), ("bytes", "shard_bytes"))]
    return found.select(*docs.columns, *named)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            break
        path = shared_path(spark, f"corpus-{k + 1}")
        docs = write_table(kept, path)
        if before:  # nothing reads what the stage before the last one kept
            removed(spark, before)
        before = path
    return kept
