"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size (the words of its documents). The sources share a total in
proportion to their weights, but none is repeated more than ``max_epochs`` times: what a source
cannot take is shared again among the others, by weight, until no target is above its cap. The
documents of a source are then taken whole ``floor(target / size)`` times, and once more for a
seeded share of them, so that the words taken come near the target.

The extra copies are drawn systematically. A source's documents are dealt by hash into strata of
about ``stratum_rows``, each is ordered by size, and every 1/fraction-th document from a seeded
start is taken: in each stratum the words taken miss their share by one document at most, and no
stratum grows with its source.

Defined cases: a null or blank text has size 0; null sources form one source, which comes last; a
source of size 0 has target 0 and is not taken; rows without an id are dealt by their text; repeated rows
and ids count as documents of their own; an empty table gives an empty result; other columns are carried in ``row`` whatever their
names are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import hash32, small_join, written

WORD = r"[^\x20\x09-\x0D]+"
PARTS = 1_000_000_000


def cycled_weights(sources: DataFrame, weights: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight``: the weights in turn, to the sources by code point, null last.

    ``sources`` has one row a source, so that the one unpartitioned window sees only those: some 100 bytes for each
    source, whatever its documents, which bounds a run to what one task can sort (some ten million sources)."""
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((n - 1) % len(weights) + 1).cast("int"))
    return sources.withColumn("weight", turn.cast("long"))


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): shares of the sum of source_size.

    In order of cap / weight, the water level reaches one cap after the other; a source is capped
    if its cap is not above its share of what is left to it and to those after it. All sums are of
    integers, so that the targets do not depend on the order of rows.
    """
    big = lambda c: F.col(c).cast("decimal(38,0)")
    everyone = Window.partitionBy()
    at = Window.orderBy("__ratio", F.col("source").asc_nulls_last())
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    df = sources.withColumn("__cap", F.col("source_size") * max_epochs)
    df = df.withColumn("__ratio", F.col("__cap") / F.col("weight"))
    df = (
        df.withColumn("__left", F.sum("source_size").over(everyone) - F.coalesce(F.sum("__cap").over(before), F.lit(0)))
        .withColumn("__weights", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("__capped", big("__cap") * big("__weights") <= big("weight") * big("__left"))
    )
    free = lambda c: F.min(F.when(~F.col("__capped"), F.struct("__ratio", F.col("source").isNull(), "source", c))).over(everyone)[c]
    df = df.withColumn("__free_left", free("__left")).withColumn("__free_weights", free("__weights"))
    share = (F.col("weight") * F.col("__free_left")).cast("double") / F.col("__free_weights").cast("double")
    df = df.withColumn("target", F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise(share))
    return df.select("source", "source_size", "weight", "target", *[c for c in sources.columns if c not in ("source", "source_size", "weight")])


def mix(docs: DataFrame, carry: Sequence[str] = ("doc_id",), weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 0, stratum_rows: int = 2000) -> DataFrame:
    """One row a document: row (a struct of the carried columns), size, source_size, target,
    repeats (how often the mix takes it) and taken (its words in the mix, repeats counted)."""
    narrow = docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("row"),
        F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        hash32(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit("")))).alias("__h"),
        F.xxhash64("doc_id", "text").alias("__tie"),
    )
    if "text" not in carry:
        narrow = written(narrow, "mix-sizes")
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__n"))
    targets = written(water_fill(cycled_weights(sources, weights), max_epochs), "mix-targets")
    few = targets.select(
        F.col("source").alias("__source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.lit(float(PARTS)) / F.col("source_size").cast("double"))).otherwise(0).cast("long").alias("__parts"),
        F.ceil(F.col("__n") / F.lit(float(stratum_rows))).cast("long").alias("__strata"),
    )
    df = small_join(narrow, few, F.col("source").eqNullSafe(F.col("__source")))
    df = df.withColumn("__stratum", F.col("__h") % F.col("__strata"))
    start = hash32(F.concat_ws("|", F.lit(f"{seed}"), F.coalesce("source", F.lit("")), F.col("__stratum").cast("string"))) % PARTS
    rank = F.row_number().over(Window.partitionBy("source", "__stratum").orderBy("size", "__h", "__tie")).cast("long")
    df = df.withColumn("__rank", rank).withColumn("__start", start).withColumn("__more", F.col("__parts") % PARTS)
    reached = lambda r: F.expr(f"({r} * __more + __start) div {PARTS}")
    df = df.withColumn("repeats", F.expr(f"__parts div {PARTS}") + reached("__rank") - reached("(__rank - 1)"))
    return df.select("row", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("row.doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CAST('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8) AS BIGINT) AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM docs GROUP BY source),
a AS (
  SELECT *, 3 * source_size AS cap,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weights
  FROM sources
  WINDOW w AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, CAST(cap AS HUGEINT) * weights <= CAST(weight AS HUGEINT) * rest AS capped FROM a),
free AS (SELECT max(rest) FILTER (NOT capped) AS rest, max(weights) FILTER (NOT capped) AS weights FROM b),
targets AS (
  SELECT b.source, b.source_size, b.n,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE CAST(CAST(b.weight * free.rest AS BIGINT) AS DOUBLE) / CAST(CAST(free.weights AS BIGINT) AS DOUBLE) END AS target
  FROM b, free),
c AS (
  SELECT d.*, t.source_size, t.target, h % CAST(ceil(n / 2000.0) AS BIGINT) AS stratum,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target * 1000000000.0::DOUBLE / CAST(t.source_size AS DOUBLE)) AS BIGINT) ELSE 0 END AS parts
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT *, row_number() OVER (PARTITION BY source, stratum ORDER BY size, h, doc_id) AS r, parts % {PARTS} AS more,
         CAST('0x' || substr(md5('0|' || coalesce(source, '') || '|' || CAST(stratum AS VARCHAR)), 1, 8) AS BIGINT) % {PARTS} AS start
  FROM c)
SELECT doc_id, size, source_size, target,
       size * (parts // {PARTS} + (r * more + start) // {PARTS} - ((r - 1) * more + start) // {PARTS}) AS taken
FROM e
"""

QUERIES = {"op7_mixing": op7_mixing}
ORACLES = {"op7_mixing": ORACLE}
