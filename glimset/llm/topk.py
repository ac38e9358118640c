"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are taken as sparse rows of integer weights: a term is a component's index. Candidates and
queries are dealt into a grid of cells, so that each cell has a bounded block of either. In a cell
the candidates are inverted into postings (term -> candidates and weights); for each term, the
queries that have it scatter their weight times the postings' weights into dense score arrays;
partition selection keeps k of each array, and a ranked merge over the cells keeps k of a query.

Defined cases: vectors that are null, or hold a null, NaN or infinite component, take no part, as
queries or candidates; vectors of other lengths meet in the components that both have; an empty
vector scores 0 everywhere; ties go to the smaller id; rows without an id are left out; repeated
rows are candidates of their own but one query; a query finds no row of its own id. Vectors with a weight
beyond a long (a component from 3.6e16 on, at scale 256) take no part either; scores beyond a long are
summed whole and then count as the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES_AT_ONCE = 64


def _sparse(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row, term and weight of every component that isn't 0, in order of rows; and the terms' bound."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    ends = np.asarray(lists.offsets, dtype=np.int64)
    values = np.asarray(lists.values)[ends[0] : ends[-1]].astype(np.int64)
    size = np.diff(ends)
    row = np.repeat(np.arange(len(size)), size)
    term = np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], size)
    some = values != 0
    return row[some], term[some], values[some], int(size.max(initial=0))


def best_of_cell(candidate_ids: np.ndarray, candidates: tuple, query_ids: np.ndarray, queries: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of the k best candidates of every query; candidate_ids ascend."""
    n, (row, term, weight, terms) = len(candidate_ids), candidates
    q_row, q_term, q_weight, q_terms = queries
    most = lambda w: max(abs(int(w.min(initial=0))), abs(int(w.max(initial=0))))
    bound = most(weight) * most(q_weight) * max(terms, q_terms, 1)
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object  # Python's integers
    order = np.argsort(term, kind="stable")
    row, weight, starts = row[order], weight[order].astype(kind), np.searchsorted(term[order], np.arange(terms + 1))
    found = []
    for at in range(0, len(query_ids), QUERIES_AT_ONCE):
        ids = query_ids[at : at + QUERIES_AT_ONCE]
        mine = slice(*np.searchsorted(q_row, [at, at + len(ids)]))
        by_term = np.argsort(q_term[mine], kind="stable")
        t_row, t_weight = (q_row[mine] - at)[by_term], q_weight[mine][by_term].astype(kind)
        t_starts = np.searchsorted(q_term[mine][by_term], np.arange(terms + 1))
        scores = np.zeros((len(ids), n), kind)
        for t in range(terms):
            have, posted = slice(t_starts[t], t_starts[t + 1]), slice(starts[t], starts[t + 1])
            if have.start < have.stop and posted.start < posted.stop:
                part = np.multiply.outer(t_weight[have], weight[posted])
                whole = posted.stop - posted.start == n
                if whole and have.stop - have.start == len(ids):
                    scores += part
                elif whole:
                    scores[t_row[have]] += part
                else:
                    scores[np.ix_(t_row[have], row[posted])] += part
        if kind is object:
            scores = np.clip(scores, -(2**63), 2**63 - 1).astype(np.int64)
        own = ids[:, None] == candidate_ids[None, :]
        take = min(k + int(own.sum(axis=1).max(initial=0)), n)
        if bound < 2**62 // max(n, 1):
            key = scores.astype(np.int64) * n + (n - 1 - np.arange(n))
            key[own] = np.iinfo(np.int64).min
            best = np.argpartition(key, n - take, axis=1)[:, n - take :]
        else:  # scores too large for a common key
            best = np.stack([sorted(range(n), key=lambda c, s=s, o=o: (o[c], -int(s[c]), c))[:take] for s, o in zip(scores, own, strict=True)])
        who = np.repeat(np.arange(len(ids)), take)
        best = best.ravel()
        keep = ~own[who, best]
        found.append((ids[who[keep]], candidate_ids[best[keep]], scores[who[keep], best[keep]].astype(np.int64)))
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block_rows: int = 4096, query_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of (vec_id, embedding) for each row that is_query marks."""
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(2.0**63 / scale))
    rows = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(F.forall(x, finite))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("weights"), is_query.alias("asks"))
    n, asked = vectors.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    down, across = max(1, -(-n // block_rows)), max(1, -(-asked // query_rows))
    deal = lambda parts: F.pmod(F.xxhash64("vec_id", "weights"), F.lit(parts)).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    candidates = rows.select(deal(down).alias("i"), all_of(across).alias("j"), "vec_id", "weights")
    queries = rows.filter("asks").groupBy("vec_id").agg(F.min("weights").alias("weights"))
    queries = queries.select(all_of(down).alias("i"), deal(across).alias("j"), "vec_id", "weights")
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        left, right = left.sort_by("vec_id"), right.sort_by("vec_id")
        ids = [np.asarray(t["vec_id"], dtype=np.int64) for t in (left, right)]
        return pa.table(list(best_of_cell(ids[0], _sparse(left["weights"]), ids[1], _sparse(right["weights"]), k)), schema=kind)

    found = candidates.groupBy("i", "j").cogroup(queries.groupBy("i", "j")).applyInArrow(cell, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op8_topk": op8_topk}
ORACLES = {"op8_topk": ORACLE}
