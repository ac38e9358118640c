"""Toxicity by a classifier chain of linear models.

The categories are label columns in a given order. Each has a logistic model over the words of the
text and the beginnings of its words (which also find inflected forms); every model after the first
also sees the earlier categories' probabilities. It is trained with out-of-fold probabilities, as
those of models that have seen a row would be too sure; in use, it gets what the earlier models,
trained on all rows, predict for the text.

``labels`` has one column on toxicity and one on quality, so that the query's chain goes from low
quality to toxic.

What is learnt has a bound: ``sample_rows`` labelled ids, those first by a hash of the id, and
``most_features`` features a model. What is scored covers every whole text.

Defined cases: a null or empty text has no features and gets the models' base rates; an id with a
null label teaches only the other categories; several labels of an id are averaged and rounded; a
category without both labels predicts its constant rate (0 if unlabelled); ids may repeat or be
null; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from ._common import held_out, in_slices, labelled_sample, words_of

SLICE_BYTES = 8 << 20
PREFIXES = (3, 4, 5)
MOST_CACHED = 200_000


def features_of_word(word: bytes) -> list[int]:
    return [zlib.crc32(word), *(zlib.crc32(word[:n], n) for n in PREFIXES if len(word) > n)]


def features_of(raw: bytes | None) -> set[int]:
    """Hashes of a text's distinct words and of their beginnings."""
    return {f for w in set(words_of(raw)) for f in features_of_word(w)}


class Linear:
    """A logistic model: weights of selected features, of earlier probabilities, and a bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, earlier: np.ndarray, bias: float):
        self.features, self.weights, self.earlier, self.bias = features, weights, earlier, bias


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p):
    return np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))


class Rows:
    """Sparse rows of distinct features, numbered."""

    def __init__(self, sets: Sequence[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.names, self.column = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_inverse=True)
        self.row = np.repeat(np.arange(len(sets)), self.size)


def fit_linear(rows: Rows, use: np.ndarray, y: np.ndarray, earlier: np.ndarray, most_features: int, l2: float = 1.0, steps: int = 100) -> tuple[Linear, np.ndarray]:
    """Learns from the rows that ``use`` marks; also returns the probabilities of all rows.

    Features are those of at least 5 rows whose log odds differ most from the others', in standard
    errors; weights by Adam on the whole sample, with an l2 penalty."""
    n, width = len(y), len(rows.names)
    positive, total = float(y[use].sum()), float(use.sum())
    rate = (positive + 0.5) / (total + 1) if total else 0.0
    if not 0 < positive < total:
        rate = positive / total if total else 0.0
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), float(_logit(rate))), np.full(n, rate)
    mine = use[rows.row]
    seen = np.bincount(rows.column[mine], minlength=width)
    hits = np.bincount(rows.column[mine], y[rows.row[mine]], width)
    a, b, c, d = hits + 0.5, seen - hits + 0.5, positive - hits + 0.5, total - positive - (seen - hits) + 0.5
    z = np.abs(np.log(a * d / (b * c))) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    z[seen < 5] = 0
    chosen = np.sort(np.argsort(-z, kind="stable")[:most_features])
    chosen = chosen[z[chosen] > 2.5]
    number = np.full(width, -1)
    number[chosen] = np.arange(len(chosen))
    column = number[rows.column]
    row, column = rows.row[column >= 0], column[column >= 0]
    dense = np.hstack([_logit(earlier), np.ones((n, 1))])
    w, v = np.zeros(len(chosen)), np.zeros(dense.shape[1])
    v[-1] = _logit(rate)
    m = np.zeros(len(w) + len(v))
    s = np.zeros_like(m)
    logits = lambda: np.bincount(row, w[column], n) + dense @ v
    for t in range(1, steps + 1):
        error = np.where(use, _sigmoid(logits()) - y, 0.0)
        grad = np.concatenate([np.bincount(column, error[row], len(w)) + l2 * w, dense.T @ error + l2 * np.append(v[:-1], 0)])
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        step = 0.3 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        w, v = w - step[: len(w)], v - step[len(w) :]
    return Linear(rows.names[chosen], w, v[:-1], float(v[-1])), _sigmoid(logits())


class Chain:
    """The models of the categories in order."""

    def __init__(self, categories: Sequence[str], models: Sequence[Linear]):
        self.categories, self.models = list(categories), list(models)
        self.weights: dict[int, np.ndarray] = {}
        for k, model in enumerate(models):
            for f, w in zip(model.features.tolist(), model.weights, strict=True):
                self.weights.setdefault(f, np.zeros(len(models)))[k] = w
        self.words: dict[bytes, tuple[int, ...]] = {}

    def _of_word(self, word: bytes) -> tuple[int, ...]:
        if len(self.words) > MOST_CACHED:
            self.words.clear()
        found = self.words[word] = tuple(f for f in features_of_word(word) if f in self.weights)
        return found

    def probabilities(self, texts: list[bytes | None]) -> np.ndarray:
        """By text and category."""
        out = np.zeros((len(texts), len(self.models)))
        sums = np.zeros_like(out)
        for k, raw in enumerate(texts):
            known: set[int] = set()
            for word in set(words_of(raw)):
                found = self.words.get(word)
                known.update(self._of_word(word) if found is None else found)
            for f in sorted(known):
                sums[k] += self.weights[f]
        for k, model in enumerate(self.models):
            out[:, k] = _sigmoid(sums[:, k] + _logit(out[:, :k]) @ model.earlier + model.bias)
        return out


def fit_chain(sets: Sequence[np.ndarray], labels: np.ndarray, categories: Sequence[str], folds: int = 5, most_features: int = 4000) -> Chain:
    """Trains the chain; labels: by row and category, NaN where unknown. Row k is in fold k mod folds."""
    rows, n = Rows(sets), len(sets)
    fold = np.arange(n) % folds
    out_of_fold = np.zeros((n, len(categories)))
    models = []
    for c in range(len(categories)):
        known = ~np.isnan(labels[:, c])
        y = np.where(known, labels[:, c], 0.0)
        for k in range(folds if c + 1 < len(categories) else 0):
            _, p = fit_linear(rows, known & (fold != k), y, out_of_fold[:, :c], most_features)
            out_of_fold[fold == k, c] = p[fold == k]
        models.append(fit_linear(rows, known, y, out_of_fold[:, :c], most_features)[0])
    return Chain(categories, models)


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample_rows: int = 8000, **options) -> Chain:
    """Learns the label columns ``categories`` from the sample that the module describes."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, stop in in_slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE_BYTES):
                found = [sorted(features_of(t)) for t in texts[start:stop].cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, stop - start).columns[:-1], pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "features"])

    sample = labelled_sample(docs, labels, list(categories), sample_rows)
    sets = sample.mapInArrow(extract, sample.drop("text").schema.add("features", T.ArrayType(T.LongType())))
    one = sets.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in categories], F.min("features").alias("features"))
    table = one.toArrow().sort_by("doc_id")
    given = np.array([[np.nan if v is None else float(v > 0) for v in table[c].to_pylist()] for c in categories]).T.reshape(-1, len(categories))
    features = [np.asarray(x.values, dtype=np.int64) for x in table["features"]]
    return fit_chain(features, given, categories, **options)


def predict(docs: DataFrame, chain: Chain, keep: list[str]) -> DataFrame:
    """row (a struct of the columns ``keep`` of docs) and p_<category> of each whole text."""
    known = docs.sparkSession.sparkContext.broadcast(chain)
    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))
    kind = rows.drop("text").schema
    for c in chain.categories:
        kind = kind.add(f"p_{c}", "double")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            slices = in_slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE_BYTES)
            found = np.concatenate([np.zeros((0, len(known.value.models))), *(known.value.probabilities(texts[a:b].cast(pa.binary()).to_pylist()) for a, b in slices)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p, pa.float64()) for p in found.T)], names=kind.names)

    return rows.mapInArrow(judge, kind)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, p_low_quality, p_toxic, score (= p_toxic) and predicted (1 from 0.5 on)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = fit(docs, labels, ["low_quality", "toxic"])
    found = predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), chain, ["doc_id", "held_out"])
    return found.select("row.*", "p_low_quality", "p_toxic").withColumn("score", F.col("p_toxic")).withColumn("predicted", F.when(F.col("p_toxic") >= 0.5, 1).otherwise(0))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
