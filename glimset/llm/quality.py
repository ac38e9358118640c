"""Quality classification: histogram gradient-boosted trees over document statistics.

A document becomes ``STATISTICS`` numbers, of its whole text. Trees of one depth are grown on
binned statistics: each level sums gradients by node, statistic and bin and takes the best split of
every node. The forest is flattened into arrays of split statistics, thresholds and leaf values;
all rows of a batch walk down all trees in numpy, one level a step.

What is learnt has a bound: ``sample_rows`` labelled ids, those first by a hash of the id. What is
scored covers every whole text.

Defined cases: a null or empty text has the statistics of one without words, and is scored like any
other; null labels teach nothing; several labels of an id are averaged and rounded; without
labelled texts every score is 0.5; ids may repeat or be null; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import held_out, in_slices, labelled_sample

STATISTICS = (
    "log_bytes log_words log_lines word_bytes longest_word upper digits symbols exclamations bars stops non_ascii spaces "
    "distinct top_word repeated longest_run log_longest_run distinct_lines line_words line_symbols line_upper short_words distinct_pairs"
).split()
SLICE_BYTES = 8 << 20
_CLASS = np.zeros((256, 9), np.float64)
for _k, _of in enumerate((range(65, 91), range(97, 123), range(48, 58), b"$%&#*@^~<>{}[]\\=+_", b"!", b"|", b".,;:?", range(128, 256), b" \t\n\r\x0b\x0c")):
    _CLASS[list(_of), _k] = 1
_PLAIN = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)) + b" .,;:?'"
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)


def statistics(raw: bytes | None) -> list[float]:
    """The statistics of a UTF-8 text."""
    raw = raw or b""
    n = max(1, len(raw))
    upper, lower, digits, symbols, exclamations, bars, stops, other, spaces = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    counts = Counter(words)
    same = list(map(eq, words, words[1:]))
    repeated = sum(same)
    run = max((sum(1 for _ in g) for k, g in groupby(same) if k), default=0) if repeated else 0
    symbol_line = max((len(x.translate(None, _PLAIN)) / len(x) for x in lines if len(x) >= 30), default=0.0)
    upper_line = max((len(x.translate(None, _NOT_UPPER)) / len(x) for x in lines if len(x) >= 30), default=0.0)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), sum(map(len, words)) / n_words, max(map(len, words), default=0),
        upper / max(1, upper + lower), digits / n, symbols / n, exclamations / n, bars / n, stops / n, other / n, spaces / n,
        len(counts) / n_words, max(counts.values(), default=0) / n_words, repeated / n_words, run / n_words, np.log1p(run),
        len(set(lines)) / n_lines, len(words) / n_lines, symbol_line, upper_line, sum(len(w) <= 3 for w in words) / n_words,
        len(set(zip(words, words[1:], strict=False))) / n_words,
    ]


class Forest:
    """Trees of one depth as arrays: node k's children are 2k + 1 and 2k + 2, and leaves follow the
    nodes. A node that was not split sends all rows left."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, depth: int):
        self.base, self.feature, self.threshold, self.leaf, self.depth = base, feature, threshold, leaf, depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Forest:
    """Boosts ``trees`` trees on rows x and labels y (0 or 1) by logistic loss.

    ``least``: the smallest sum of second derivatives on either side of a split."""
    nodes = 2**depth - 1
    feature, threshold, leaves = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes + 1))
    if not len(x):
        return Forest(0.0, feature, threshold, leaves, depth)
    rows, width = x.shape
    prior = np.clip(y.mean(), 1 / (rows + 2), 1 - 1 / (rows + 2))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(rows, np.log(prior / (1 - prior)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(rows, np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            local = at - first
            gs, hs = (np.stack([np.bincount(local * bins + binned[:, f], w, n * bins).reshape(n, bins) for f in range(width)], axis=1).cumsum(axis=2) for w in (g, h))
            whole_g, whole_h = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + l2) + (whole_g - gs) ** 2 / (whole_h - hs + l2) - whole_g**2 / (whole_h + l2)
            gain[(hs < least) | (whole_h - hs < least)] = 0
            best = gain.reshape(n, -1).argmax(axis=1)
            for k in range(n):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            at = 2 * at + 1 + (x[np.arange(rows), feature[t, at]] > threshold[t, at])
        at -= nodes
        leaves[t] = -rate * np.bincount(at, g, nodes + 1) / (np.bincount(at, h, nodes + 1) + l2)
        margin += leaves[t, at]
    return Forest(float(np.log(prior / (1 - prior))), feature, threshold, leaves, depth)


def measured(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Statistics of the texts of a batch, a bounded part of it at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for start, stop in in_slices(sizes, SLICE_BYTES):
        yield start, stop, np.array([statistics(t) for t in texts[start:stop].cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", sample_rows: int = 20_000, **options) -> Forest:
    """Learns ``labels``' column from the sample that the module describes."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, x in measured(batch.column(2)):
                yield pa.RecordBatch.from_arrays([*batch.slice(start, stop - start).columns[:2], pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    sample = labelled_sample(docs, labels, [column], sample_rows).mapInArrow(measure, "doc_id long, label int, x array<double>")
    rows = sorted(sample.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).collect())
    x = np.array([r.x for r in rows], np.float64).reshape(-1, len(STATISTICS))
    return grow(x, np.array([min(1, max(0, r.label)) for r in rows], np.float64), **options)


def score(docs: DataFrame, forest: Forest, keep: list[str]) -> DataFrame:
    """row (a struct of the columns ``keep`` of docs) and the score of each whole text."""
    known = docs.sparkSession.sparkContext.broadcast(forest)
    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [known.value.probability(x) for _, _, x in measured(batch.column(1))]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    return rows.mapInArrow(judge, rows.drop("text").schema.add("score", "double"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    forest = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    found = score(docs.withColumn("held_out", held_out(F.col("doc_id"))), forest, ["doc_id", "held_out"])
    return found.select("row.*", "score").withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
