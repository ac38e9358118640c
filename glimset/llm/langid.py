"""Language identification by cross-parsing entropy.

For each language, a suffix automaton is built of labelled text. A document is parsed against each
automaton from left to right into the longest phrases that occur in the labelled text; a language's
cross-entropy estimate is its number of phrases, normalised: times log2 of the labelled text's
length, divided by the document's. The language needing the fewest wins, ties by code point.

Text is lower-cased; runs of other characters than letters become one space. The parse runs over
blocks of ``BLOCK`` symbols, each with phrases of its own, for all blocks and languages of a batch
at once: one step reads one symbol of every block. A symbol that a language never has closes the
phrase it stands in. The automata are sparse: the transitions of all states lie in one table, each
state's shifted so that none meet, so that memory follows the transitions (three a symbol at most)
whatever the alphabet's size.

What is learnt has a bound: of each language, the ``docs_per_lang`` labelled documents first in the
order of a hash of their id (of their text, without an id), and of each of these a span of
``symbols_per_lang`` / ``docs_per_lang`` symbols from a place that the hash picks, so that every
document counts alike wherever its text is long. Of more languages than fit into ``symbols`` together
each gets less; of more than ``most_langs``, those with the most documents are learnt. What is predicted
covers every whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if
nothing could be learnt; labelled rows without a language or letters teach nothing; ids may repeat
or be null; other columns are carried in ``row`` whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import held_out, in_slices

BLOCK = 1024
SHARES = 1 << 20
UNKNOWN = "und"
BATCH_CHARS = 1 << 21


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The normalised code points of the texts, one after the other, and each text's end in them."""
    lowered = [t.lower() for t in texts]
    ends = np.cumsum([len(t) for t in lowered], dtype=np.int64)
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    first = np.zeros(len(points), bool)
    first[np.concatenate([[0], ends[:-1]]).astype(np.int64)[np.diff(ends, prepend=0) > 0]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter is the space
    keep &= letter | ~first
    return np.where(letter, points, 32)[keep], np.concatenate([[0], np.cumsum(keep)])[ends] if len(points) else ends


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a text of symbols, by state; the start is state 0."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def shifted(moves: list[dict[int, int]], start: int) -> tuple[list[int], int]:
    """A shift for each state, at least ``start``, such that no two are alike and no two transitions meet
    at shift + symbol; and the end of the places that they use. States with many transitions go first."""
    used, taken = bytearray(4 * len(moves) + 64), bytearray(4 * len(moves) + 64)

    def room(n: int) -> None:
        if n >= len(used):
            used.extend(bytes(n))
            taken.extend(bytes(n))

    shift, end, fit, many = [0] * len(moves), 1, 0, 0
    for state in sorted(range(len(moves)), key=lambda k: -len(moves[k])):
        symbols = sorted(moves[state])
        low, high = (symbols[0], symbols[-1]) if symbols else (0, 0)
        if len(symbols) != many:  # states of as many transitions go on where the last one found room
            fit, many = 0, len(symbols)
        while True:
            fit += 1
            at = fit - low
            room(fit + high + 1)
            if at >= 0 and not taken[at] and not any(used[at + c] for c in symbols):
                break
        taken[at] = 1
        for c in symbols:
            used[at + c] = 1
        shift[state] = start + at
        end = max(end, at + high + 1)
    return shift, start + end


class Model:
    """The automata of all languages in one table.

    A state is its shift, at least 1. The place at state + symbol holds the state that owns it, in its
    upper half, and the next state; if another owns it, the state has no such transition."""

    def __init__(self, texts: dict[str, np.ndarray]):
        self.langs = sorted(k for k, v in texts.items() if len(v))
        alphabet = np.unique(np.concatenate([texts[k] for k in self.langs])) if self.langs else np.zeros(0, np.uint32)
        self.alphabet, self.width = alphabet, len(alphabet) + 1
        parts, roots, at = [np.zeros(1, np.int64)], [], 1
        for k in self.langs:
            moves = suffix_automaton(np.searchsorted(alphabet, texts[k]).tolist())
            shift, end = shifted(moves, at)
            part = np.zeros(end - at, np.int64)
            for state, row in enumerate(moves):
                for c, to in row.items():
                    part[shift[state] + c - at] = shift[state] << 32 | shift[to]
            parts.append(part)
            roots.append(shift[0])
            at = end
        if at >= 2**31:
            raise ValueError("the languages' texts are too long for one table")
        self.table = np.concatenate([*parts, np.zeros(self.width, np.int64)])
        self.roots = np.array(roots, np.int64)
        self.bits = np.array([max(1.0, np.log2(len(texts[k]))) for k in self.langs])

    def coded(self, points: np.ndarray) -> np.ndarray:
        """Symbols for normalised code points; those that no language has share one."""
        codes = np.full(0x110000, self.width - 1, np.int32)
        codes[self.alphabet] = np.arange(len(self.alphabet))
        return codes[points]

    def phrases(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases by text and language, for texts that end at ``ends`` in codes."""
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        blocks = -(-(ends - starts) // BLOCK)
        owner = np.repeat(np.arange(len(ends)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = starts[owner] + nth * BLOCK
        size = np.minimum(ends[owner] - at, BLOCK)
        order = np.argsort(-size, kind="stable")
        at, size = at[order], size[order]
        running = np.searchsorted(-size, -np.arange(size.max(initial=0)), side="left")  # blocks with a symbol at each step
        state = np.tile(self.roots, (len(at), 1))
        count = np.zeros(state.shape, np.int32)
        place, ended = np.empty_like(state), np.empty(state.shape, bool)
        for step, n in enumerate(running.tolist()):
            symbol = codes[at[:n] + step].astype(np.int64)
            np.add(state[:n], symbol[:, None], out=place[:n])
            np.take(self.table, place[:n], out=place[:n], mode="clip")
            np.not_equal(place[:n] >> 32, state[:n], out=ended[:n])
            np.add(count[:n], ended[:n], out=count[:n])
            np.bitwise_and(place[:n], 0xFFFFFFFF, out=state[:n])
            block, lang = np.nonzero(ended[:n])
            root = self.roots[lang]  # the next phrase begins with the symbol, if the language has it
            found = self.table[root + symbol[block]]
            state[block, lang] = np.where(found >> 32 == root, found & 0xFFFFFFFF, root)
        count += state != self.roots
        total = np.zeros((len(ends), len(self.langs)), np.int64)
        np.add.at(total, owner[order], count)
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
        """For each text the language, a score (the runner-up's part of both estimates' sum), and the
        best estimate in bits a symbol."""
        known = ["" if t is None else t for t in texts]
        points, ends = symbols_of(known)
        size = np.diff(ends, prepend=0)
        out: list[tuple[str, float, float | None]] = [(UNKNOWN, 0.0, None)] * len(texts)
        if not self.langs:
            return out
        estimate = self.phrases(self.coded(points), ends) * self.bits[None, :]
        best = np.argmin(estimate, axis=1)
        for k in np.flatnonzero(size).tolist():
            row = np.sort(estimate[k])
            out[k] = (self.langs[best[k]], float(row[1] / (row[0] + row[1])) if len(row) > 1 else 1.0, float(row[0] / size[k]))
        return out


def fit(docs: DataFrame, docs_per_lang: int = 200, symbols_per_lang: int = 40_000, symbols: int = 1_600_000, most_langs: int = 1000) -> Model:
    """Learns from (doc_id, text, lang); the bounds are those of the module's description."""
    h = F.coalesce(F.xxhash64(F.when(F.col("doc_id").isNotNull(), F.col("doc_id").cast("string"))), F.lit(0))
    some = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.when(F.col("doc_id").isNotNull(), h).otherwise(F.xxhash64(F.col("text").cast("string"))).alias("h"))
    counts = some.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    if not counts:
        return Model({})
    share = max(1, min(symbols_per_lang, symbols // len(counts)) // docs_per_lang)
    # all but about twice the rows to learn from go before the ranks are made, so that no language's rows meet
    parts = docs.sparkSession.createDataFrame([(r.lang, min(SHARES, 1 + 2 * SHARES * (docs_per_lang + 20) // r.n)) for r in counts], "lang string, part long")
    few = some.join(F.broadcast(parts), "lang").filter(F.pmod("h", F.lit(SHARES)) < F.col("part")).drop("part")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    ranked = few.select("lang", "h").distinct().withColumn("rank", rank).filter(F.col("rank") <= docs_per_lang).drop("rank")
    # twice the span, as what isn't a letter goes
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - 2 * share, F.lit(0)) + 1).cast("int") + 1
    spans = few.join(F.broadcast(ranked), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.substring("text", start, F.lit(2 * share))).alias("text"))
    texts: dict[str, list[np.ndarray]] = {}
    for row in sorted(spans.collect(), key=lambda r: (r.lang, r.h)):
        texts.setdefault(row.lang, []).append(np.append(symbols_of([row.text])[0][:share], np.uint32(32)))
    return Model({k: np.concatenate(v) for k, v in texts.items() if any(len(x) > 1 for x in v)})


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns ``keep``; of all, if None), and lang_pred, score and bits (a symbol; null for ``und``) by the whole text."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("row"), F.col("text").cast("string").alias("text"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found: list[tuple] = []
            for start, stop in in_slices(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), BATCH_CHARS):
                found += known.value.predict(texts[start:stop].to_pylist())
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), *(pa.array([f[k] for f in found], pa.float64()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "lang_pred", "score", "bits"])

    return rows.mapInArrow(label, rows.drop("text").schema.add("lang_pred", "string").add("score", "double").add("bits", "double"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model, ["doc_id", "held_out"])
    return found.select("row.*", "lang_pred", "score", "bits")


QUERIES = {"op10_langid": op10_langid}
ORACLES: dict[str, str] = {}
