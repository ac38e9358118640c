"""Near-duplicate documents by BagMinHash signatures, banding and verified multiset overlap.

A document is the multiset of its shingles (``SHINGLE`` consecutive words; a shorter text is one
shingle). BagMinHash draws, for every shingle, Poisson processes on the weight axis: one for the
first unit and one for each octave [1, 2), [2, 4), [4, 8) ... that its count reaches. A point has a
time, a register and a place in its octave, and counts if its place lies below the shingle's count;
a register keeps its earliest point. As all is a function of shingle, octave and the point's number,
two documents agree in a register with the probability of their weighted Jaccard similarity. Points
are drawn only up to the time by which all registers are likely filled (and on, where they aren't).

Exact copies are one text from the start, whatever their number and their ids; texts get numbers, and all
that follows is about texts. Bands of some registers deal them into buckets: as many registers a band as the
threshold allows for a chance of ``MISSED`` at most that a pair at the threshold meets in no bucket. Every member
of a bucket is compared with its pivot, the bucket's smallest number, by exact multiset overlap: a hot bucket
makes as many pairs as it has members. Pairs of members that are both linked to the pivot need no look: they
are in one class. The rest is checked exactly too, but without making pairs: members that aren't in their
pivot's class are compared with all members that have this pivot, in cells of two blocks of texts of bounded
bytes, from which one link comes back for each two classes that meet. Distances are a metric, so that pairs whose distances to the pivot
differ by more than 1 - threshold are skipped. The links' components are the classes.

The number of such comparisons is (members outside of the pivot's class) x (members), for each
pivot: small for families that hold together, up to the square of the family for one that spreads
over the threshold. A member's text is copied once for each block of ``BLOCK_BYTES`` that it meets, so
that copies grow with the square of a family's bytes, too. Links are missed only where no band agrees: at a threshold of 0.8, 3 in a million.

Defined cases: every row is a document, also where ids repeat or are null; texts without words are only equal
to exact copies; a null text is a class of its own; a class has the smallest id among its rows, null if none has
one; very long texts are taken whole, in slices; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, in_slices, words_of, written

SHINGLE, THRESHOLD = 5, 0.8
REGISTERS, MISSED = 160, 1e-4
SLICE_BYTES = 4 << 20
#: Bytes of texts in a block, on average, where a text counts ``TEXT_BYTES`` besides.
BLOCK_BYTES, TEXT_BYTES = 2 << 20, 256
#: Texts' hashes and numbers that are broadcast at most: 40 MB.
FEW_TEXTS = 400_000
#: Processes, or postings, that are looked at together.
SLICE = 1 << 20
#: Texts whose signature a task remembers to have drawn.
MOST_SEEN = 200_000
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def rows_for(threshold: float, registers: int = REGISTERS, missed: float = MISSED) -> int:
    """The most registers a band at which a pair at the threshold meets in no band with a chance of ``missed`` at most; 1 if none does."""
    fits = [r for r in range(1, registers + 1) if registers % r == 0 and (1 - threshold**r) ** (registers // r) <= missed]
    return max(fits, default=1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their counts."""
    words = words_of(raw)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    total = np.full(n, min(len(h), SHINGLE), np.uint64)
    for k in range(min(len(h), SHINGLE)):
        total = total * _ODD + h[k : k + n]
    return np.unique(mixed(total), return_counts=True)


def similarity(a: tuple, b: tuple) -> float:
    """The weighted Jaccard similarity of two shingle multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash by document and register: the time of the earliest point (infinite for empty bags)."""
    m, n = registers, len(bags)
    hashes = np.concatenate([np.zeros(0, np.uint64), *(b[0] for b in bags)])
    counts = np.concatenate([np.zeros(0, np.int64), *(b[1] for b in bags)])
    doc = np.repeat(np.arange(n), [len(b[0]) for b in bags])
    weight = np.bincount(doc, counts, n)
    octaves = 1 + np.ceil(np.log2(counts)).astype(np.int64)
    entry = np.repeat(np.arange(len(counts)), octaves)
    octave = np.arange(len(entry)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    low = np.where(octave == 0, 0, 1 << np.maximum(octave - 1, 0))
    width = np.maximum(low, 1)
    seed = mixed(hashes[entry] + octave.astype(np.uint64) * _STEP)
    doc, reach = doc[entry], (counts[entry] - low).astype(np.float64) / width
    times = np.full(n * m, np.inf)
    horizon = (np.log(m) + 5) / np.maximum(weight, 1)
    pending = weight > 0
    while pending.any():
        everyone = np.flatnonzero(pending[doc])
        for first in range(0, len(everyone), SLICE):
            at = everyone[first : first + SLICE]
            t, point = np.zeros(len(at)), 0
            while len(at):
                point += 1
                draw = mixed(seed[at] + np.uint64(point * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
                t = t - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (width[at] * m)
                on = t < horizon[doc[at]]
                at, t, draw = at[on], t[on], mixed(draw[on] ^ _STEP)
                inside = ((draw & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < reach[at]).nonzero()[0]
                register = (((draw[inside] >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
                np.minimum.at(times, doc[at[inside]] * m + register, t[inside])
        pending &= np.isinf(times.reshape(n, m)).any(axis=1)
        horizon[pending] *= 2
    return times.reshape(n, m)


def bands_of(times: np.ndarray, rows: int) -> np.ndarray:
    """A bucket's key by document and band."""
    n, m = times.shape
    bits = times.view(np.uint64).reshape(n, m // rows, rows)
    key = np.broadcast_to(mixed(np.arange(1, m // rows + 1, dtype=np.uint64)), (n, m // rows))
    for k in range(rows):
        key = mixed(key * _ODD + bits[:, :, k])
    return key.view(np.int64)


def _raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _sketch(rows: int):
    """From (id, copy, text) to (id, copy, bands): the buckets' keys with the first row of each text in a task, null with its copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            copies, new = batch.column(1).to_pylist(), []
            for c in copies:
                new.append(c is not None and c not in seen)
                seen.add(c)
            if len(seen) > MOST_SEEN:
                seen.clear()
            texts, out = batch.column(2), []
            for start, stop in in_slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE_BYTES):
                which = [k for k in range(start, stop) if new[k]]
                bags = [shingles(t) for t in _raw(texts.take(pa.array(which, pa.int64())))]
                keys = dict(zip(which, zip(bags, bands_of(signatures(bags), rows), strict=True), strict=True)) if bags else {}
                out += [None if k not in keys else keys[k][1] if len(keys[k][0][0]) else [] for k in range(start, stop)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int64()))], names=["id", "copy", "bands"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarities of rows (id, pivot, text, pivot_text); rows of a pivot mostly follow each other."""
    pivot, bag = None, None
    for batch in batches:
        out = []
        for text, at, other in zip(_raw(batch.column(2)), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if at != pivot or bag is None:
                pivot, bag = at, shingles(other.as_py().encode("utf-8"))
            out.append(similarity(shingles(text), bag))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["id", "pivot", "similarity"])


def block_links(left: list[tuple], right: list[tuple], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Links of two blocks' rows (id, class, distance to the pivot, text) that join what no class has yet: one for each
    two classes that meet, which are one class from then on.

    Overlaps are summed through the right block's postings, so that rows without a common shingle
    meet nowhere."""
    bags = [shingles(r[3]) for r in right]
    names = np.concatenate([np.zeros(0, np.uint64), *(b[0] for b in bags)])
    order = np.argsort(names, kind="stable")
    names, owner = names[order], np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])[order]
    counts = np.concatenate([np.zeros(0, np.int64), *(b[1] for b in bags)])[order]
    weights = np.array([b[1].sum() for b in bags], np.float64)
    ids, classes, away = (np.array([r[k] for r in right]) for k in range(3))
    found, same = [], {}
    for a, of, distance, text in left:
        while of in same:
            of = same[of]
        if not ((classes != of) & (np.abs(away - distance) <= 1 - threshold + 1e-9)).any():
            continue
        own, times = shingles(text)
        firsts, lasts = np.searchsorted(names, own, "left"), np.searchsorted(names, own, "right")
        both = np.zeros(len(bags))
        for start, stop in in_slices((lasts - firsts).tolist(), SLICE):
            first, many = firsts[start:stop], (lasts - firsts)[start:stop]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
            both += np.bincount(owner[at], np.minimum(counts[at], np.repeat(times[start:stop], many)), len(bags))
        linked = (both >= threshold * (weights + times.sum() - both)) & (both > 0) & (classes != of)
        met, first = np.unique(classes[linked], return_index=True)
        found += [(a, x) for x in ids[linked][first].tolist()]
        same.update((c, of) for c in met.tolist())
        classes[np.isin(classes, met)] = of
    return found


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, class): the smallest id that is connected to each id of ``edges`` (a, b).

    Turns of large-star and small-star: each moves neighbours of a vertex to the smallest of them,
    until the edges are stars. A vertex is never collected with its neighbours; its minimum is
    aggregated and joined back to its edges. The turns grow with the logarithm of the longest chain."""
    kept = (lambda df: scratch.written(df, "turn")) if scratch else (lambda df: written(df, "components"))
    links = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())

    def are_stars() -> bool:
        """Whether each vertex hangs on one other, on which nothing but such vertices hang."""
        chained = links.join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        torn = links.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return chained.select("u").union(torn.select("u")).isEmpty()

    while not are_stars():
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = kept(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct())
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = kept(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    return links.select(F.col("u").alias("id"), F.col("v").alias("class")).union(links.select(F.col("v").alias("id"), F.col("v").alias("class")).distinct())


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each of docs (doc_id, text): doc_id, class_id (the class's smallest id), copy (the text's MD5, null
    for null texts) and keep: whether this is the text, with the id, that stands for its class. Rows that repeat a
    kept id and text are all marked."""
    with Scratch(docs.sparkSession, "near") as scratch:
        return written(_classes(docs, threshold, scratch), "near-dup")


def copy_of(text: Column) -> Column:
    return F.md5(text.cast("string").cast("binary"))


def _classes(docs: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), copy_of(F.col("text")).alias("copy"), F.col("text").cast("string").alias("text"))
    sketches = scratch.written(texts.mapInArrow(_sketch(rows_for(threshold)), "id long, copy string, bands array<long>"), "sketches")
    # texts with their first row's id, their buckets and a number, which stays as it is written
    numbered = sketches.filter("copy IS NOT NULL").groupBy("copy").agg(F.min("id").alias("first"), F.first("bands", ignorenulls=True).alias("bands"))
    numbered = scratch.written(numbered.withColumn("no", F.monotonically_increasing_id()), "texts")

    dealt = numbered.select(F.col("no").alias("id"), F.explode("bands").alias("key"))
    pivots = dealt.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("last > pivot").drop("last")
    pivots = scratch.written(pivots, "pivots")
    pairs = scratch.written(dealt.join(pivots, "key").filter("id <> pivot").select("id", "pivot").distinct(), "pairs")

    # the texts of those that have a partner; few enough are found by a broadcast of their hashes, so that not all texts are shuffled
    involved = pairs.select("id").union(pairs.select("pivot")).distinct()
    involved = scratch.written(numbered.select(F.col("no").alias("id"), "copy", "first").join(involved, "id", "left_semi").select(F.col("id").alias("no"), "copy", "first"), "involved")
    few = involved.limit(FEW_TEXTS + 1).count() <= FEW_TEXTS
    found = texts.join(F.broadcast(involved) if few else involved, "copy").filter(F.col("id").eqNullSafe(F.col("first"))).select(F.col("no").alias("id"), "text", F.octet_length("text").cast("long").alias("size"))
    of = scratch.written(found.dropDuplicates(["id"]), "partners")
    other = of.select(F.col("id").alias("pivot"), F.col("text").alias("pivot_text"))
    seen = pairs.join(of, "id").join(other, "pivot")
    judged = scratch.written(seen.select("id", "pivot", "text", "pivot_text").mapInArrow(_verify, "id long, pivot long, similarity double"), "judged")

    links = scratch.written(judged.filter(F.col("similarity") >= threshold).select(F.col("id").alias("a"), F.col("pivot").alias("b")), "links")
    joined = scratch.written(components(links, scratch), "joined")
    more = _rest(judged, joined, of, threshold, scratch)
    if more is not None and not more.isEmpty():  # the classes so far stand for the links that made them
        stars = joined.filter(F.col("id") != F.col("class")).select(F.col("id").alias("a"), F.col("class").alias("b"))
        joined = components(stars.union(more), scratch)
    # by text, then by row: the class's text is the one whose first id is smallest (null last), then the smallest hash
    belongs = numbered.select("no", "copy", "first").join(joined.withColumnRenamed("id", "no"), "no", "left").select("copy", "first", F.coalesce("class", "no").alias("class"))
    belongs = scratch.written(belongs, "classes")
    heads = belongs.groupBy("class").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "copy")).alias("head"))
    text_class = belongs.join(heads, "class").select("copy", F.col("head.first").alias("class_id"), (F.col("head.copy") == F.col("copy")).alias("head"))
    by_row = sketches.select("id", "copy").join(text_class, "copy", "left")
    none = F.col("copy").isNull()
    return by_row.select(F.col("id").alias("doc_id"), F.when(none, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), "copy", (none | (F.col("head") & F.col("id").eqNullSafe(F.col("class_id")))).alias("keep"))


def _rest(judged: DataFrame, belongs: DataFrame, of: DataFrame, threshold: float, scratch: Scratch) -> DataFrame | None:
    """Links between members of one pivot of whom one isn't in the pivot's class."""
    own = belongs.select(F.col("id"), F.col("class"))
    pivot_class = belongs.select(F.col("id").alias("pivot"), F.col("class").alias("pivot_class"))
    member = judged.join(own, "id", "left").join(pivot_class, "pivot", "left")
    member = member.select("pivot", "id", F.coalesce("class", "id").alias("class"), F.coalesce("pivot_class", "pivot").alias("pivot_class"), (1 - F.col("similarity")).alias("distance"))
    member = member.withColumn("outside", F.col("class") != F.col("pivot_class")).join(of.select("id", (F.col("size") + TEXT_BYTES).alias("size")), "id")
    member = scratch.written(member, "members")
    families = member.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("held"), F.sum(F.when(F.col("outside"), F.col("size"))).alias("held_out"))
    families = scratch.written(families.filter("held_out IS NOT NULL AND n > 1"), "families")
    if families.isEmpty():
        return None
    blocks = lambda held: F.ceil(F.col(held) / F.lit(float(BLOCK_BYTES))).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    rows = member.join(families.select("pivot", blocks("held").alias("across"), blocks("held_out").alias("down")), "pivot")
    at = F.xxhash64("id")
    left = rows.filter("outside").select("pivot", F.pmod(at, "down").alias("i"), every(F.col("across")).alias("j"), "id", "class", "distance")
    right = rows.select("pivot", every(F.col("down")).alias("i"), F.pmod(at, "across").alias("j"), "id", "class", "distance")

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if a.num_rows and b.num_rows:
            sides = [list(zip(*(t[c].to_pylist() for c in ("id", "class", "distance")), (x.as_py() for x in t["text"].cast(pa.binary())), strict=True)) for t in (a, b)]
            found = block_links(*sides, threshold)
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    keys = ["pivot", "i", "j"]
    left, right = (side.join(of.select("id", "text"), "id").select(*[F.col(c).alias(c) for c in (*keys, "id", "class", "distance", "text")]) for side in (left, right))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "a long, b long")
    return scratch.written(found, "more")


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "class_id")


QUERIES = {"op6_near_dup": op6_near_dup}
ORACLES: dict[str, str] = {}
