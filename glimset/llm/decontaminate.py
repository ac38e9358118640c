"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of all training tokens: the documents are taken in blocks of
bounded size, and each block is one row of a Parquet table with its own inverted index (term ->
documents and word positions). As no block needs another, building and searching need no shuffle,
and a passage that a third of all documents share only lengthens the lists of each block.

``search`` looks up windows of test items. Windows are rows of term numbers; in each block, those of
which all terms occur start from the places of their term that is rarest there, go on to the next rarest, shift
every list by the term's offset in the window and intersect, all windows at once: what is left are the
places where the whole window occurs (exact phrase). With ``slack`` over 0 it also returns the windows
whose first term occurs, and each other term at most ``slack`` words off its place from there
(proximity). ``op4_decontaminate`` returns the exact part, ``op4_decontaminate_near`` both. ``clean`` returns the
rows without an exact phrase: it searches each block's index when it has been built and stores none.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Defined cases: a null
or empty text has no words, so it is neither hit nor a test item; items without an id are not
searched; repeated documents and items are rows of their own (an id is listed once); without
items nothing is hit; other columns are ignored; texts of any length are indexed whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, in_slices, removed, shared_path, words_of, write_table, written

#: A block's terms are words, with a blank between two. Postings follow each other by term: ``starts`` (32-bit) says where a
#: term's begin, ``docs`` (16-bit) and ``positions`` (32-bit) are each posting's document in the block and place in it.
#: Packed numbers cost the JVM a copy, where arrays would cost it a step for every element.
INDEX = "block string, doc_ids array<long>, n_words array<long>, terms binary, starts binary, docs binary, positions binary"
FOUND = "row_key string, doc_id long, n_words long, spans array<struct<start:long,end:long>>, near array<struct<start:long,end:long>>, items array<string>, near_items array<string>"
#: Documents of a block at most, and the bits of a place in one.
MOST_DOCS, PLACE_BITS = 512, 43
#: Documents and bytes of text at which a block ends.
BLOCK_DOCS, BLOCK_BYTES = 256, 1 << 20
#: Bytes of items that are looked up in one pass.
CHUNK_BYTES = 4 << 20
#: Places that are looked at together.
MOST_PLACES = 1 << 20
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _list(values: np.ndarray | list | pa.Array, kind: pa.DataType) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def index_block(doc_ids: list, texts: list[bytes | None]) -> pa.RecordBatch:
    """One block's inverted index."""
    number: dict[bytes, int] = {}
    ids, n_words = [], []
    for text in texts:
        words = words_of(text)
        n_words.append(len(words))
        ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
    docs = np.repeat(np.arange(len(texts), dtype=np.uint16), n_words)
    positions = np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in n_words)])
    found = np.concatenate([np.zeros(0, np.int32), *ids])
    order = np.argsort(found, kind="stable")
    starts = np.searchsorted(found[order], np.arange(len(number) + 1)).astype(np.int32)
    block = f"{doc_ids[0]}-{len(doc_ids)}-{np.random.default_rng().integers(2**62)}"
    columns = [pa.array([block]), _list(doc_ids, pa.int64()), _list(n_words, pa.int64()), *(pa.array([x], pa.binary()) for x in (b" ".join(number), starts.tobytes(), docs[order].tobytes(), positions[order].tobytes()))]
    return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", "n_words", "terms", "starts", "docs", "positions"])


def blocks_of(texts: pa.Array, block_docs: int, block_bytes: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts, which end at ``block_docs`` (512 at most) or ``block_bytes`` together, or one text of more."""
    block_docs = min(block_docs, MOST_DOCS)
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    start, held = 0, 0
    for k in range(len(texts) + 1):
        if k == len(texts) or k > start and (k - start == block_docs or held + sizes[k] > block_bytes):
            if k > start:
                yield start, k
            start, held = k, 0
        if k < len(texts):
            held += sizes[k]


def build_index(docs: DataFrame, path: str, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Writes the index of (doc_id, text) to ``path`` and returns it.

    A block ends at ``block_docs`` documents (512 at most) or ``block_bytes`` of text."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in blocks_of(batch.column(1), block_docs, block_bytes):
                part = batch.slice(start, stop - start)
                yield index_block(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(blocks, INDEX).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


class Windows:
    """The distinct windows of some items, as rows of term numbers, by length; and the items that hold each.

    What executors get of it is some 50 bytes a word of the items."""

    def __init__(self, items: Iterable[tuple[str, bytes | None]], words: int):
        number: dict[bytes, int] = {}
        self.names: list[str] = []
        found: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in items:
            own = np.fromiter((number.setdefault(w, len(number)) for w in words_of(text)), np.int32)
            if len(own):
                n = min(words, len(own))
                found.setdefault(n, []).append((len(self.names), np.lib.stride_tricks.sliding_window_view(own, n)))
                self.names.append(item)
        self.vocabulary = pa.array(list(number), pa.binary())
        self.groups = []
        for parts in found.values():
            terms, at = np.unique(np.concatenate([w for _, w in parts]), axis=0, return_inverse=True)
            owner = np.repeat([k for k, _ in parts], [len(w) for _, w in parts])
            order = np.argsort(at.ravel(), kind="stable")
            self.groups.append((terms, np.searchsorted(at.ravel()[order], np.arange(len(terms) + 1)), owner[order]))

    def items(self, group: int, window: int) -> list[str]:
        _, starts, owner = self.groups[group]
        return [self.names[k] for k in owner[starts[window] : starts[window + 1]]]


class Block:
    """Postings of one block, of the terms that the vocabulary has. A place is document << 33 plus 2**32
    plus the position, so that a position less an offset never reaches into another document; keys
    are places under the term's rank, and ascend."""

    def __init__(self, numbers: np.ndarray, starts: np.ndarray, docs: np.ndarray, positions: np.ndarray, vocabulary: int):
        """``numbers``: for each term of the block, its number in the vocabulary, or -1."""
        own = np.flatnonzero(numbers >= 0)
        n = starts[own + 1] - starts[own]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[own], n)
        self.rank = np.full(vocabulary, -1, np.int64)
        self.rank[numbers[own]] = np.arange(len(own))
        self.n, self.first = n.astype(np.int64), np.cumsum(n) - n
        self.places = (docs[at].astype(np.int64) << 33) + (1 << 32) + positions[at]
        self.keys = (np.repeat(np.arange(len(own), dtype=np.int64), n) << PLACE_BITS) + self.places

    @classmethod
    def unpacked(cls, packed: list[pa.Scalar], vocabulary: pa.Array) -> Block:
        """From the terms, starts, docs and positions of a row of the index."""
        terms, *numbers = (x.as_buffer() for x in packed)
        own = pa.array(terms.to_pybytes().split(b" ") if len(terms) else [], pa.binary())
        known = np.asarray(pc.fill_null(pc.index_in(own, vocabulary), -1), dtype=np.int64)
        return cls(known, *(np.frombuffer(x, kind) for x, kind in zip(numbers, (np.int32, np.uint16, np.int32), strict=True)), len(vocabulary))

    def near(self, rank: np.ndarray, place: np.ndarray, slack: int = 0) -> np.ndarray:
        """Whether the term of each rank occurs at the place, or up to ``slack`` words off it."""
        low = (rank << PLACE_BITS) + place - slack
        next_ = self.keys[np.minimum(np.searchsorted(self.keys, low), len(self.keys) - 1)]
        return (next_ >= low) & (next_ <= low + 2 * slack)

    def phrases(self, terms: np.ndarray, slack: int = 0) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(window, place where it starts): of the exact phrases, and of those that need the slack."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ranks = self.rank[terms]
        windows = np.flatnonzero((ranks >= 0).all(axis=1))
        if not len(windows):
            return none, none
        ranks = ranks[windows]
        order = np.argsort(self.n[ranks], axis=1, kind="stable")
        rarest = ranks[np.arange(len(ranks)), order[:, 0]]
        exact, near = [none], [none]
        ends = np.cumsum(self.n[rarest])
        for a, b in in_slices(self.n[rarest].tolist(), MOST_PLACES):  # so many places at once
            n = self.n[rarest[a:b]]
            row = np.repeat(np.arange(a, b), n)
            place = self.places[np.arange(len(row)) - np.repeat(ends[a:b] - n - (ends[a] - n[0]), n) + np.repeat(self.first[rarest[a:b]], n)] - order[row, 0]
            found = self._kept(ranks, order, row, place, 0)
            exact.append((windows[found[0]], found[1]))
            if slack:  # shifts count from the first term: from the rarest, they would depend on the block
                row, place = np.repeat(row, 2 * slack + 1), (place[:, None] + np.arange(-slack, slack + 1)).ravel()
                on = self.near(ranks[row, 0], place)
                row, place = np.unique(np.stack([row[on], place[on]]), axis=1)
                found = self._kept(ranks, order, row, place, slack)
                near.append((windows[found[0]], found[1]))
        exact, near = (tuple(np.concatenate(x) for x in zip(*found, strict=True)) for found in (exact, near))
        if slack:
            known = set(zip(*(x.tolist() for x in exact), strict=True))
            other = np.array([p not in known for p in zip(*(x.tolist() for x in near), strict=True)], bool)
            near = near[0][other], near[1][other]
        return exact, near

    def _kept(self, ranks: np.ndarray, order: np.ndarray, row: np.ndarray, place: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """The starts around which all terms are, from the rarest to the most frequent."""
        for k in range(0 if slack else 1, order.shape[1]):
            if not len(row):
                break
            offset = order[row, k]
            on = self.near(ranks[row, offset], place + offset, slack)
            row, place = row[on], place[on]
        return row, place


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(end, out[-1]["end"])
        else:
            out.append({"start": start, "end": end})
    return out


def search(index: DataFrame, items: DataFrame, words: int = 10, slack: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row a document: doc_id, n_words, spans (word ranges that exact windows cover), near (the
    same for proximity matches that aren't exact), items and near_items (ids as sorted strings).

    The items go to the executors in chunks of about ``chunk_bytes`` (and one item at least), so that what is
    broadcast has a bound, some ten times that; each chunk is one pass over the index."""
    sc = index.sparkSession.sparkContext
    asked = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).filter("item_id IS NOT NULL")
    chunks = chunks_of(asked, chunk_bytes)

    def chunk(k: int) -> DataFrame:
        part = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == k)
        windows = sc.broadcast(Windows(((r.item_id, None if r.text is None else bytes(r.text)) for r in part.toLocalIterator()), words))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = windows.value
            for batch in batches:
                for r in range(batch.num_rows):
                    block, doc_ids, n_words, *packed = (batch.column(c)[r] for c in range(7))
                    yield found_in(block.as_py(), doc_ids.values, n_words.values, Block.unpacked(packed, known.vocabulary), known, slack)

        return index.mapInArrow(look, FOUND)

    found = chunk(0)
    for k in range(1, chunks):
        found = found.unionByName(chunk(k))
    if chunks > 1:  # a document has one row a chunk
        joined = lambda c: F.flatten(F.collect_list(c)).alias(c)
        found = found.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *map(joined, ("spans", "near", "items", "near_items")))
        found = found.withColumns({c: _sql_merged(c) for c in ("spans", "near")} | {c: F.array_sort(F.array_distinct(c)) for c in ("items", "near_items")})
    return found.drop("row_key")


def chunks_of(asked: DataFrame, chunk_bytes: int) -> int:
    """Chunks of about so many bytes that the items' texts make."""
    total = asked.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    return max(1, -(-total // chunk_bytes))


def _sql_merged(spans: str):
    """The union of spans, as disjoint spans."""
    return F.expr(f"""aggregate(array_sort({spans}), cast(array() as array<struct<start:bigint,end:bigint>>),
        (a, x) -> CASE WHEN size(a) > 0 AND x.start <= element_at(a, -1).end
                       THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end))))
                       ELSE concat(a, array(x)) END)""")


def found_in(block: str, doc_ids: pa.Array, n_words: pa.Array, postings: Block, windows: Windows, slack: int) -> pa.RecordBatch:
    n, sizes = len(doc_ids), n_words.to_numpy()
    spans: list[list] = [[] for _ in range(2 * n)]
    items: list[set] = [set() for _ in range(2 * n)]
    for group, (terms, _, _) in enumerate(windows.groups):
        for kind, (window, place) in enumerate(postings.phrases(terms, slack)):
            doc, at = place >> 33, np.maximum(0, (place & 0x1FFFFFFFF) - (1 << 32))
            end = np.minimum(at + terms.shape[1], sizes[doc])
            for w, d, a, e in zip(window.tolist(), doc.tolist(), at.tolist(), end.tolist(), strict=True):
                spans[kind * n + d].append((a, e))
                items[kind * n + d].update(windows.items(group, w))
    merged = [_merged(x) for x in spans]
    named = [sorted(x) for x in items]
    columns = [pa.array([f"{block}-{k}" for k in range(n)]), doc_ids, n_words, *(pa.array(merged[k : k + n], SPANS) for k in (0, n)), *(pa.array(named[k : k + n], pa.list_(pa.string())) for k in (0, n))]
    return pa.RecordBatch.from_arrays(columns, names=["row_key", "doc_id", "n_words", "spans", "near", "items", "near_items"])


def clean(docs: DataFrame, items: DataFrame, words: int = 10, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of docs in whose texts no exact window of any item occurs, items without an id being looked up too.

    Each block's index is searched when it has been built, and goes: Python gets the texts alone and returns a verdict on
    each, and no task holds more of the index than a block's. Each chunk of the items is one pass over the rows; only where
    there are several, the rows that a pass leaves are written for the next one."""
    spark = docs.sparkSession
    asked = items.select(F.col("text").cast("binary").alias("text")).filter("text IS NOT NULL").distinct()
    chunks, before = chunks_of(asked, chunk_bytes), None
    for k in range(chunks):
        part = asked.filter(F.pmod(F.xxhash64("text"), F.lit(chunks)) == k)
        windows = spark.sparkContext.broadcast(Windows((("", bytes(r.text)) for r in part.toLocalIterator()), words))
        docs = docs.filter(_free_of(windows)(F.col("text").cast("string")))
        if k + 1 < chunks:
            path = shared_path(spark, "clean")
            docs = write_table(docs, path)
            if before:
                removed(spark, before)
            before = path
    return docs


def _free_of(windows: Broadcast) -> Callable[[Column], Column]:
    """Whether a text holds none of the windows."""

    @F.arrow_udf("boolean")
    def free(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = windows.value
        for texts in batches:
            out = np.ones(len(texts), bool)
            for start, stop in blocks_of(texts, BLOCK_DOCS, BLOCK_BYTES):
                block = index_block(list(range(start, stop)), texts[start:stop].cast(pa.binary()).to_pylist())
                postings = Block.unpacked([block.column(c)[0] for c in (3, 4, 5, 6)], known.vocabulary)
                for terms, _, _ in known.groups:
                    _, place = postings.phrases(terms)[0]
                    out[start + (place >> 33)] = False
            yield pa.array(out)

    return free


def contamination(docs: DataFrame, items: DataFrame, words: int = 10, slack: int = 0, index_path: str | None = None) -> DataFrame:
    """Indexes the documents and searches the items' windows in them.

    The index stays at ``index_path`` for other items; without a path it is made in the shared folder and
    removed when the result has been written there."""
    if index_path:
        return search(build_index(docs, index_path), items, words, slack)
    with Scratch(docs.sparkSession, "postings") as scratch:
        return written(search(build_index(docs, f"{scratch.path}/index"), items, words, slack), "contamination")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op4_decontaminate_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What exact windows cover, and what windows cover that need a slack of one word."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slack=1)
    covered = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", covered("spans").alias("n_hit"), covered("near").alias("n_near"), F.size("near_items").cast("long").alias("n_near_items"),
        F.array_join("near_items", ",").alias("near_items"), (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
it AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM it, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM d, (SELECT DISTINCT n FROM win) AS ns, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
k AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""

QUERIES = {"op4_decontaminate": op4_decontaminate, "op4_decontaminate_near": op4_decontaminate_near}
ORACLES = {"op4_decontaminate": ORACLE}
