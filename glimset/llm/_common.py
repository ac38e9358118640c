"""What several of the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimset.sources.shared import removed, shared_path, write_table, written

__all__ = ["Scratch", "WORD_BYTES", "hash32", "held_out", "in_slices", "joined_few", "labelled_sample", "small_join", "removed", "shared_path", "words_of", "write_table", "written"]

#: Maps A-Z to a-z and every ASCII byte but letters and digits to a space, so that
#: ``bytes.split`` yields the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of UTF-8 text.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def words_of(raw: bytes | None) -> list[bytes]:
    """The lower-cased words of UTF-8 text; none if it is null."""
    return raw.translate(WORD_BYTES).split() if raw else []


class Scratch:
    """A folder of the shared store for tables that are needed until a result is written.

    Used as ``with Scratch(spark, label) as scratch``: what ``scratch.written`` wrote goes at the end,
    so that the result must not depend on it then."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, shared_path(spark, label)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        removed(self.spark, self.path)

    def written(self, df: DataFrame, label: str) -> DataFrame:
        return write_table(df, f"{self.path}/{label}-{uuid.uuid4().hex[:8]}")


def hash32(value: Column) -> Column:
    """The first 32 bits of a string's MD5 as a long: SQL engines agree on it."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the documents that no model may learn from; a null id is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


#: Bytes of a table that is broadcast at most, by what its columns hold.
FEW_BYTES = 48 << 20


def small_join(big: DataFrame, small: DataFrame, on: Column, most_bytes: int = FEW_BYTES) -> DataFrame:
    """Left join that broadcasts ``small`` (a written table) only if its rows have at most so many bytes."""
    return big.join(F.broadcast(small) if bytes_of(small) <= most_bytes else small, on, "left")


def bytes_of(df: DataFrame) -> int:
    """Bytes of a table's rows: 16 a value, and what strings and binaries hold."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    return df.agg(F.coalesce(F.sum(sum(texts, F.lit(16 * len(df.columns)))), F.lit(0))).first()[0]


def joined_few(big: DataFrame, few: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """``big`` with ``mark``: whether ``few`` (a written table of distinct keys) has its keys, nulls being equal."""
    theirs = few.select(*[F.col(k).alias(f"__{k}") for k in keys], F.lit(True).alias(mark))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return small_join(big, theirs, on).withColumn(mark, F.coalesce(mark, F.lit(False))).drop(*[f"__{k}" for k in keys])


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """(doc_id, *columns, text) of at most ``rows`` labelled ids that are not held out.

    An id's label is the rounded mean of its rows (null if all are); ids without any are left out.
    Those first by a hash of the id are taken, so that another run takes the same. Copies of an id
    in docs stay: the caller reduces them to one."""
    mean = [F.round(F.avg(c)).cast("int").alias(c) for c in columns]
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(*mean)
    known = known.filter(F.coalesce(*columns).isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", *columns, "text")


def in_slices(sizes, most: int):
    """(start, stop) of runs of rows with ``most`` bytes together, or one row of more."""
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if k > start and held + size > most:
            yield start, k
            start, held = k, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes)
