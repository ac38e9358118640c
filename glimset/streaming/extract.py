"""Streaming ingest: files to vectors to tables.

An extractor is a function from a file's bytes to a list of vectors; it raises for a file that it can't
load or in which it finds nothing. It runs by Arrow batch; one bad file becomes a row with an error. One
that needs a model gets it from ``setup``, which runs once in each Python worker.

A micro-batch's files are matched with their photos by path. It is written in three steps into folders
named after the batch, which a replay overwrites: the claim (rows of the status log that say that work has
begun), the faces by photo, then the outcome (again rows of the log). So each photo's faces are there once,
and what a lost driver leaves is a claim, whose lease ends.

``work_once`` is the same without a stream: it claims waiting photos of the log, loads their files and
writes what comes of them. It takes up what the leases have sent back.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glimset.functions.text import classified_error
from glimset.operators import lifecycle
from glimset.schemas import CLAIM_SIZE, EXTRACTED, PENDING, PROCESSED, PROCESSING, STATUS_LOG
from glimset.sources.shared import filesystem

#: From a file's bytes, and the model if there is a set-up, to vectors.
Extractor = Callable[..., list[list[float]]]
_MODELS: dict[str, object] = {}
#: Rows that a task of a micro-batch writes, about.
ROWS_A_FILE = 100_000


def stand_in(content: bytes, dimension: int = 8) -> list[list[float]]:
    """A deterministic stand-in for tests, no model of faces: vectors from a checksum of the bytes. The
    first byte says how many (modulo 4); 0 is no face, and a file that is empty or starts with ``!`` can't be loaded."""
    if content[:1] in (b"", b"!"):
        raise ValueError("Could not load image")
    n = content[0] % 4
    if not n:
        raise ValueError("No face detected in image")
    return [[zlib.crc32(content, 31 * k + d) / 2**32 for d in range(dimension)] for k in range(n)]


def extract(files: DataFrame, extractor: Extractor, setup: Callable[[], object] | None = None) -> DataFrame:
    """(path, face_index, face_vector, error) of files (path, content).

    ``setup`` makes what the extractor gets as its second argument, once in each Python worker."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup and key not in _MODELS:
            _MODELS[key] = setup()
        model = (_MODELS[key],) if setup else ()
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows += [(path, k, v, None) for k, v in enumerate(extractor(content.as_py() or b"", *model))]
                except Exception as e:  # a bad file must not stop the others; its error is its row
                    rows.append((path, None, None, str(e)))
            kinds = (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=EXTRACTED.names)

    return files.select("path", "content").mapInArrow(run, EXTRACTED)


def changes(extracted: DataFrame) -> DataFrame:
    """(path, status, error): the state that each file gets."""
    one = extracted.groupBy("path").agg(F.max("error").alias("error"))
    return one.select("path", F.when(F.col("error").isNull(), PROCESSED).otherwise(classified_error(F.col("error"))).alias("status"), "error")


def relative(path: Column) -> Column:
    """The last two parts of a path, ``batch/file``: what photos have as their file's path."""
    return F.substring_index(F.regexp_replace(path, "[?].*$", ""), "/", -2)


def write_batch(extracted: DataFrame, photos: DataFrame, faces_path: str, log_path: str, batch: int | str, now: Column) -> None:
    """Writes a micro-batch: the claims, the faces (photo_id, face_index, face_vector), and the outcomes.

    ``photos``: (id, file_path). Files without a photo go to ``<log_path>-unmatched`` with their errors."""
    extracted.persist()
    kept = [extracted]
    try:
        # as many tasks as rows ask for, not Spark's number of shuffle partitions, which most batches would leave empty
        parts = extracted.count() // ROWS_A_FILE + 1
        kept.append(found := changes(extracted.select("path", "error").repartition(parts, "path")).withColumn("file_path", relative(F.col("path"))).persist())
        found.count()  # with its bytes known, Spark broadcasts it where it is small, and photos are read but not shuffled
        kept.append(mine := photos.select(F.col("id").alias("photo_id"), "file_path").join(found.select("file_path"), "file_path", "left_semi").persist())
        mine.count()
        kept.append(done := found.join(mine, "file_path", "left").select("path", "photo_id", "status", "error").persist())
        known = done.filter("photo_id IS NOT NULL")
        claim = known.select("photo_id", F.lit(PROCESSING).alias("status"), F.lit(None).cast("string").alias("error"))
        lifecycle.log_rows(claim, now).write.mode("overwrite").parquet(f"{log_path}/batch={batch}-1")
        faces = extracted.filter("error IS NULL").join(known.select("path", "photo_id"), "path").select("photo_id", "face_index", "face_vector")
        faces.coalesce(parts).write.mode("overwrite").parquet(f"{faces_path}/batch={batch}")
        outcome = lifecycle.log_rows(known, now + F.expr("INTERVAL 1 MICROSECOND"))
        begun = F.when(F.col("status") != PENDING, now.cast("timestamp_ntz"))
        outcome.withColumn("started_at", begun).write.mode("overwrite").parquet(f"{log_path}/batch={batch}-2")
        done.filter("photo_id IS NULL").select("path", "status", "error").write.mode("overwrite").parquet(f"{log_path}-unmatched/batch={batch}")
    finally:
        for df in reversed(kept):
            df.unpersist()


def start(files: DataFrame, photos: DataFrame, extractor: Extractor, faces_path: str, log_path: str, checkpoint: str, seconds: int | None = 2, setup: Callable[[], object] | None = None) -> StreamingQuery:
    """Runs the ingest on a stream of files: every so many seconds, or (None) once through what is there."""
    writer = extract(files, extractor, setup).writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda df, batch: write_batch(df, photos, faces_path, log_path, batch, F.lit(datetime.now(timezone.utc))))
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The status log that was written to ``path``."""
    return spark.read.schema(STATUS_LOG).parquet(path)


def work_once(spark: SparkSession, photos: DataFrame, root: str, extractor: Extractor, faces_path: str, log_path: str, batch: str, now: Column, n: int = CLAIM_SIZE, setup: Callable[[], object] | None = None) -> int:
    """Claims up to ``n`` photos that wait by the log, works on their files under ``root``, and returns how many. 0: nothing waits.

    The claim is written before the files are loaded. ``n`` is what one turn takes: their paths pass the driver."""
    waiting = lifecycle.with_status(lifecycle.current(read_log(spark, log_path)), PENDING).select(F.col("photo_id").alias("id"))
    claims = lifecycle.claim(photos.join(waiting, "id").withColumn("status", F.lit(PENDING)), n).collect()
    if not claims:
        return 0
    mine = spark.createDataFrame(claims, "id long, file_path string")
    begun = mine.select(F.col("id").alias("photo_id"), F.lit(PROCESSING).alias("status"), F.lit(None).cast("string").alias("error"))
    lifecycle.log_rows(begun, now).write.mode("overwrite").parquet(f"{log_path}/batch={batch}-0")
    files, at = filesystem(spark, root)
    there = [r.file_path for r in claims if files.exists(at.suffix(f"/{r.file_path}"))]
    found = extract(spark.read.format("binaryFile").load([f"{root}/{p}" for p in there]), extractor, setup) if there else spark.createDataFrame([], EXTRACTED)
    lost = [(f"{root}/{r.file_path}", None, None, "Could not load image") for r in claims if r.file_path not in there]
    write_batch(found.union(spark.createDataFrame(lost, EXTRACTED)), mine, faces_path, log_path, batch, now + F.expr("INTERVAL 1 MICROSECOND"))
    return len(claims)
