"""The states of photos: claim, complete, fail, expire; and the log that holds them.

Files can't be updated in place: a change is a row of the status log, and the current state is the
latest row of a photo. The functions here are pure, and time is an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimset.functions.text import classified_error
from glimset.schemas import CLAIM_SIZE, LEASE_MINUTES, PENDING, PROCESSED, PROCESSING, STATUSES


def with_status(photos: DataFrame, status: str) -> DataFrame:
    return photos.filter(F.col("status") == status)


def claim(photos: DataFrame, n: int = CLAIM_SIZE) -> DataFrame:
    """Id and path of the ``n`` waiting photos with the smallest ids."""
    return with_status(photos, PENDING).select("id", "file_path").orderBy("id").limit(n)


def claimed(photos: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """All photos, with those of ``claims`` (some ids) in work since now. Spark broadcasts the ids if they are small enough."""
    ids = claims.select(F.col("id").alias("__claimed")).distinct()
    df = photos.join(ids, F.col("id") == F.col("__claimed"), "left")
    taken = F.col("__claimed").isNotNull()
    return df.withColumns({"status": F.when(taken, PROCESSING).otherwise(F.col("status")), "processing_started_at": F.when(taken, now).otherwise(F.col("processing_started_at"))}).drop("__claimed")


def is_stale(now: Column, minutes: int = LEASE_MINUTES) -> Column:
    """In work since before the lease; a photo without a start isn't."""
    return (F.col("status") == PROCESSING) & (F.col("processing_started_at") < now - F.expr(f"INTERVAL {int(minutes)} MINUTE"))


def stale(photos: DataFrame, now: Column, minutes: int = LEASE_MINUTES) -> DataFrame:
    return photos.filter(is_stale(now, minutes))


def reset_stale(photos: DataFrame, now: Column, minutes: int = LEASE_MINUTES) -> DataFrame:
    """All photos, with the stale ones waiting again."""
    back = F.coalesce(is_stale(now, minutes), F.lit(False))
    return photos.withColumns({"status": F.when(back, PENDING).otherwise(F.col("status")), "processing_started_at": F.when(~back, F.col("processing_started_at"))})


def stale_count(photos: DataFrame, now: Column, minutes: int = LEASE_MINUTES) -> DataFrame:
    return photos.agg(F.count_if(is_stale(now, minutes)).alias("reset"))


def completed(photos: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """All photos, with those whose id is in ``done`` processed now, whatever state they were in."""
    df = photos.join(done.select(F.col("id").alias("__done")).distinct(), F.col("id") == F.col("__done"), "left")
    hit = F.col("__done").isNotNull()
    return df.withColumns({"status": F.when(hit, PROCESSED).otherwise(F.col("status")), "processed_time": F.when(hit, now).otherwise(F.col("processed_time"))}).drop("__done")


def failed(photos: DataFrame, errors: DataFrame) -> DataFrame:
    """All photos, with the state and message of ``errors`` (id, error) set; one of several errors of an id."""
    last = errors.groupBy(F.col("id").alias("__id")).agg(F.max("error").alias("__error"))
    df = photos.join(last, F.col("id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    return df.withColumns({"status": F.when(hit, classified_error(F.col("__error"))).otherwise(F.col("status")), "error_message": F.when(hit, F.col("__error")).otherwise(F.col("error_message"))}).drop("__id", "__error")


def status_set(photos: DataFrame, photo_id: int, status: str) -> DataFrame:
    """All photos, with one in another state."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    return photos.withColumn("status", F.when(F.col("id") == photo_id, status).otherwise(F.col("status")))


def bad_statuses(photos: DataFrame) -> DataFrame:
    """Photos whose state is none that there is."""
    return photos.filter(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)))


def log_of(photos: DataFrame) -> DataFrame:
    """The status log that leads to photos as they are."""
    row = lambda seq, status, started=None, processed=None, error=None: F.struct(F.lit(seq).cast("long").alias("seq"), status.alias("status"), (F.lit(None).cast("timestamp_ntz") if started is None else started).alias("started_at"), (F.lit(None).cast("timestamp_ntz") if processed is None else processed).alias("processed_at"), (F.lit(None).cast("string") if error is None else error).alias("error"))
    now, start = F.col("status"), F.col("processing_started_at")
    steps = F.array(
        row(1, F.lit(PENDING)),
        F.when(now != PENDING, row(2, F.lit(PROCESSING), start)),
        F.when(~now.isin(PENDING, PROCESSING), row(3, now, start, F.col("processed_time"), F.col("error_message"))),
    )
    return photos.select(F.col("id").alias("photo_id"), F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s")).select("photo_id", "s.*")


def current(log: DataFrame) -> DataFrame:
    """The latest state of each photo of a status log: one shuffle of partial aggregates."""
    last = F.max_by(F.struct("status", "started_at", "processed_at", "error"), "seq").alias("s")
    return log.groupBy("photo_id").agg(last).select("photo_id", "s.*")


def error_changes(errors: DataFrame) -> DataFrame:
    """(id, status, error_message) for errors (id, error)."""
    return errors.select("id", classified_error(F.col("error")).alias("status"), F.col("error").alias("error_message"))


def without_photos(faces: DataFrame, gone: DataFrame) -> DataFrame:
    """The faces that are left when photos (id) are deleted."""
    return faces.join(gone.select(F.col("id").alias("photo_id")).distinct(), "photo_id", "left_anti")


def without_users(photos: DataFrame, gone: DataFrame) -> DataFrame:
    """The photos that are left when users (id) are deleted; those of no user stay."""
    return photos.join(gone.select(F.col("id").alias("user_id")).distinct(), "user_id", "left_anti")


def log_rows(changes: DataFrame, at: Column) -> DataFrame:
    """Rows of the status log for changes (photo_id, status, error) that happen at a time: ``seq`` is its microseconds."""
    time, none = at.cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz")
    return changes.select(
        "photo_id", F.unix_micros(at.cast("timestamp")).alias("seq"), "status", F.when(F.col("status") == PROCESSING, time).otherwise(none).alias("started_at"),
        F.when(F.col("status") == PROCESSED, time).otherwise(none).alias("processed_at"), F.col("error").cast("string").alias("error"),
    )


def stale_rows(log: DataFrame, now: Column, minutes: int = LEASE_MINUTES) -> DataFrame:
    """The rows to append to a status log for photos whose lease has ended: the batch form of ``leases``."""
    old = current(log).filter((F.col("status") == PROCESSING) & (F.col("started_at") < now - F.expr(f"INTERVAL {int(minutes)} MINUTE")))
    return log_rows(old.select("photo_id", F.lit(PENDING).alias("status"), F.lit(None).alias("error")), now)
