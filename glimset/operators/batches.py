"""Batches of photos: roll-ups, states and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimset.functions.text import image_url, status_icon, status_label
from glimset.schemas import FAILED, NO_FACE, PENDING, PROCESSED, PROCESSING


def rollup(photos: DataFrame) -> DataFrame:
    """One row a batch: its counts, its state, and access code and upload time of its smallest photo id.

    Photos without a batch make no row. One shuffle of partial aggregates."""
    n = lambda status: F.count_if(F.col("status") == status)
    first = lambda c: F.min_by(c, "id").alias(c)
    counts = photos.filter("batch_id IS NOT NULL").groupBy("batch_id").agg(F.count(F.lit(1)).alias("photo_count"), n(PROCESSED).alias("processed_count"), n(NO_FACE).alias("no_face_count"), n(FAILED).alias("failed_count"), first("access_code"), first("upload_time"))
    done = F.col("processed_count") + F.col("no_face_count") + F.col("failed_count")
    status = (
        F.when(done != F.col("photo_count"), PROCESSING)
        .when(F.col("failed_count") == F.col("photo_count"), FAILED)
        .when((F.col("processed_count") == 0) & (F.col("no_face_count") > 0), "NO_FACES_FOUND")
        .otherwise(PROCESSED)
    )
    return counts.withColumn("status", status)


def listing(rolled: DataFrame) -> DataFrame:
    """What a dashboard lists of a batch (the number of failures isn't part of it)."""
    return rolled.select("batch_id", "photo_count", "processed_count", "no_face_count", "status", "access_code", "upload_time")


def labelled(rolled: DataFrame) -> DataFrame:
    return rolled.select("batch_id", status_label(*(F.col(c) for c in ("status", "photo_count", "processed_count", "no_face_count"))).alias("label"), status_icon(F.col("status")).alias("icon"))


def batches_of(photos: DataFrame, user_id: int) -> DataFrame:
    """The distinct batches of a user's photos."""
    return photos.filter((F.col("user_id") == user_id) & F.col("batch_id").isNotNull()).select("batch_id").distinct()


def rollup_of_user(photos: DataFrame, user_id: int) -> DataFrame:
    """Roll-ups of the batches in which a user has photos; a shared batch counts everyone's."""
    return listing(rollup(photos.join(batches_of(photos, user_id), "batch_id", "left_semi")))


def photos_of_batch(photos: DataFrame, batch_id: str) -> DataFrame:
    found = photos.filter(F.col("batch_id") == batch_id)
    return found.select("id", "original_file_name", "upload_time", "status", image_url(F.col("file_path")).alias("image_url"))


def pending_count(photos: DataFrame) -> DataFrame:
    """How many photos of all users wait."""
    return photos.filter(F.col("status") == PENDING).agg(F.count(F.lit(1)).alias("pending"))


def code_collisions(photos: DataFrame) -> DataFrame:
    """Access codes that more than one batch has, with the number of batches."""
    pairs = photos.filter("access_code IS NOT NULL AND batch_id IS NOT NULL").select("access_code", "batch_id").distinct()
    return pairs.groupBy("access_code").agg(F.count(F.lit(1)).alias("batches")).filter("batches > 1")
