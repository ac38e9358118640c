"""The test tables as users, photos and faces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimset.functions.text import derived_access_code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"))


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, at = F.col("event_type"), F.col("ts")
    batch = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.replace(at.cast("date").cast("string"), F.lit("-"), F.lit("")))
    status = F.when(kind == "signup", "PENDING").when(kind == "click", "PROCESSING").when(kind == "view", "PROCESSED").when(kind == "error", "FAILED").otherwise("NO_FACE_DETECTED")
    df = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", batch.alias("batch_id"), F.concat(F.lit("IMG_"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("original_file_name"),
        status.alias("status"), at.alias("upload_time"),
        F.when((kind == "click") & (F.col("event_id") % 7 != 0), at + F.expr("INTERVAL 1 MINUTE")).alias("processing_started_at"),
        F.when(kind == "view", at + F.expr("INTERVAL 5 MINUTE")).alias("processed_time"),
        F.when(kind == "error", "Could not load image").when(kind == "purchase", "No face detected in image").alias("error_message"),
    )
    return df.withColumns({"access_code": derived_access_code(F.col("batch_id")), "file_path": F.concat("batch_id", F.lit("/"), F.col("id").cast("string"), F.lit(".jpg"))})


def search_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The photos that own vectors, up to three each."""
    photo = F.floor(F.col("vec_id") / 3).cast("long")
    df = table(spark, sf_dir, "embeddings").groupBy(photo.alias("id")).agg(F.min_by("label", "vec_id").cast("string").alias("scope"))
    return df.select(
        "id", derived_access_code(F.col("scope")).alias("access_code"), F.when(F.col("id") % 5 == 4, "PENDING").otherwise("PROCESSED").alias("status"),
        F.concat(F.lit("IMG_"), F.col("id").cast("string"), F.lit(".jpg")).alias("original_file_name"),
        F.concat(F.col("id").cast("string"), F.lit(".jpg")).alias("file_path"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("upload_time"),
    )


def photo_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector; every 50th is null."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 3).cast("long").alias("photo_id"), F.when(F.col("vec_id") % 50 != 49, F.col("embedding").cast("array<double>")).alias("face_vector"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose ids 50 divides as queries, each in the scope of its own photo."""
    own = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.floor(F.col("vec_id") / 3).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return own.join(search_photos(spark, sf_dir).select("id", "access_code"), "id").select("query_id", "access_code", "vector")


def request(spark: SparkSession, sf_dir: str) -> tuple[list[float], str]:
    """What a search asks with: vector 0, and the access code of its photo."""
    first = lambda c: F.min_by(c, "vec_id")
    of = table(spark, sf_dir, "embeddings").filter("vec_id < 3").agg(first("embedding").cast("array<double>"), derived_access_code(first("label").cast("string")))
    return tuple(of.first())
