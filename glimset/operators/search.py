"""Exact range search over vectors, inside an access code.

There is no search without an access code. Results name photos: neither vectors nor distances leave
by default. A query vector is a row of data and never a literal, so that neither plans nor event logs
hold it, and it is not written anywhere.

Faces can be stored by code (``write_faces``): in folders by the code's first characters, sorted by
code inside. A search of such a table reads one folder, and of it the row groups that hold the code;
what it reads is as large as the code's share, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimset.functions.text import image_url
from glimset.functions.vectors import euclidean
from glimset.schemas import DIMENSION, PROCESSED, STORED_FACES, THRESHOLD

#: How many characters of a code name a folder: two hexadecimal ones make 256 folders.
SCOPE_CHARS = 2


def faces_with_photos(faces: DataFrame, photos: DataFrame) -> DataFrame:
    """Each face with its photo's id, access code and state."""
    of = photos.select(F.col("id").alias("photo_id"), "access_code", "status")
    return faces.join(of, "photo_id").select(F.col("id").alias("face_id"), "photo_id", "access_code", "status", "face_vector")


def _in_scope(faces: DataFrame, code: str) -> DataFrame:
    """The faces of a code, as far as their own columns tell."""
    if "scope" in faces.columns:
        faces = faces.filter(F.col("scope") == code[:SCOPE_CHARS])
    return faces.filter(F.col("access_code") == code) if "access_code" in faces.columns else faces


def visible_faces(faces: DataFrame, photos: DataFrame, code: str | None = None) -> DataFrame:
    """Faces with a vector, of processed photos, of one access code if it is given.

    Faces that are stored by code are filtered by it before they meet the photos."""
    found = photos.filter(F.col("status") == PROCESSED)
    faces = faces.filter("face_vector IS NOT NULL")
    if code is not None:
        found = found.filter(F.col("access_code") == code)
        faces = _in_scope(faces, code)
    return faces_with_photos(faces.drop("access_code", "scope"), found)


def write_faces(faces: DataFrame, photos: DataFrame, path: str, mode: str = "append") -> None:
    """Stores faces with their photos' access codes, by code. Faces of photos without a code are in no scope and stay out.

    Codes are dealt by range, so that one with many faces is cut into files and not one task's work."""
    of = photos.select(F.col("id").alias("photo_id"), "access_code").filter("access_code IS NOT NULL")
    rows = faces.select("id", "photo_id", "face_vector").join(of, "photo_id").withColumn("scope", F.substring("access_code", 1, SCOPE_CHARS))
    rows = rows.repartitionByRange("scope", "access_code", F.xxhash64("id")).sortWithinPartitions("scope", "access_code")
    rows.select("id", "photo_id", "face_vector", "access_code", "scope").write.mode(mode).partitionBy("scope").parquet(path)


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    """The faces that ``write_faces`` stored."""
    return spark.read.schema(STORED_FACES).parquet(path)


def query_row(spark: SparkSession, vector: Sequence[float], access_code: str, dimension: int | None = DIMENSION) -> DataFrame:
    """A request as a table of one row (access_code, vector); an error if the vector hasn't ``dimension`` components (None: any)."""
    if dimension is not None and len(vector) != dimension:
        raise ValueError(f"expected {dimension} components, found {len(vector)}")
    return spark.createDataFrame(pa.table({"access_code": [access_code], "vector": pa.array([[float(x) for x in vector]], pa.list_(pa.float64()))}))


def matches(photos: DataFrame, faces: DataFrame, vector: Sequence[float], access_code: str, threshold: float = THRESHOLD, dimension: int | None = DIMENSION) -> DataFrame:
    """The photos of ``access_code`` with a face nearer than ``threshold`` to ``vector``, each once, with all their columns.

    Code and state are filters of the scans, photos are read once, and only faces of the scope meet the one row of the query."""
    asked = F.broadcast(query_row(photos.sparkSession, vector, access_code, dimension).withColumnRenamed("vector", "__vector"))
    scope = photos.filter((F.col("access_code") == access_code) & (F.col("status") == PROCESSED))
    own = _in_scope(faces.filter("face_vector IS NOT NULL"), access_code).select(F.col("photo_id").alias("id"), F.col("face_vector").alias("__face"))
    near = scope.join(own, "id").join(asked, "access_code").filter(euclidean(F.col("__face"), F.col("__vector")) < threshold)
    return near.select(*photos.columns).dropDuplicates(["id"])


def search(photos: DataFrame, faces: DataFrame, vector: Sequence[float], access_code: str, threshold: float = THRESHOLD, dimension: int | None = DIMENSION) -> DataFrame:
    """What a search of one code tells: see ``matches`` and ``result``."""
    return result(matches(photos, faces, vector, access_code, threshold, dimension))


def distances(photos: DataFrame, faces: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, face_id, photo_id, distance) of the queries (query_id, access_code, vector) and all
    visible faces of their codes. The join is by code: Spark broadcasts the queries if they are small
    enough by its own measure of their bytes, else shuffles both sides and splits codes that are hot."""
    asked = queries.select("query_id", "access_code", F.col("vector").alias("__vector"))
    pairs = visible_faces(faces, photos).join(asked, "access_code")
    return pairs.select("query_id", "face_id", "photo_id", euclidean(F.col("face_vector"), F.col("__vector")).alias("distance"))


def range_search(photos: DataFrame, faces: DataFrame, queries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, photo_id): the photos with a face nearer than the threshold to each query, each once."""
    return distances(photos, faces, queries).filter(F.col("distance") < threshold).select("query_id", "photo_id").distinct()


def result(photos: DataFrame) -> DataFrame:
    """What a search tells of a photo."""
    return photos.select("id", "original_file_name", "upload_time", image_url(F.col("file_path")).alias("image_url"))


def response(found: DataFrame) -> DataFrame:
    """What a search answers with: the matched photos (``matches``) as rows, each with the number of matches of its code.

    No matches make no rows; ``total_matches`` then still says 0."""
    totals = found.groupBy("access_code").agg(F.count(F.lit(1)).alias("total_matches"))
    told = found.select("access_code", "id", "original_file_name", "upload_time", image_url(F.col("file_path")).alias("image_url"))
    return told.join(totals, "access_code").select("total_matches", "id", "original_file_name", "upload_time", "image_url")


def envelope(found: DataFrame) -> DataFrame:
    """One row: total_matches, and all photos of ``found`` as one array, by id. For answers that fit into a row; ``response`` is for any."""
    return found.agg(F.count(F.lit(1)).alias("total_matches"), F.sort_array(F.collect_list(F.struct(*found.columns))).alias("photos"))


def total_matches(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total_matches"))


def owner_photos(photos: DataFrame, users: DataFrame, username: Column | str) -> DataFrame:
    """The photos of a user by name; an unknown name is an error when the result is read."""
    named = users.filter(F.col("username") == username).agg(F.max("id").alias("owner"))
    owner = named.select(F.coalesce("owner", F.raise_error(F.lit("no such user")).cast("long")).alias("owner"))
    return photos.join(F.broadcast(owner), F.col("user_id") == F.col("owner")).drop("owner")
