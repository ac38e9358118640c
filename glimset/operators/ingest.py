"""Intake of files and users: validation, naming, codes, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimset.functions.text import access_code, stored_path
from glimset.functions.vectors import widened
from glimset.schemas import IMAGE_TYPES, MAX_FILE_BYTES, MAX_REQUEST_BYTES, PENDING
from glimset.sources.shared import written


def validated(files: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """One row a request of files (request_id, content_type, stored, bytes): whether it is accepted, its
    files, and those stored. One file that is no image, or a size over the limits, rejects the request.
    With ``requests`` (request_id), those without any file have a row too, and are rejected."""
    image = F.coalesce(F.lower("content_type").isin(*IMAGE_TYPES), F.lit(False))
    small = F.coalesce(F.col("bytes") <= MAX_FILE_BYTES, F.lit(True))
    found = files.groupBy("request_id").agg(F.bool_and(image).alias("images"), F.bool_and(small).alias("small"), F.coalesce(F.sum("bytes") <= MAX_REQUEST_BYTES, F.lit(True)).alias("fits"), F.count(F.lit(1)).alias("total_files"), F.count_if("stored").alias("stored_files"))
    good = F.col("images") & F.col("small") & F.col("fits")
    judged = found.select("request_id", good.alias("accepted"), "total_files", F.when(good, F.col("stored_files")).otherwise(F.lit(0)).cast("long").alias("successful_uploads"))
    if requests is None:
        return judged
    every = requests.select("request_id").distinct().join(judged, "request_id", "left")
    return every.fillna(False, "accepted").fillna(0, ["total_files", "successful_uploads"])


def requests(files: DataFrame) -> DataFrame:
    """A batch id and an access code for each request: drawn once a request, as its rows are joined to it."""
    drawn = files.select("request_id").distinct().withColumn("batch_id", F.uuid()).withColumn("__code", F.uuid())
    return drawn.select("request_id", "batch_id", access_code(F.col("__code")).alias("access_code"))


def new_photos(files: DataFrame, drawn: DataFrame, now: Column) -> DataFrame:
    """Waiting photos for stored files (request_id, file_id, user_id, name) and their requests' codes."""
    df = files.filter("stored").join(drawn, "request_id")
    return df.select("user_id", stored_path(F.col("batch_id"), F.col("file_id"), F.col("name")).alias("file_path"), F.col("name").alias("original_file_name"), "batch_id", "access_code", F.lit(PENDING).alias("status"), now.alias("upload_time"))


def upload_envelope(photos: DataFrame, files: DataFrame) -> DataFrame:
    """One row a request: its files, those that became photos, batch and code (null if none did)."""
    made = photos.groupBy("request_id").agg(F.count(F.lit(1)).alias("successful_uploads"), F.max("batch_id").alias("batch_id"), F.max("access_code").alias("access_code"))
    total = files.groupBy("request_id").agg(F.count(F.lit(1)).alias("total_files"))
    return total.join(made, "request_id", "left").select("request_id", "total_files", F.coalesce("successful_uploads", F.lit(0)).cast("long").alias("successful_uploads"), "batch_id", "access_code")


def registrations(new: DataFrame, users: DataFrame) -> DataFrame:
    """(ordinal, username, email, result) for new accounts in the order of ``ordinal`` (unique): ``created``,
    or what is taken; the name is looked at first. Only accounts that exist or were created before take a
    name or an address: a row that is turned away takes neither. A null name or address is never taken.

    Rows decide each other in turns: of those undecided, a row that is first for its name and its address is
    created, and those that share either with it are turned away. The turns are as many as the longest chain
    of rows that wait for each other, few unless names and addresses are woven on purpose."""
    rows = new.select("ordinal", "username", "email")
    for column in ("username", "email"):
        known = users.select(F.col(column).alias("__known")).distinct()
        rows = rows.join(known, F.col(column) == F.col("__known"), "left").withColumn(f"__{column}", F.col("__known").isNotNull()).drop("__known")
    rows = written(rows, "registrations")
    open_ = rows.filter("NOT __username AND NOT __email").select("ordinal", "username", "email")
    created = open_.limit(0)
    while True:
        firsts = open_
        for column in ("username", "email"):
            first = open_.groupBy(F.col(column).alias("__key")).agg(F.min("ordinal").alias("__first"))
            firsts = firsts.join(first, F.col(column).eqNullSafe(F.col("__key"))).filter(F.col(column).isNull() | (F.col("ordinal") == F.col("__first"))).drop("__key", "__first")
        firsts = written(firsts, "registrations-first")
        if firsts.isEmpty():
            break
        created = created.union(firsts)
        open_ = open_.join(firsts.select("ordinal"), "ordinal", "left_anti")
        for column in ("username", "email"):
            open_ = open_.join(firsts.select(F.col(column).alias("__key")), F.col(column) == F.col("__key"), "left_anti")
        open_ = written(open_, "registrations-open")
    for column in ("username", "email"):
        by = created.filter(F.col(column).isNotNull()).select(F.col(column).alias("__key"), F.col("ordinal").alias(f"__by_{column}"))
        rows = rows.join(by, F.col(column) == F.col("__key"), "left").drop("__key")
    taken = lambda c: F.col(f"__{c}") | F.coalesce(F.col(f"__by_{c}") < F.col("ordinal"), F.lit(False))
    return rows.select("ordinal", "username", "email", F.when(taken("username"), "username taken").when(taken("email"), "email taken").otherwise("created").alias("result"))


def new_users(decided: DataFrame, digests: DataFrame, first_id: int) -> DataFrame:
    """The rows to append to the users for ``registrations``' result and the passwords' digests (ordinal, password).

    Ids are ``first_id`` and up by ordinal, with gaps where a row was turned away, so that another run gives the same."""
    made = decided.filter("result = 'created'").join(digests.select("ordinal", "password"), "ordinal", "left")
    return made.select((F.col("ordinal") + F.lit(first_id)).cast("long").alias("id"), "username", "password", "email")


def user_by(users: DataFrame, column: str, value: str) -> DataFrame:
    """The user with a name or address; the password's digest isn't shown."""
    return users.filter(F.col(column) == value).select("id", "username", "email")


def unexpired(tokens: DataFrame, now: Column, millis: int) -> DataFrame:
    """Tokens (subject, issued_at) that haven't expired by now."""
    return tokens.withColumn("expires_at", F.col("issued_at") + F.expr(f"INTERVAL {millis // 1000} SECOND")).filter(F.col("expires_at") >= now)


def valid_tokens(tokens: DataFrame, users: DataFrame, now: Column, millis: int) -> DataFrame:
    """Tokens (subject, user_id, issued_at) that haven't expired and whose subject is the name of the user who shows them."""
    shown = users.select(F.col("id").alias("user_id"), F.col("username").alias("subject"))
    return unexpired(tokens, now, millis).join(shown, ["user_id", "subject"], "left_semi")


def exploded_faces(extracted: DataFrame) -> DataFrame:
    """One row a face of photos (photo_id, vectors), with its place from 0."""
    return extracted.select("photo_id", F.posexplode("vectors").alias("face_index", "face_vector")).withColumn("face_vector", widened(F.col("face_vector")))


def first_writes(faces: DataFrame) -> DataFrame:
    """Faces with one row for each (photo, place): a photo that was worked on twice keeps one set."""
    return faces.dropDuplicates(["photo_id", "face_index"])
