"""The registered queries, one an operator or more, and the flagship."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimset.functions import text as X
from glimset.functions import vectors as V
from glimset.operators import batches, ingest, lifecycle, search
from glimset.schemas import IMAGE_TYPES, STATUS_LOG, TOKEN_MILLIS
from glimset.sources import adapters as A
from glimset.sources.files import as_json, image_stream
from glimset.sources.shared import put_all, removed, setting, shared_path, written
from glimset.streaming import extract, leases

NOW = "2024-01-15 00:00:00"
WIDE = 1.3


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def long(c):
    return c.cast("long")


def _found(s: SparkSession, d: str, threshold: float = WIDE) -> DataFrame:
    """The photos in the scope of photo 0 near vector 0: what a request with both finds."""
    return search.matches(A.search_photos(s, d), A.photo_faces(s, d), *A.request(s, d), threshold, None)


def face_search(s: SparkSession, d: str, threshold: float = WIDE) -> DataFrame:
    """The flagship."""
    return search.result(_found(s, d, threshold))


def face_search_default_threshold(s: SparkSession, d: str) -> DataFrame:
    return face_search(s, d, 0.6)


def face_search_literal(s: SparkSession, d: str) -> DataFrame:
    """The same search with the vector as it comes from an extractor: checked text of 64 components."""
    vector, code = A.request(s, d)
    asked = s.createDataFrame([(",".join(map(repr, vector)),)], "body string").select(V.parse_csv(F.col("body"), 64)).first()[0]
    return search.search(A.search_photos(s, d), A.photo_faces(s, d), asked, code, WIDE, 64)


def face_search_stored(s: SparkSession, d: str) -> DataFrame:
    """The same search over faces that are stored by code."""
    path = shared_path(s, "faces")
    search.write_faces(A.photo_faces(s, d), A.search_photos(s, d), path)
    return search.search(A.search_photos(s, d), search.read_faces(s, path), *A.request(s, d), WIDE, None)


def face_search_multi_query(s: SparkSession, d: str) -> DataFrame:
    return search.range_search(A.search_photos(s, d), A.photo_faces(s, d), A.vector_queries(s, d), WIDE)


def face_search_envelope(s: SparkSession, d: str) -> DataFrame:
    return search.total_matches(_found(s, d))


def face_search_response(s: SparkSession, d: str) -> DataFrame:
    """Count and photos, as rows."""
    return search.response(_found(s, d))


def face_search_response_row(s: SparkSession, d: str) -> DataFrame:
    """Count and photos, as one row; the photos as text."""
    photo = lambda p: F.concat_ws("|", p["id"].cast("string"), p["original_file_name"], p["image_url"])
    return search.envelope(face_search(s, d)).select("total_matches", F.array_join(F.transform("photos", photo), ",").alias("photos"))


def face_search_message(s: SparkSession, d: str) -> DataFrame:
    return face_search_envelope(s, d).select(F.concat(F.lit("Found "), X.counted(F.col("total_matches"), "photo")).alias("message"))


def faces_join_photos(s: SparkSession, d: str) -> DataFrame:
    return search.faces_with_photos(A.photo_faces(s, d), A.search_photos(s, d)).drop("face_vector")


def faces_per_photo(s: SparkSession, d: str) -> DataFrame:
    return A.photo_faces(s, d).groupBy("photo_id").agg(F.count(F.lit(1)).alias("faces"), F.count("face_vector").alias("vectors"))


def distance_matrix_scoped(s: SparkSession, d: str) -> DataFrame:
    asked = A.vector_queries(s, d).filter("query_id = 0")
    found = search.distances(A.search_photos(s, d), A.photo_faces(s, d), asked)
    return found.select("face_id", long(F.round(F.col("distance") * 1_000_000)).alias("distance_millionths"))


def vector_csv_roundtrip(s: SparkSession, d: str) -> DataFrame:
    v = V.parse_csv(V.to_csv(F.col("face_vector")), None)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return A.photo_faces(s, d).filter("face_vector IS NOT NULL").select("id", F.size(v).alias("components"), long(F.round(total * 1_000_000)).alias("sum_millionths"))


def vector_quantized(s: SparkSession, d: str) -> DataFrame:
    v = V.quantize_sig6(F.col("face_vector"))
    apart = F.aggregate(F.zip_with(v, "face_vector", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: F.greatest(a, x))
    return A.photo_faces(s, d).filter("face_vector IS NOT NULL").select("id", F.size(v).alias("components"), (apart < 1e-6).alias("near"))


def batch_rollup(s: SparkSession, d: str) -> DataFrame:
    return batches.listing(batches.rollup(A.photos(s, d)))


def batch_status_histogram(s: SparkSession, d: str) -> DataFrame:
    return batches.rollup(A.photos(s, d)).groupBy("status").agg(F.count(F.lit(1)).alias("batches"))


def my_batches_for_user(s: SparkSession, d: str) -> DataFrame:
    return batches.rollup_of_user(A.photos(s, d), 7)


def batch_status_label(s: SparkSession, d: str) -> DataFrame:
    return batches.labelled(batches.rollup(A.photos(s, d)))


def distinct_batches(s: SparkSession, d: str) -> DataFrame:
    return batches.batches_of(A.photos(s, d), 7)


def photos_by_batch(s: SparkSession, d: str) -> DataFrame:
    photos = A.photos(s, d)
    batch = photos.filter("id = 0").select("batch_id").first()[0]
    return batches.photos_of_batch(photos, batch)


def photos_by_status(s: SparkSession, d: str) -> DataFrame:
    return lifecycle.with_status(A.photos(s, d), "FAILED").select("id", "batch_id", "error_message")


def photos_of_owner(s: SparkSession, d: str) -> DataFrame:
    name = A.users(s, d).filter("id = 7").first().username
    return search.owner_photos(A.photos(s, d), A.users(s, d), name).select("id", "batch_id")


def pending_count(s: SparkSession, d: str) -> DataFrame:
    return batches.pending_count(A.photos(s, d))


def claim_pending(s: SparkSession, d: str) -> DataFrame:
    return lifecycle.claim(A.photos(s, d))


def claim_pending_update(s: SparkSession, d: str) -> DataFrame:
    photos = A.photos(s, d)
    return lifecycle.claimed(photos, lifecycle.claim(photos), now()).groupBy("status").agg(F.count(F.lit(1)).alias("photos"), F.count_if(F.col("processing_started_at") == now()).alias("started_now"))


def stale_photos(s: SparkSession, d: str) -> DataFrame:
    return lifecycle.stale(A.photos(s, d), now()).select("id", "processing_started_at")


def reset_stale(s: SparkSession, d: str) -> DataFrame:
    return lifecycle.reset_stale(A.photos(s, d), now()).select("id", "status", "processing_started_at")


def reset_stale_count(s: SparkSession, d: str) -> DataFrame:
    return lifecycle.stale_count(A.photos(s, d), now())


def complete_photos(s: SparkSession, d: str) -> DataFrame:
    photos = A.photos(s, d)
    return lifecycle.completed(photos, photos.filter("id % 10 = 0").select("id"), now()).select("id", "status", "processed_time")


def fail_photos(s: SparkSession, d: str) -> DataFrame:
    photos = A.photos(s, d)
    errors = photos.filter("id % 10 = 3").select("id", F.when(F.col("id") % 20 == 3, "No face detected in image").otherwise("no face detected").alias("error"))
    return lifecycle.failed(photos, errors).select("id", "status", "error_message")


def update_status(s: SparkSession, d: str) -> DataFrame:
    return lifecycle.status_set(A.photos(s, d), 5, "FAILED").select("id", "status")


def status_domain_check(s: SparkSession, d: str) -> DataFrame:
    odd = A.photos(s, d).withColumn("status", F.when(F.col("id") % 100 == 0, "LOST").when(F.col("id") % 100 != 1, F.col("status")))
    return lifecycle.bad_statuses(odd).select("id", "status")


def classify_errors(s: SparkSession, d: str) -> DataFrame:
    return lifecycle.error_changes(A.photos(s, d).filter("error_message IS NOT NULL").select("id", F.col("error_message").alias("error")))


def current_status_from_log(s: SparkSession, d: str) -> DataFrame:
    return lifecycle.current(lifecycle.log_of(A.photos(s, d))).select("photo_id", "status", "started_at", "processed_at", "error")


def cascade_delete(s: SparkSession, d: str) -> DataFrame:
    gone = A.search_photos(s, d).filter("status = 'PENDING'").select("id")
    return lifecycle.without_photos(A.photo_faces(s, d), gone).select("id", "photo_id")


def cascade_delete_users(s: SparkSession, d: str) -> DataFrame:
    """The faces that are left when users go, and with them their photos."""
    owned = A.search_photos(s, d).withColumn("user_id", F.col("id") % 10)
    gone = owned.select((F.col("user_id")).alias("id")).filter("id % 2 = 0")
    left = lifecycle.without_users(owned, gone)
    return lifecycle.without_photos(A.photo_faces(s, d), owned.join(left.select("id"), "id", "left_anti")).select("id", "photo_id")


def access_code_collisions(s: SparkSession, d: str) -> DataFrame:
    return batches.code_collisions(A.photos(s, d).withColumn("access_code", F.substring("access_code", 1, 3)))


def files(s: SparkSession, d: str) -> DataFrame:
    """Requests with files made of events: a request an hour of a user."""
    kind = F.when(F.col("id") % 97 == 0, "image/gif").when(F.col("id") % 89 == 0, F.lit(None)).when(F.col("id") % 2 == 0, "IMAGE/JPEG").otherwise(IMAGE_TYPES[1])
    return A.photos(s, d).select(
        F.col("batch_id").alias("request_id"), F.col("id").cast("string").alias("file_id"), "user_id", F.col("original_file_name").alias("name"), kind.alias("content_type"),
        (F.col("status") != "FAILED").alias("stored"), (F.col("id") * 7919 % 12_000_000).alias("bytes"), "batch_id", "access_code",
    )


def upload_validation(s: SparkSession, d: str) -> DataFrame:
    return ingest.validated(files(s, d))


def upload_empty_requests(s: SparkSession, d: str) -> DataFrame:
    """The batches as requests, of which those of even users come without files."""
    asked = A.photos(s, d).select(F.col("batch_id").alias("request_id"))
    return ingest.validated(files(s, d).filter("user_id % 2 = 1"), asked)


def upload_envelope(s: SparkSession, d: str) -> DataFrame:
    return ingest.upload_envelope(files(s, d).filter("stored"), files(s, d))


def upload_insert(s: SparkSession, d: str) -> DataFrame:
    drawn = files(s, d).select("request_id", "batch_id", "access_code").distinct()
    return ingest.new_photos(files(s, d).drop("batch_id", "access_code"), drawn, now())


def odd_names(s: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("id") % 5 == 0, F.concat(F.lit("a.b."), F.col("status"))).when(F.col("id") % 5 == 1, "noext").when(F.col("id") % 5 == 2, "a.").when(F.col("id") % 5 == 3, F.col("original_file_name"))
    return A.photos(s, d).select("id", "batch_id", name.alias("name"))


def file_extension(s: SparkSession, d: str) -> DataFrame:
    return odd_names(s, d).select("id", X.file_extension(F.col("name")).alias("extension"))


def stored_path(s: SparkSession, d: str) -> DataFrame:
    path = X.stored_path(F.col("batch_id"), F.md5(F.col("id").cast("string")), F.col("name"))
    return odd_names(s, d).select("id", path.alias("path"), X.image_url(path).alias("url"), X.absolute_path(path).alias("absolute"))


def access_code_derivation(s: SparkSession, d: str) -> DataFrame:
    return A.photos(s, d).select("batch_id", X.derived_access_code(F.col("batch_id")).alias("access_code"), X.search_scope(F.md5("batch_id")).alias("scope")).distinct()


def access_code_normalize(s: SparkSession, d: str) -> DataFrame:
    typed = F.concat(F.lit("  "), F.lower("access_code"), F.lit(" "))
    return A.photos(s, d).select("id", X.normalized_access_code(typed).alias("access_code"))


def _new_accounts(s: SparkSession, d: str) -> DataFrame:
    """An account for each user, some with a name or an address that is taken or asked for several times."""
    k = F.col("id")
    name = F.when(k % 20 == 0, F.col("username")).when(k % 4 == 1, F.concat(F.lit("pair"), F.floor(k / 8).cast("string"))).otherwise(F.concat(F.lit("new"), k.cast("string")))
    mail = F.when(k % 30 == 0, F.col("email")).when(k % 3 == 1, F.concat(F.floor(k / 9).cast("string"), F.lit("@shared.example.com"))).otherwise(F.concat(k.cast("string"), F.lit("@new.example.com")))
    return A.users(s, d).select(k.alias("ordinal"), name.alias("username"), mail.alias("email"))


def registration_conflicts(s: SparkSession, d: str) -> DataFrame:
    return ingest.registrations(_new_accounts(s, d), A.users(s, d))


def registration_insert(s: SparkSession, d: str) -> DataFrame:
    """The users to append, with the digests that they came with."""
    digests = _new_accounts(s, d).select("ordinal", F.md5(F.col("ordinal").cast("string")).alias("password"))
    return ingest.new_users(registration_conflicts(s, d), digests, 10_000_000)


def user_by_username(s: SparkSession, d: str) -> DataFrame:
    return ingest.user_by(A.users(s, d), "username", "Customer#000000007")


def user_by_email(s: SparkSession, d: str) -> DataFrame:
    return ingest.user_by(A.users(s, d), "email", "customer#000000007@example.com")


def token_expiry(s: SparkSession, d: str) -> DataFrame:
    tokens = A.photos(s, d).select("id", F.col("user_id").alias("subject"), F.col("upload_time").alias("issued_at"))
    return ingest.unexpired(tokens, now(), TOKEN_MILLIS).select("id", "subject", "expires_at")


def token_validity(s: SparkSession, d: str) -> DataFrame:
    """Tokens with the name of their user, but on each third that of another."""
    tokens = A.photos(s, d).join(A.users(s, d).select(F.col("id").alias("user_id"), "username"), "user_id")
    tokens = tokens.select("id", "user_id", F.when(F.col("id") % 3 == 0, "someone").otherwise(F.col("username")).alias("subject"), F.col("upload_time").alias("issued_at"))
    return ingest.valid_tokens(tokens, A.users(s, d), now(), TOKEN_MILLIS).select("id", "subject")


def explode_faces(s: SparkSession, d: str) -> DataFrame:
    e = A.table(s, d, "embeddings")
    groups = e.groupBy(F.floor(F.col("vec_id") / 3).cast("long").alias("photo_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    found = ingest.exploded_faces(groups.select("photo_id", F.col("v.embedding").alias("vectors")))
    return ingest.first_writes(found.union(found.filter("photo_id % 2 = 0"))).select("photo_id", long(F.col("face_index")).alias("face_index"), F.size("face_vector").alias("components"))


def response_text(s: SparkSession, d: str) -> DataFrame:
    """Rules for texts that arrive: error payloads, bearer headers, ends of lines, quotes."""
    p = A.photos(s, d).filter("error_message IS NOT NULL")
    body = F.when(F.col("id") % 2 == 0, F.concat(F.lit("ERROR: "), F.col("error_message"), F.lit(" "))).otherwise(F.col("error_message"))
    return p.select("id", X.error_payload(body).alias("payload"), X.bearer_token(F.concat(F.lit("Bearer "), F.col("batch_id"))).alias("token"), X.trimmed_end(F.concat("error_message", F.lit("\t \r\n"))).alias("trimmed"), X.escaped_quotes(F.concat(F.lit("it's "), F.col("batch_id"))).alias("escaped"))


def photo_json(s: SparkSession, d: str) -> DataFrame:
    return as_json(A.photos(s, d).select("id", "batch_id", "status", X.shown_time(F.col("upload_time")).alias("shown")))


def first_face(s: SparkSession, d: str) -> DataFrame:
    """The first face of each photo, of those that it has."""
    own = A.photo_faces(s, d).filter("face_vector IS NOT NULL").groupBy("photo_id").agg(F.sort_array(F.collect_list(F.struct("id", "face_vector"))).alias("v"))
    first = V.first_vector(F.col("v.face_vector"))
    return own.select("photo_id", F.size(first).alias("components"), long(F.round(F.get(first, 0) * 1_000_000)).alias("first_millionths"))


def stream_ingest_faces(s: SparkSession, d: str) -> DataFrame:
    """A small file for every photo that owns vectors, through the stream; what the log and the faces say afterwards."""
    home = shared_path(s, "stream")
    photos = A.search_photos(s, d).select("id", F.concat(F.lit("b"), (F.col("id") % 7).cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".jpg")).alias("file_path"))
    photos = written(photos, "stream-photos")
    # the files stand for those that users upload
    put_all(s, f"{home}/in", ((row.file_path, (b"!\x01\x02\x03\x04"[row.id % 5 :][:1]) + str(row.id).encode()) for row in photos.toLocalIterator()))
    with setting(s, "spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * s.sparkContext.defaultParallelism)):  # else Spark looks up a micro-batch's files in 10,000 tasks
        extract.start(image_stream(s, f"{home}/in", bytes_at_once=1 << 28), photos, extract.stand_in, f"{home}/faces", f"{home}/log", f"{home}/checkpoint", None).awaitTermination()
    faces = s.read.schema("photo_id long, face_index int, face_vector array<double>").parquet(f"{home}/faces").groupBy("photo_id").agg(F.count(F.lit(1)).alias("faces"))
    states = lifecycle.current(extract.read_log(s, f"{home}/log"))
    out = states.join(faces, "photo_id", "left").select("photo_id", "status", "error", (F.col("started_at") <= F.col("processed_at")).alias("in_order"), F.coalesce("faces", F.lit(0)).cast("long").alias("faces"))
    out = written(out, "stream-result")
    removed(s, home)
    return out


def stream_lease_expiry(s: SparkSession, d: str) -> DataFrame:
    """The status log of all photos through the stream of leases, at the fixed moment."""
    home = shared_path(s, "leases")
    lifecycle.log_of(A.photos(s, d)).write.parquet(f"{home}/in")
    moment = s.range(1).select(F.unix_micros(now().cast("timestamp")) / 1e6).first()[0]
    found = leases.expired(s.readStream.schema(STATUS_LOG).parquet(f"{home}/in"), now=moment)
    found.writeStream.option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start(f"{home}/out", "parquet").awaitTermination()
    out = written(s.read.schema(STATUS_LOG).parquet(f"{home}/out").select("photo_id", "seq", "status"), "leases-result")
    removed(s, home)
    return out


def stale_rows(s: SparkSession, d: str) -> DataFrame:
    """The same in the batch form."""
    return lifecycle.stale_rows(lifecycle.log_of(A.photos(s, d)), now()).select("photo_id", "status", "error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "face_search_scoped": face_search,
    **{f.__name__: f for f in (
        face_search_default_threshold, face_search_literal, face_search_stored, face_search_multi_query, face_search_envelope, face_search_response, face_search_response_row, face_search_message, faces_join_photos, faces_per_photo,
        distance_matrix_scoped, vector_csv_roundtrip, vector_quantized, batch_rollup, batch_status_histogram, my_batches_for_user, batch_status_label, distinct_batches,
        photos_by_batch, photos_by_status, photos_of_owner, pending_count, claim_pending, claim_pending_update, stale_photos, reset_stale, reset_stale_count,
        complete_photos, fail_photos, update_status, status_domain_check, classify_errors, current_status_from_log, cascade_delete, access_code_collisions,
        upload_validation, upload_envelope, upload_insert, file_extension, stored_path, access_code_derivation, access_code_normalize, registration_conflicts,
        registration_insert, user_by_username, user_by_email, token_expiry, token_validity, explode_faces, first_face, response_text, photo_json,
        upload_empty_requests, cascade_delete_users, stale_rows, stream_lease_expiry, stream_ingest_faces,
    )},
}
