"""SQL for DuckDB that says what each query returns, written apart from the queries."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-01-15 00:00:00'"

_USERS = "users AS (SELECT c_custkey AS id, c_name AS username, concat(lower(c_name), '@example.com') AS email FROM customer)"
_PHOTOS = """base_photos AS (
  SELECT event_id AS id, user_id, concat('u', CAST(user_id AS VARCHAR), '-', replace(CAST(CAST(ts AS DATE) AS VARCHAR), '-', '')) AS batch_id,
         concat('IMG_', CAST(event_id AS VARCHAR), '.jpg') AS original_file_name,
         CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'PROCESSING' WHEN 'view' THEN 'PROCESSED' WHEN 'error' THEN 'FAILED' ELSE 'NO_FACE_DETECTED' END AS status,
         ts AS upload_time,
         CASE WHEN event_type = 'click' AND event_id % 7 <> 0 THEN ts + INTERVAL 1 MINUTE END AS processing_started_at,
         CASE WHEN event_type = 'view' THEN ts + INTERVAL 5 MINUTE END AS processed_time,
         CASE WHEN event_type = 'error' THEN 'Could not load image' WHEN event_type = 'purchase' THEN 'No face detected in image' END AS error_message
  FROM events),
photos AS (SELECT *, upper(substr(md5(batch_id), 1, 6)) AS access_code, batch_id || '/' || CAST(id AS VARCHAR) || '.jpg' AS file_path FROM base_photos)"""
_FACES = """search_photos AS (
  SELECT CAST(floor(vec_id / 3) AS BIGINT) AS id, upper(substr(md5(CAST(min_by(label, vec_id) AS VARCHAR)), 1, 6)) AS access_code,
         CASE WHEN CAST(floor(vec_id / 3) AS BIGINT) % 5 = 4 THEN 'PENDING' ELSE 'PROCESSED' END AS status,
         'IMG_' || CAST(CAST(floor(vec_id / 3) AS BIGINT) AS VARCHAR) || '.jpg' AS original_file_name,
         '/images/' || CAST(CAST(floor(vec_id / 3) AS BIGINT) AS VARCHAR) || '.jpg' AS image_url,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(floor(vec_id / 3) AS BIGINT)) AS upload_time
  FROM embeddings GROUP BY CAST(floor(vec_id / 3) AS BIGINT)),
photo_faces AS (
  SELECT vec_id AS id, CAST(floor(vec_id / 3) AS BIGINT) AS photo_id, CASE WHEN vec_id % 50 <> 49 THEN CAST(embedding AS DOUBLE[]) END AS face_vector FROM embeddings),
queries AS (
  SELECT vec_id AS query_id, access_code, CAST(embedding AS DOUBLE[]) AS vector
  FROM embeddings JOIN search_photos s ON s.id = CAST(floor(vec_id / 3) AS BIGINT) WHERE vec_id % 50 = 0),
pairs AS (
  SELECT q.query_id, f.id AS face_id, f.photo_id, list_distance(f.face_vector, q.vector) AS distance
  FROM photo_faces f JOIN search_photos p ON f.photo_id = p.id AND p.status = 'PROCESSED' JOIN queries q ON q.access_code = p.access_code
  WHERE f.face_vector IS NOT NULL)"""
_ROLLUP = f"""{_PHOTOS},
counts AS (
  SELECT batch_id, count(*) AS photo_count, count(*) FILTER (status = 'PROCESSED') AS processed_count, count(*) FILTER (status = 'NO_FACE_DETECTED') AS no_face_count,
         count(*) FILTER (status = 'FAILED') AS failed_count, min_by(access_code, id) AS access_code, min_by(upload_time, id) AS upload_time
  FROM photos WHERE batch_id IS NOT NULL GROUP BY batch_id),
rolled AS (
  SELECT *, CASE WHEN processed_count + no_face_count + failed_count <> photo_count THEN 'PROCESSING' WHEN failed_count = photo_count THEN 'FAILED'
                 WHEN processed_count = 0 AND no_face_count > 0 THEN 'NO_FACES_FOUND' ELSE 'PROCESSED' END AS status FROM counts)"""
_LISTED = "batch_id, photo_count, processed_count, no_face_count, status, access_code, upload_time"
_FILES = f"""{_PHOTOS},
files AS (
  SELECT batch_id AS request_id, CAST(id AS VARCHAR) AS file_id, user_id, original_file_name AS name, batch_id, access_code,
         CASE WHEN id % 97 = 0 THEN 'image/gif' WHEN id % 89 = 0 THEN NULL WHEN id % 2 = 0 THEN 'IMAGE/JPEG' ELSE 'image/png' END AS content_type,
         status <> 'FAILED' AS stored, id * 7919 % 12000000 AS bytes
  FROM photos)"""
_NAMES = f"""{_PHOTOS},
names AS (
  SELECT id, batch_id, CASE id % 5 WHEN 0 THEN 'a.b.' || status WHEN 1 THEN 'noext' WHEN 2 THEN 'a.' WHEN 3 THEN original_file_name END AS name FROM photos),
extensions AS (SELECT *, CASE WHEN contains(name, '.') THEN '.' || list_last(string_split(name, '.')) ELSE '.jpg' END AS extension FROM names),
paths AS (SELECT id, batch_id || '/' || md5(CAST(id AS VARCHAR)) || extension AS path FROM extensions)"""


#: One account after the other, with the names and addresses that were taken so far.
_REGISTERED = f"""{_USERS},
asked AS (
  SELECT id AS ordinal, row_number() OVER (ORDER BY id) AS n,
         CASE WHEN id % 20 = 0 THEN username WHEN id % 4 = 1 THEN 'pair' || CAST(id // 8 AS VARCHAR) ELSE 'new' || CAST(id AS VARCHAR) END AS username,
         CASE WHEN id % 30 = 0 THEN email WHEN id % 3 = 1 THEN CAST(id // 9 AS VARCHAR) || '@shared.example.com' ELSE CAST(id AS VARCHAR) || '@new.example.com' END AS email
  FROM users),
new AS (SELECT *, username IN (SELECT username FROM users) AS old_name, email IN (SELECT email FROM users) AS old_mail FROM asked),
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS mails, CAST(NULL AS BIGINT) AS ordinal, CAST(NULL AS VARCHAR) AS username, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS result
  UNION ALL
  SELECT n, CASE WHEN result = 'created' THEN list_append(names, username) ELSE names END, CASE WHEN result = 'created' THEN list_append(mails, email) ELSE mails END, ordinal, username, email, result
  FROM (SELECT new.n, names, mails, new.ordinal, new.username, new.email,
               CASE WHEN old_name OR list_contains(names, new.username) THEN 'username taken' WHEN old_mail OR list_contains(mails, new.email) THEN 'email taken' ELSE 'created' END AS result
        FROM walk JOIN new ON new.n = walk.n + 1))"""


def _photos(select: str) -> str:
    return f"WITH {_PHOTOS} {select}"


def _faces(select: str) -> str:
    return f"WITH {_FACES} {select}"


def _found(threshold: str) -> str:
    return _faces(f"SELECT id, original_file_name, upload_time, image_url FROM search_photos WHERE id IN (SELECT photo_id FROM pairs WHERE query_id = 0 AND distance < {threshold})")


_TOTAL = "(SELECT count(DISTINCT photo_id) AS total_matches FROM pairs WHERE query_id = 0 AND distance < 1.3)"

ORACLES: dict[str, str] = {
    "face_search_scoped": _found("1.3"),
    "face_search_literal": _found("1.3"),
    "face_search_default_threshold": _found("0.6"),
    "face_search_stored": _found("1.3"),
    "face_search_response": _faces("SELECT count(*) OVER () AS total_matches, id, original_file_name, upload_time, image_url FROM search_photos WHERE id IN (SELECT photo_id FROM pairs WHERE query_id = 0 AND distance < 1.3)"),
    "face_search_response_row": _faces("""SELECT count(*) AS total_matches, coalesce(string_agg(CAST(id AS VARCHAR) || '|' || original_file_name || '|' || image_url, ',' ORDER BY id), '') AS photos
      FROM search_photos WHERE id IN (SELECT photo_id FROM pairs WHERE query_id = 0 AND distance < 1.3)"""),
    "face_search_multi_query": _faces("SELECT DISTINCT query_id, photo_id FROM pairs WHERE distance < 1.3"),
    "face_search_envelope": _faces(f"SELECT total_matches FROM {_TOTAL}"),
    "face_search_message": _faces(f"SELECT 'Found ' || CAST(total_matches AS VARCHAR) || ' photo' || CASE WHEN total_matches <> 1 THEN 's' ELSE '' END AS message FROM {_TOTAL}"),
    "faces_join_photos": _faces("SELECT f.id AS face_id, p.id AS photo_id, access_code, status FROM photo_faces f JOIN search_photos p ON f.photo_id = p.id"),
    "faces_per_photo": _faces("SELECT photo_id, count(*) AS faces, count(face_vector) AS vectors FROM photo_faces GROUP BY photo_id"),
    "distance_matrix_scoped": _faces("SELECT face_id, CAST(round(distance * 1000000) AS BIGINT) AS distance_millionths FROM pairs WHERE query_id = 0"),
    "vector_csv_roundtrip": _faces("SELECT id, CAST(len(face_vector) AS INTEGER) AS components, CAST(round(list_sum(face_vector) * 1000000) AS BIGINT) AS sum_millionths FROM photo_faces WHERE face_vector IS NOT NULL"),
    "vector_quantized": _faces("SELECT id, CAST(len(face_vector) AS INTEGER) AS components, true AS near FROM photo_faces WHERE face_vector IS NOT NULL"),
    "batch_rollup": f"WITH {_ROLLUP} SELECT {_LISTED} FROM rolled",
    "batch_status_histogram": f"WITH {_ROLLUP} SELECT status, count(*) AS batches FROM rolled GROUP BY status",
    "my_batches_for_user": f"WITH {_ROLLUP} SELECT {_LISTED} FROM rolled WHERE batch_id IN (SELECT batch_id FROM photos WHERE user_id = 7)",
    "batch_status_label": f"""WITH {_ROLLUP},
      said AS (SELECT *, concat_ws(', ', CASE WHEN processed_count > 0 THEN CAST(processed_count AS VARCHAR) || ' faces found' END,
                 CASE WHEN no_face_count > 0 THEN CAST(no_face_count AS VARCHAR) || ' skipped (no face)' END,
                 CASE WHEN photo_count - processed_count - no_face_count > 0 THEN 'some failed' END) AS parts FROM rolled)
      SELECT batch_id, CASE status WHEN 'FAILED' THEN 'Failed (System Error)' WHEN 'PROCESSING' THEN CAST(processed_count + no_face_count AS VARCHAR) || ' / ' || CAST(photo_count AS VARCHAR) || ' processed'
                       ELSE CASE parts WHEN '' THEN 'Finished' ELSE parts END END AS label,
             CASE status WHEN 'PROCESSED' THEN 'done' WHEN 'FAILED' THEN 'error' WHEN 'NO_FACES_FOUND' THEN 'warning' ELSE 'running' END AS icon
      FROM said""",
    "distinct_batches": _photos("SELECT DISTINCT batch_id FROM photos WHERE user_id = 7 AND batch_id IS NOT NULL"),
    "photos_by_batch": _photos("SELECT id, original_file_name, upload_time, status, '/images/' || file_path AS image_url FROM photos WHERE batch_id = (SELECT batch_id FROM photos WHERE id = 0)"),
    "photos_by_status": _photos("SELECT id, batch_id, error_message FROM photos WHERE status = 'FAILED'"),
    "photos_of_owner": f"WITH {_USERS}, {_PHOTOS} SELECT photos.id, batch_id FROM photos JOIN users ON photos.user_id = users.id WHERE users.id = 7",
    "pending_count": _photos("SELECT count(*) AS pending FROM photos WHERE status = 'PENDING'"),
    "claim_pending": _photos("SELECT id, file_path FROM photos WHERE status = 'PENDING' ORDER BY id LIMIT 5"),
    "claim_pending_update": _photos(f"""SELECT status, count(*) AS photos, count(*) FILTER (began = {NOW}) AS started_now FROM (
      SELECT CASE WHEN c.id IS NULL THEN p.status ELSE 'PROCESSING' END AS status, CASE WHEN c.id IS NULL THEN p.processing_started_at ELSE {NOW} END AS began
      FROM photos p LEFT JOIN (SELECT id FROM photos WHERE status = 'PENDING' ORDER BY id LIMIT 5) c ON p.id = c.id) GROUP BY status"""),
    "stale_photos": _photos(f"SELECT id, processing_started_at FROM photos WHERE status = 'PROCESSING' AND processing_started_at < {NOW} - INTERVAL 10 MINUTE"),
    "reset_stale": _photos(f"""SELECT id, CASE WHEN stale THEN 'PENDING' ELSE status END AS status, CASE WHEN NOT stale THEN processing_started_at END AS processing_started_at
      FROM (SELECT *, coalesce(status = 'PROCESSING' AND processing_started_at < {NOW} - INTERVAL 10 MINUTE, false) AS stale FROM photos)"""),
    "reset_stale_count": _photos(f"SELECT count(*) AS reset FROM photos WHERE status = 'PROCESSING' AND processing_started_at < {NOW} - INTERVAL 10 MINUTE"),
    "complete_photos": _photos(f"SELECT id, CASE WHEN id % 10 = 0 THEN 'PROCESSED' ELSE status END AS status, CASE WHEN id % 10 = 0 THEN {NOW} ELSE processed_time END AS processed_time FROM photos"),
    "fail_photos": _photos("""SELECT id, CASE WHEN id % 20 = 3 THEN 'NO_FACE_DETECTED' WHEN id % 10 = 3 THEN 'FAILED' ELSE status END AS status,
      CASE WHEN id % 20 = 3 THEN 'No face detected in image' WHEN id % 10 = 3 THEN 'no face detected' ELSE error_message END AS error_message FROM photos"""),
    "update_status": _photos("SELECT id, CASE WHEN id = 5 THEN 'FAILED' ELSE status END AS status FROM photos"),
    "status_domain_check": _photos("SELECT id, CASE WHEN id % 100 = 0 THEN 'LOST' END AS status FROM photos WHERE id % 100 < 2"),
    "classify_errors": _photos("SELECT id, CASE WHEN contains(error_message, 'No face detected') THEN 'NO_FACE_DETECTED' ELSE 'FAILED' END AS status, error_message FROM photos WHERE error_message IS NOT NULL"),
    "current_status_from_log": _photos("""SELECT id AS photo_id, status, processing_started_at AS started_at, processed_time AS processed_at, error_message AS error FROM photos"""),
    "cascade_delete": _faces("SELECT id, photo_id FROM photo_faces WHERE photo_id NOT IN (SELECT id FROM search_photos WHERE status = 'PENDING')"),
    "cascade_delete_users": _faces("SELECT id, photo_id FROM photo_faces WHERE photo_id % 10 % 2 = 1"),
    "access_code_collisions": _photos("SELECT substr(access_code, 1, 3) AS access_code, count(DISTINCT batch_id) AS batches FROM photos GROUP BY 1 HAVING count(DISTINCT batch_id) > 1"),
    "upload_validation": f"""WITH {_FILES},
      judged AS (SELECT request_id, bool_and(coalesce(lower(content_type) IN ('image/jpeg', 'image/png', 'image/jpg'), false) AND bytes <= 10485760) AND sum(bytes) <= 52428800 AS accepted,
                        count(*) AS total_files, count(*) FILTER (stored) AS n FROM files GROUP BY request_id)
      SELECT request_id, accepted, total_files, CASE WHEN accepted THEN n ELSE 0 END AS successful_uploads FROM judged""",
    "upload_empty_requests": f"""WITH {_FILES},
      judged AS (SELECT request_id, bool_and(coalesce(lower(content_type) IN ('image/jpeg', 'image/png', 'image/jpg'), false) AND bytes <= 10485760) AND sum(bytes) <= 52428800 AS accepted,
                        count(*) AS total_files, count(*) FILTER (stored) AS n FROM files WHERE user_id % 2 = 1 GROUP BY request_id)
      SELECT r.request_id, coalesce(accepted, false) AS accepted, coalesce(total_files, 0) AS total_files, CASE WHEN accepted THEN n ELSE 0 END AS successful_uploads
      FROM (SELECT DISTINCT batch_id AS request_id FROM photos) r LEFT JOIN judged j ON r.request_id = j.request_id""",
    "upload_envelope": f"""WITH {_FILES} SELECT request_id, count(*) AS total_files, count(*) FILTER (stored) AS successful_uploads,
      max(batch_id) FILTER (stored) AS batch_id, max(access_code) FILTER (stored) AS access_code FROM files GROUP BY request_id""",
    "upload_insert": f"""WITH {_FILES} SELECT user_id, batch_id || '/' || file_id || '.jpg' AS file_path, name AS original_file_name, batch_id, access_code, 'PENDING' AS status, {NOW} AS upload_time FROM files WHERE stored""",
    "file_extension": f"WITH {_NAMES} SELECT id, extension FROM extensions",
    "stored_path": f"WITH {_NAMES} SELECT id, path, '/images/' || path AS url, '/var/uploads/' || path AS absolute FROM paths",
    "access_code_derivation": _photos("SELECT DISTINCT batch_id, upper(substr(md5(batch_id), 1, 6)) AS access_code, 'temp_search_' || substr(md5(batch_id), 1, 8) AS scope FROM photos"),
    "access_code_normalize": _photos("SELECT id, upper(trim('  ' || lower(access_code) || ' ')) AS access_code FROM photos"),
    "registration_conflicts": f"WITH RECURSIVE {_REGISTERED} SELECT ordinal, username, email, result FROM walk WHERE ordinal IS NOT NULL",
    "registration_insert": f"WITH RECURSIVE {_REGISTERED} SELECT ordinal + 10000000 AS id, username, md5(CAST(ordinal AS VARCHAR)) AS password, email FROM walk WHERE result = 'created'",
    "user_by_username": f"WITH {_USERS} SELECT id, username, email FROM users WHERE username = 'Customer#000000007'",
    "user_by_email": f"WITH {_USERS} SELECT id, username, email FROM users WHERE email = 'customer#000000007@example.com'",
    "token_expiry": _photos(f"SELECT id, user_id AS subject, upload_time + INTERVAL 10 HOUR AS expires_at FROM photos WHERE upload_time + INTERVAL 10 HOUR >= {NOW}"),
    "token_validity": f"WITH {_USERS}, {_PHOTOS} SELECT photos.id, username AS subject FROM photos JOIN users ON photos.user_id = users.id WHERE photos.id % 3 <> 0 AND upload_time + INTERVAL 10 HOUR >= {NOW}",
    "explode_faces": "SELECT CAST(floor(vec_id / 3) AS BIGINT) AS photo_id, vec_id % 3 AS face_index, CAST(len(embedding) AS INTEGER) AS components FROM embeddings",
    "response_text": _photos("""SELECT id, CASE WHEN id % 2 = 0 THEN error_message END AS payload, batch_id AS token, error_message || chr(9) AS trimmed, 'it''''s ' || batch_id AS escaped
      FROM photos WHERE error_message IS NOT NULL"""),
    "first_face": _faces("""SELECT photo_id, CAST(len(min_by(face_vector, id)) AS INTEGER) AS components, CAST(round(min_by(face_vector, id)[1] * 1000000) AS BIGINT) AS first_millionths
      FROM photo_faces WHERE face_vector IS NOT NULL GROUP BY photo_id"""),
    "stale_rows": _photos(f"SELECT id AS photo_id, 'PENDING' AS status, CAST(NULL AS VARCHAR) AS error FROM photos WHERE status = 'PROCESSING' AND processing_started_at < {NOW} - INTERVAL 10 MINUTE"),
    "stream_lease_expiry": _photos(f"SELECT id AS photo_id, CAST(3 AS BIGINT) AS seq, 'PENDING' AS status FROM photos WHERE status = 'PROCESSING' AND processing_started_at < {NOW} - INTERVAL 10 MINUTE"),
    "stream_ingest_faces": """SELECT id AS photo_id, status, error, CASE WHEN status = 'PROCESSED' THEN true END AS in_order, CAST(CASE WHEN status = 'PROCESSED' THEN id % 5 ELSE 0 END AS BIGINT) AS faces
      FROM (SELECT DISTINCT CAST(floor(vec_id / 3) AS BIGINT) AS id FROM embeddings),
           (VALUES (0, 'FAILED', 'Could not load image'), (1, 'PROCESSED', NULL), (2, 'PROCESSED', NULL), (3, 'PROCESSED', NULL), (4, 'NO_FACE_DETECTED', 'No face detected in image')) AS outcome(rest, status, error)
      WHERE id % 5 = rest""",
    "photo_json": _photos("""SELECT '{"id":' || CAST(id AS VARCHAR) || ',"batch_id":"' || batch_id || '","status":"' || status || '","shown":"' || strftime(upload_time, '%Y-%m-%d %H:%M:%S') || '"}' AS json FROM photos"""),
}
