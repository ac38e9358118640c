"""Schemas, states and limits."""

from __future__ import annotations

from pyspark.sql import types as T

PENDING, PROCESSING, PROCESSED, FAILED, NO_FACE = "PENDING", "PROCESSING", "PROCESSED", "FAILED", "NO_FACE_DETECTED"
STATUSES = (PENDING, PROCESSING, PROCESSED, FAILED, NO_FACE)
IMAGE_TYPES = ("image/jpeg", "image/png", "image/jpg")

THRESHOLD = 0.6
DIMENSION = 128
CLAIM_SIZE = 5
LEASE_MINUTES = 10
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_REQUEST_BYTES = 50 * 1024 * 1024
TOKEN_MILLIS = 36_000_000

VECTOR = T.ArrayType(T.DoubleType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


USERS = _struct(id=T.LongType(), username=T.StringType(), password=T.StringType(), email=T.StringType())
PHOTOS = _struct(
    id=T.LongType(), user_id=T.LongType(), file_path=T.StringType(), original_file_name=T.StringType(), batch_id=T.StringType(),
    access_code=T.StringType(), status=T.StringType(), upload_time=T.TimestampNTZType(), processed_time=T.TimestampNTZType(),
    processing_started_at=T.TimestampNTZType(), error_message=T.StringType(),
)
FACES = _struct(id=T.LongType(), photo_id=T.LongType(), face_vector=VECTOR)
#: Faces stored by access code; scope is the code's beginning, and the folder.
STORED_FACES = _struct(id=T.LongType(), photo_id=T.LongType(), face_vector=VECTOR, access_code=T.StringType(), scope=T.StringType())
#: Changes of photos' states, appended and never updated; seq rises with time for each photo.
STATUS_LOG = _struct(photo_id=T.LongType(), seq=T.LongType(), status=T.StringType(), started_at=T.TimestampNTZType(), processed_at=T.TimestampNTZType(), error=T.StringType())
#: What an extractor returns for a file: a row a face, or one row with an error and no vector.
EXTRACTED = _struct(path=T.StringType(), face_index=T.IntegerType(), face_vector=VECTOR, error=T.StringType())
