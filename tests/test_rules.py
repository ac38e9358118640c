"""Rules by hand-made cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glimset.functions import text as X
from glimset.functions import vectors as V
from glimset.operators import batches, ingest, lifecycle, search
from glimset.schemas import FACES, PHOTOS, STATUS_LOG


def photos(spark, *rows):
    """Photos from dicts."""
    return spark.createDataFrame([tuple(r.get(c) for c in PHOTOS.names) for r in rows], PHOTOS)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def vector(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_distance(spark):
    assert value(spark, V.euclidean(vector(0, 0), vector(3, 4))) == 5
    with pytest.raises(Exception, match="different lengths"):
        value(spark, V.euclidean(vector(0, 0), vector(3)))
    with pytest.raises(Exception, match="expected 128"):
        value(spark, V.with_dimension(vector(1, 2)))


def test_csv(spark):
    assert value(spark, V.parse_csv(F.lit(" 1, 2.5 ,-3,, "), None)) == [1, 2.5, -3]
    with pytest.raises(Exception, match="expected 3 components, found 2"):
        value(spark, V.parse_csv(F.lit("1,2"), 3))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        value(spark, V.parse_csv(F.lit("1,x"), None))
    assert value(spark, V.to_literal(vector(1, 2))) == "{1.0,2.0}"
    assert value(spark, V.quantize_sig6(vector(0.123456789))) == [0.123457]
    assert value(spark, V.first_vector(F.array().cast("array<array<double>>"))) is None


@pytest.mark.parametrize("name,extension", [("a.b.PNG", ".PNG"), ("noext", ".jpg"), (None, ".jpg"), ("a.", ".")])
def test_extension(spark, name, extension):
    assert value(spark, X.file_extension(F.lit(name).cast("string"))) == extension


@pytest.mark.parametrize("message,status", [("No face detected in image", "NO_FACE_DETECTED"), ("Could not load image", "FAILED"), ("no face detected", "FAILED"), (None, "FAILED")])
def test_classified_error(spark, message, status):
    assert value(spark, X.classified_error(F.lit(message).cast("string"))) == status


@pytest.mark.parametrize(
    "status,counts,label",
    [
        ("PROCESSED", (4, 2, 1), "2 faces found, 1 skipped (no face), some failed"),
        ("PROCESSED", (0, 0, 0), "Finished"),
        ("FAILED", (3, 0, 0), "Failed (System Error)"),
        ("PROCESSING", (5, 1, 2), "3 / 5 processed"),
        ("PROCESSING", (None, None, None), "0 / 0 processed"),
    ],
)
def test_status_label(spark, status, counts, label):
    assert value(spark, X.status_label(F.lit(status), *[F.lit(c).cast("long") for c in counts])) == label


def test_texts(spark):
    assert value(spark, X.trimmed_end(F.lit("a\t \r\n"))) == "a\t"
    assert value(spark, X.error_payload(F.lit("ERROR: no "))) == "no"
    assert value(spark, X.error_payload(F.lit("1,2"))) is None
    assert value(spark, X.bearer_token(F.lit("Basic x"))) is None
    assert value(spark, X.escaped_quotes(F.lit("it's"))) == "it''s"
    assert value(spark, X.normalized_access_code(F.lit(" ab12cd "))) == "AB12CD"
    assert value(spark, X.counted(F.lit(1), "photo")) == "1 photo"


@pytest.fixture()
def scene(spark):
    rows = [
        {"id": 1, "access_code": "AAAAAA", "status": "PROCESSED", "file_path": "b/1.jpg"},
        {"id": 2, "access_code": "AAAAAA", "status": "PROCESSED", "file_path": "b/2.jpg"},
        {"id": 3, "access_code": "AAAAAA", "status": "PENDING", "file_path": "b/3.jpg"},
        {"id": 4, "access_code": "BBBBBB", "status": "PROCESSED", "file_path": "b/4.jpg"},
        {"id": 5, "access_code": None, "status": "PROCESSED", "file_path": "b/5.jpg"},
    ]
    near, edge = [0.0, 0.1], [0.0, 0.5]
    faces = [(1, 1, near), (2, 1, near), (3, 1, None), (4, 2, edge), (5, 3, near), (6, 4, near), (7, 5, near), (8, 2, [0.0, float("nan")])]
    return photos(spark, *rows), spark.createDataFrame(faces, FACES)


def test_search(scene):
    found = search.search(*scene, [0.0, 0.0], "AAAAAA", 0.5, 2).collect()
    assert [(r.id, r.image_url) for r in found] == [(1, "/images/b/1.jpg")]  # once; the edge is outside
    assert search.search(*scene, [0.0, 0.0], "aaaaaa", dimension=2).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        search.search(*scene, [0.0], "AAAAAA", dimension=None).collect()
    with pytest.raises(ValueError, match="expected 128 components, found 2"):
        search.search(*scene, [0.0, 0.0], "AAAAAA")
    assert "0.125" not in plan_of(search.search(*scene, [0.125, 0.125], "AAAAAA", dimension=2))  # plans don't hold the vector


@pytest.mark.parametrize("most_broadcast", ["-1", "10m"])
def test_many_queries(spark, scene, most_broadcast):
    queries = spark.createDataFrame([(1, "AAAAAA", [0.0, 0.0]), (2, "BBBBBB", [9.0, 0.0]), (3, None, [0.0, 0.0])], "query_id long, access_code string, vector array<double>")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most_broadcast)
    try:
        found = search.distances(*scene, queries).filter("distance < 0.6").select("query_id", "photo_id").distinct().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted(map(tuple, found)) == [(1, 1), (1, 2)]


def test_envelope(scene):
    found = search.matches(*scene, [0.0, 0.0], "AAAAAA", dimension=2)
    row = search.envelope(search.result(found)).first()
    assert row.total_matches == 2 and [p.id for p in row.photos] == [1, 2]
    assert sorted((r.total_matches, r.id) for r in search.response(found).collect()) == [(2, 1), (2, 2)]
    none = search.envelope(search.result(found.limit(0)))
    assert none.schema == search.envelope(search.result(found)).schema and tuple(none.first()) == (0, [])


def test_stored_by_code(spark, scene, tmp_path):
    photos, faces = scene
    path = str(tmp_path / "faces")
    search.write_faces(faces, photos, path)
    stored = search.read_faces(spark, path)
    assert stored.count() == 7  # the photo without a code is in no scope
    assert [r.id for r in search.search(photos, stored, [0.0, 0.0], "AAAAAA", 0.5, 2).collect()] == [1]
    plan = plan_of(search.search(photos, stored, [0.0, 0.0], "AAAAAA", 0.5, 2))
    assert re.search(r"PartitionFilters: \[.*scope#\d+ = AA", plan) and re.search(r"PushedFilters: \[.*EqualTo\(access_code,AAAAAA\)", plan)
    queries = spark.createDataFrame([(1, "AAAAAA", [0.0, 0.0])], "query_id long, access_code string, vector array<double>")
    assert sorted(r.photo_id for r in search.range_search(photos, stored, queries).collect()) == [1, 2]


@pytest.mark.parametrize(
    "states,status",
    [
        (["FAILED", "FAILED"], "FAILED"),
        (["NO_FACE_DETECTED", "FAILED"], "NO_FACES_FOUND"),
        (["PROCESSED", "FAILED"], "PROCESSED"),
        (["PROCESSED", "PENDING"], "PROCESSING"),
        (["PROCESSED", "PROCESSING"], "PROCESSING"),
        (["PROCESSED", "NO_FACE_DETECTED"], "PROCESSED"),
    ],
)
def test_batch_status(spark, states, status):
    rows = [{"id": k, "batch_id": "b", "access_code": f"c{k}", "status": x} for k, x in enumerate(states)]
    rolled = batches.rollup(photos(spark, *rows, {"id": 9, "batch_id": None, "status": "FAILED"})).collect()
    assert [(r.batch_id, r.status, r.access_code) for r in rolled] == [("b", status, "c0")]


def test_shared_batch_counts_everyone(spark):
    df = photos(spark, {"id": 1, "user_id": 1, "batch_id": "b", "status": "FAILED"}, {"id": 2, "user_id": 2, "batch_id": "b", "status": "FAILED"})
    assert batches.rollup_of_user(df, 1).first().photo_count == 2


def test_leases(spark):
    import datetime as dt

    now = dt.datetime(2024, 1, 1, 12)
    at = lambda m: now - dt.timedelta(minutes=m)
    df = photos(spark, *[{"id": k, "status": s, "processing_started_at": t} for k, (s, t) in enumerate([("PROCESSING", at(11)), ("PROCESSING", at(10)), ("PROCESSING", None), ("PROCESSED", at(60))])])
    moment = F.lit(now).cast("timestamp_ntz")
    reset = lifecycle.reset_stale(df, moment).orderBy("id").collect()
    assert [r.status for r in reset] == ["PENDING", "PROCESSING", "PROCESSING", "PROCESSED"]
    assert [r.processing_started_at for r in reset] == [None, at(10), None, at(60)]
    assert lifecycle.stale_count(df, moment).first().reset == 1
    assert lifecycle.claim(df).count() == 0
    claimed = lifecycle.claimed(reset and lifecycle.reset_stale(df, moment), lifecycle.claim(lifecycle.reset_stale(df, moment)), moment).filter("id = 0").first()
    assert (claimed.status, claimed.processing_started_at) == ("PROCESSING", now)


def test_log(spark):
    rows = [(1, 1, "PENDING", None, None, None), (1, 3, "FAILED", None, None, "x"), (1, 2, "PROCESSING", None, None, None)]
    assert lifecycle.current(spark.createDataFrame(rows, STATUS_LOG)).first().status == "FAILED"


def test_unknown_names_are_errors(spark):
    df = photos(spark, {"id": 1, "user_id": 1})
    users = spark.createDataFrame([(1, "u")], "id long, username string")
    assert search.owner_photos(df, users, "u").count() == 1
    with pytest.raises(Exception, match="no such user"):
        search.owner_photos(df, users, "v").collect()
    with pytest.raises(ValueError):
        lifecycle.status_set(df, 1, "LOST")


def test_validation(spark):
    rows = [(1, "IMAGE/JPEG", True, 5), (1, "image/gif", True, 5), (2, "image/png", True, 5), (2, "image/jpg", False, 5), (3, None, True, 5), (4, "image/png", True, 11 << 20), *[(5, "image/png", True, 9 << 20)] * 6]
    found = ingest.validated(spark.createDataFrame(rows, "request_id int, content_type string, stored boolean, bytes long"))
    assert {r.request_id: (r.accepted, r.successful_uploads) for r in found.collect()} == {1: (False, 0), 2: (True, 1), 3: (False, 0), 4: (False, 0), 5: (False, 0)}
    asked = spark.createDataFrame([(2,), (6,)], "request_id int")
    files = spark.createDataFrame(rows, "request_id int, content_type string, stored boolean, bytes long")
    assert sorted(map(tuple, ingest.validated(files, asked).collect())) == [(2, True, 2, 1), (6, False, 0, 0)]


def test_tokens_and_users(spark):
    import datetime as dt

    users = spark.createDataFrame([(1, "u"), (2, "v")], "id long, username string")
    rows = [(1, "u", dt.datetime(2024, 1, 1, 2)), (1, "v", dt.datetime(2024, 1, 1, 2)), (2, "v", dt.datetime(2024, 1, 1, 1))]
    tokens = spark.createDataFrame(rows, "user_id long, subject string, issued_at timestamp_ntz")
    found = ingest.valid_tokens(tokens, users, F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"), 36_000_000).collect()
    assert [(r.user_id, r.subject) for r in found] == [(1, "u")]
    left = lifecycle.without_users(photos(spark, {"id": 1, "user_id": 1}, {"id": 2, "user_id": 2}, {"id": 3}), users.filter("id = 1"))
    assert sorted(r.id for r in left.collect()) == [2, 3]


def test_one_code_a_request(spark):
    df = spark.createDataFrame([(1, str(k), 7, "a.png", True) for k in range(5)], "request_id int, file_id string, user_id long, name string, stored boolean")
    made = ingest.new_photos(df, ingest.requests(df).cache(), F.current_timestamp()).collect()
    assert len({(r.batch_id, r.access_code) for r in made}) == 1 and len(made[0].access_code) == 6 and {r.file_path[-6:] for r in made} == {f"/{k}.png" for k in range(5)}


def test_registration(spark):
    users = spark.createDataFrame([(1, "a", "a@x")], "id long, username string, email string")
    new = spark.createDataFrame([(1, "a", "a@x"), (2, "b", "a@x"), (3, "c", "c@x"), (4, "c", "d@x"), (5, "e", "c@x")], "ordinal int, username string, email string")
    assert [r.result for r in ingest.registrations(new, users).orderBy("ordinal").collect()] == ["username taken", "email taken", "created", "username taken", "email taken"]
    # who is turned away takes neither name nor address
    new = spark.createDataFrame([(1, "a", "n@x"), (2, "b", "n@x"), (3, "q", "a@x"), (4, "q", "q@x")], "ordinal int, username string, email string")
    decided = ingest.registrations(new, users)
    assert [r.result for r in decided.orderBy("ordinal").collect()] == ["username taken", "created", "email taken", "created"]
    made = ingest.new_users(decided, spark.createDataFrame([(2, "x"), (4, "y")], "ordinal int, password string"), 100)
    assert sorted(map(tuple, made.collect())) == [(102, "b", "x", "n@x"), (104, "q", "y", "q@x")]
    assert ingest.registrations(new.limit(0), users).count() == 0


def test_registration_one_after_the_other(spark):
    rng = random.Random(11)
    users = [(k, f"n{k}", f"m{k}") for k in range(5)]
    pick = lambda c: None if rng.random() < 0.05 else f"{c}{rng.randrange(40)}"
    new = [(k, pick("n"), pick("m")) for k in range(160)]
    names, mails, want = {u[1] for u in users}, {u[2] for u in users}, []
    for k, name, mail in new:
        if name in names or mail in mails:
            want.append((k, "username taken" if name in names else "email taken"))
            continue
        want.append((k, "created"))
        names |= {name} - {None}
        mails |= {mail} - {None}
    got = ingest.registrations(spark.createDataFrame(new, "ordinal long, username string, email string"), spark.createDataFrame(users, "id long, username string, email string"))
    assert sorted((r.ordinal, r.result) for r in got.collect()) == want


def plan_of(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_reach_the_scan(spark, scene, tmp_path):
    for df, name in zip(scene, ("photos", "faces"), strict=True):
        df.write.parquet(f"{tmp_path}/{name}")
    stored = [spark.read.parquet(f"{tmp_path}/{n}") for n in ("photos", "faces")]
    plan = plan_of(search.search(*stored, [0.0, 0.0], "AAAAAA", dimension=2))
    assert "EqualTo(access_code,AAAAAA)" in plan and "EqualTo(status,PROCESSED)" in plan and "IsNotNull(face_vector)" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan, plan
    roll = plan_of(batches.listing(batches.rollup(stored[0])))
    assert roll.count("\n") and len(re.findall(r"^\(\d+\) Exchange", roll, re.M)) == 1
    assert "error_message" not in re.search("ReadSchema: (.*)", roll)[1]
