"""Streams: replay, isolation of bad files, leases."""

import datetime as dt
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from glimset.sources.files import append_table, as_json, image_files, image_stream, read_table
from glimset.sources.shared import put_all
from glimset.operators import lifecycle
from glimset.schemas import FACES, STATUS_LOG
from glimset.streaming import extract, leases


CONTENTS = [b"\x01a", b"\x02b", b"\x03c", b"\x04d", b"!", b"\x05e", b"\x06f"]


def folder(tmp_path):
    """Seven files in folders of batches, and their photos but the last's."""
    for k, content in enumerate(CONTENTS):
        (tmp_path / "in" / f"b{k % 2}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"b{k % 2}" / f"{k}.{'jpg Jpg PNG'.split()[k % 3]}").write_bytes(content)
    (tmp_path / "in" / "b0" / "note.txt").write_bytes(b"no image")
    return [(k, f"b{k % 2}/{k}.{'jpg Jpg PNG'.split()[k % 3]}") for k in range(6)]


def test_stream_and_replay(spark, tmp_path):
    photos = spark.createDataFrame(folder(tmp_path), "id long, file_path string")
    faces, log = str(tmp_path / "faces"), str(tmp_path / "log")
    extract.start(image_stream(spark, str(tmp_path / "in")), photos, extract.stand_in, faces, log, str(tmp_path / "c"), None).awaitTermination()
    assert len([p for p in tmp_path.glob("faces/batch=*") if p.is_dir()]) == 2  # five files and two
    found = {r.photo_id: r for r in lifecycle.current(extract.read_log(spark, log)).collect()}
    assert sorted(found) == list(range(6))
    assert (found[3].status, found[3].error) == ("NO_FACE_DETECTED", "No face detected in image") and (found[4].status, found[4].error) == ("FAILED", "Could not load image")
    assert found[0].status == "PROCESSED" and found[0].started_at < found[0].processed_at and found[4].processed_at is None
    assert extract.read_log(spark, log).count() == 12  # a claim and an outcome each
    got = sorted((r.photo_id, r.face_index) for r in spark.read.parquet(faces).collect())
    assert got == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (5, 0)]
    assert [r.path[-8:] for r in spark.read.parquet(log + "-unmatched").collect()] == ["b0/6.jpg"]
    again = extract.extract(image_files(spark, str(tmp_path / "in")).filter("path NOT LIKE '%6.jpg' AND path NOT LIKE '%5.PNG'"), extract.stand_in)
    for _ in range(2):
        extract.write_batch(again, photos, faces + "2", log + "2", 0, F.current_timestamp())
    assert spark.read.parquet(faces + "2").count() == 6 and extract.read_log(spark, log + "2").count() == 10


def test_many_small_files(spark, tmp_path):
    names = [f"b{k % 3}/{k}.jpg" for k in range(1500)]
    put_all(spark, f"file://{tmp_path}/in", ((n, b"\x01" + n.encode()) for n in names))
    photos = spark.createDataFrame(list(enumerate(names)), "id long, file_path string").union(spark.createDataFrame([(2000, names[0])], "id long, file_path string"))
    faces, log = str(tmp_path / "faces"), str(tmp_path / "log")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        extract.start(image_stream(spark, str(tmp_path / "in"), bytes_at_once=1 << 20), photos, extract.stand_in, faces, log, str(tmp_path / "c"), None).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    # one micro-batch, and one file of each kind, as few rows need no more
    assert sorted(p.parent.name for p in tmp_path.glob("log/*/*.parquet")) == ["batch=0-1", "batch=0-2"] and len(list(tmp_path.glob("faces/*/*.parquet"))) == 1
    assert sorted(r.photo_id for r in spark.read.parquet(faces).collect()) == [*range(1500), 2000]  # two photos share a file
    assert extract.read_log(spark, log).count() == 3002 and spark.read.parquet(log + "-unmatched").count() == 0


def test_work_in_turns(spark, tmp_path):
    rows = [*folder(tmp_path), (9, "b1/lost.jpg")]
    photos = spark.createDataFrame(rows, "id long, file_path string")
    at = lambda minute: F.lit(dt.datetime(2024, 1, 1, 12, minute, tzinfo=dt.timezone.utc))
    log, faces = str(tmp_path / "log"), str(tmp_path / "faces")
    new = photos.select(F.col("id").alias("photo_id"), F.lit("PENDING").alias("status"), F.lit(None).alias("error"))
    lifecycle.log_rows(new, at(0)).write.parquet(f"{log}/batch=new")
    # one photo is in work elsewhere, and its worker is lost
    begun = new.filter("photo_id = 2").withColumn("status", F.lit("PROCESSING"))
    lifecycle.log_rows(begun, at(1)).write.parquet(f"{log}/batch=other")
    turn = lambda k, minute: extract.work_once(spark, photos, str(tmp_path / "in"), lambda c, m: m(c), faces, log, f"w{k}", at(minute), setup=lambda: extract.stand_in)
    assert [turn(k, 2 + k) for k in range(3)] == [5, 1, 0]
    found = {r.photo_id: r.status for r in lifecycle.current(extract.read_log(spark, log)).collect()}
    assert found == {0: "PROCESSED", 1: "PROCESSED", 2: "PROCESSING", 3: "NO_FACE_DETECTED", 4: "FAILED", 5: "PROCESSED", 9: "FAILED"}
    assert lifecycle.stale_rows(extract.read_log(spark, log), at(11)).count() == 0
    lifecycle.stale_rows(extract.read_log(spark, log), at(12)).write.parquet(f"{log}/batch=lease")
    assert turn(4, 13) == 1
    assert {r.photo_id: r.status for r in lifecycle.current(extract.read_log(spark, log)).collect()}[2] == "PROCESSED"
    assert sorted(r.photo_id for r in spark.read.parquet(faces).collect()) == [0, 1, 1, 2, 2, 2, 5]


def test_leases(spark, tmp_path):
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    old = now - dt.timedelta(minutes=5)
    rows = [(1, 1, "PROCESSING", now), (2, 1, "PROCESSING", old), (2, 2, "PROCESSED", None), (3, 7, "PROCESSING", old), (4, 1, "PROCESSING", None)]
    spark.createDataFrame([(*r, None, None) for r in rows], STATUS_LOG).write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(STATUS_LOG).parquet(str(tmp_path / "log"))
    query = leases.expired(log, 0.1).writeStream.format("memory").queryName("leases").outputMode("append").start()
    try:
        for _ in range(80):
            time.sleep(0.5)
            if len(found := spark.sql("SELECT * FROM leases").collect()) > 1:
                break
        # 3 at once, as its lease counts from the start of its work; 1 when its time is over; 2 is done; 4 has no start
        assert sorted((r.photo_id, r.seq, r.status) for r in found) == [(1, 2, "PENDING"), (3, 8, "PENDING")]
        assert spark.sql("SELECT * FROM leases").columns == STATUS_LOG.names
    finally:
        query.stop()


def test_leases_in_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(leases, "BUCKETS", 16)
    now = dt.datetime(2024, 1, 1, 12, 0)
    old, edge, new = now - dt.timedelta(minutes=11), now - dt.timedelta(minutes=10), now - dt.timedelta(minutes=1)
    claims = [(k, 10, "PROCESSING", edge if k % 2 else new) for k in range(3000)]
    # of three photos one is done, one gets an older claim late, and one a newer claim whose lease is over
    later = [[(k, 11, "PROCESSED", None), (k, 9, "PROCESSING", old), (k, 12, "PROCESSING", old)][k % 3] for k in range(3000)]
    odd = [(None, 5, "PROCESSING", old), (5000, None, "PROCESSING", old), (5001, 1, "PROCESSING", None), (5002, 2, "PENDING", None), (5002, 1, "PROCESSING", old), (2**62 + 1, 2**62, "PROCESSING", old)]
    for rows in (claims, later + odd):
        spark.createDataFrame([(*r, None, None) for r in rows], STATUS_LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(STATUS_LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    moment = now.replace(tzinfo=dt.timezone.utc).timestamp()
    query = leases.expired(log, now=moment).writeStream.format("memory").queryName("grouped").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    found = {(r.photo_id, r.seq) for r in spark.sql("SELECT * FROM grouped").collect()}
    assert found == {(k, 13) for k in range(2, 3000, 3)} | {(None, 6), (2**62 + 1, 2**62 + 1)}
    # a turn a group, not a photo
    assert [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators][-1] <= 16


def test_lease_timers():
    class State:
        get, exists, hasTimedOut, timer = None, False, False, None

        def update(self, value):
            self.get, self.exists = value, True

        def remove(self):
            self.get, self.exists = None, False

        def setTimeoutDuration(self, millis):
            self.timer = millis

    def turn(*rows):
        state.timer = None
        return [(r.photo_id, r.seq) for out in leases.on_change((3,), iter([pd.DataFrame(list(rows), columns=["photo_id", "seq", "began"])] if rows else []), state, 1, None) for r in out.itertuples()]

    state, start = State(), lambda seconds: int((time.time() - seconds) * 1e6)
    assert turn((1, 5, start(20)), (2, 5, start(50))) == [] and 5_000 < state.timer <= 10_001
    assert turn((2, 4, start(90))) == [] and 5_000 < state.timer <= 10_001  # what comes late leaves the timer
    assert turn((2, 6, leases.NEVER)) == [] and 30_000 < state.timer <= 40_001  # the first lease is done with
    assert turn((4, 1, start(61))) == [(4, 2)] and state.timer > 30_000
    state.update((np.array([[1], [5], [start(60.5)]]).tobytes(),))
    state.hasTimedOut = True
    assert turn() == [(1, 6)] and not state.exists


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, [0.5]), (2, 2, None)], FACES)
    append_table(df, str(tmp_path / "t"))
    append_table(df, str(tmp_path / "t"))
    assert read_table(spark, str(tmp_path / "t"), FACES).count() == 4
    assert as_json(df.filter("id = 2")).first().json == '{"id":2,"photo_id":2,"face_vector":null}'
