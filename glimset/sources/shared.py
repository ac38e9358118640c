"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a local master gets a temporary folder; a cluster has none that all see."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or "cluster" in sc.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="glimset-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder. What is made there and still there when the driver ends is removed then."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


@atexit.register
def _remove_made() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        jvm = SparkContext._gateway and SparkContext._jvm
        for path in _MADE if jvm else ():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Within, a setting of the session has another value."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes an execution's shuffle files when it has ended, not when the driver collects its garbage.

    For executions that write a table: nothing reads their shuffles again."""
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Writes the rows of df as Parquet and reads them again."""
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends there."""
    return write_table(df, shared_path(df.sparkSession, label))


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in its form."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    files, where = filesystem(spark, path)
    files.delete(where, True)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes one small file."""
    files, where = filesystem(spark, path)
    out = files.create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def put_all(spark: SparkSession, folder: str, contents: Iterable[tuple[str, bytes]], at_once: int = 16) -> None:
    """Writes many small files (path in the folder, content); only few wait in memory.

    Files of a local disk are written directly, as Hadoop without its native library starts two processes for each; others several at a time."""
    files, where = filesystem(spark, folder)
    if files.getScheme() == "file":
        local, made = Path(where.toUri().getPath()), set()
        for path, content in contents:
            file = local / path
            if file.parent not in made:
                file.parent.mkdir(parents=True, exist_ok=True)
                made.add(file.parent)
            file.write_bytes(content)
        return
    rest = iter(contents)
    with ThreadPoolExecutor(at_once) as pool:
        while some := list(islice(rest, 1024)):
            list(pool.map(lambda file: put(spark, f"{folder}/{file[0]}", file[1]), some))  # raises what a write raised
