"""Reading and writing: image files, landing folders, tables and databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: In any case of letters.
IMAGES = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG]}"


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """Images of a folder tree: path, modificationTime, length and content (read only if asked for)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGES).load(folder)


def image_stream(spark: SparkSession, folder: str, files_at_once: int = 5, bytes_at_once: int | None = None) -> DataFrame:
    """The same as a stream of new files of the folder tree, at most so many a micro-batch.

    If ``bytes_at_once`` is given it bounds the micro-batches instead: each costs some seconds however little it holds,
    so that many small files should share one."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGES)
    return (reader.option("maxBytesPerTrigger", bytes_at_once) if bytes_at_once else reader.option("maxFilesPerTrigger", files_at_once)).load(folder)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table with the schema that it must have."""
    return spark.read.schema(schema).parquet(path)


def append_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Appends to a Parquet table, in folders of one column's values if ``by`` is given."""
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def read_database(spark: SparkSession, url: str, name: str, user: str, password: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> DataFrame:
    """A database's table through JDBC (with the driver on the classpath), read in parallel by ranges of a column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, user=user, password=password)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def as_json(df: DataFrame) -> DataFrame:
    """Each row as JSON text, in a column ``json``."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
