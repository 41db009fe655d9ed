"""Tables as streams: what lies there when the stream starts, file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def stream_parquet(spark: SparkSession, path: str, schema: str | StructType, **options: str | int) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of files.

    A stream's source is a folder. A table of one file is found by its name in
    the folder that holds it; the name filter is for names of files, so a table
    that is a folder is streamed itself.
    """
    reader = spark.readStream.schema(schema).options(**options)
    if is_folder(spark, path):
        return reader.parquet(path)
    above, _, name = path.rstrip("/").rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(above)


def read_written(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """What a stream has written, with the schema it was declared with; no rows where nothing was written."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
