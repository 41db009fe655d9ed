"""Tables laid out in folders by a bucket of their key, so that few rows touch few files.

A write replaces the partitions that it holds rows of and no others: new files
are written beside the old ones, which go when the whole write is done. A job
that dies on the way leaves what was there; what a replacement reads may be the
very partitions that it replaces. Two writers must not replace one partition at
the same time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from winnow.sources.arrivals import exists

# Stands between texts that travel as one; a row that holds it travels as it is.
_MARK = "\x01"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("bigint")


def values_of(rows: DataFrame, column: str, most: int = 100_000) -> list[int]:
    """The distinct buckets of some rows. Folders are listed by name, so there must not be very many."""
    found = [r[0] for r in rows.select(column).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values of {column} in one write; write fewer rows at a time")
    return found


def read_buckets(spark: SparkSession, path: str, schema: str, column: str, values: list[int]) -> DataFrame:
    """The rows of some buckets. Only their folders are listed and read, however many others there are."""
    folders = [f"{path}/{column}={v}" for v in values]
    held = [f for f in folders if exists(spark, f)]
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*held)


def even(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows laid out for files of even size in each partition.

    An array of texts takes 16 bytes a text besides its letters, so it travels
    as one text where that one gives the same array again.
    """
    lists = [f.name for f in rows.schema if f.dataType.simpleString() == "array<string>"]
    sent, got = {}, {}
    for name in lists:
        joined = F.array_join(F.col(name), _MARK)
        same = F.split(joined, _MARK).eqNullSafe(F.col(name))
        sent |= {f"_one_{name}": F.when(same, joined), f"_as_is_{name}": F.when(~same, F.col(name))}
        got[name] = F.coalesce(F.split(f"_one_{name}", _MARK), F.col(f"_as_is_{name}"))
    moved = rows.withColumns(sent).drop(*lists) if sent else rows
    moved = moved.hint("rebalance", *[F.col(c) for c in columns])
    return moved.select(*[got[c].alias(c) if c in got else c for c in rows.columns])


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a job in here has shuffled is deleted when it is done, not when the driver collects its garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)


def write_partitions(rows: DataFrame, path: str, *columns: str, replace: bool = True, spread: bool = True) -> None:
    """Write rows to path/column=value/..., partitions that rows go to are replaced, or added to.

    Files are of even size, unless the rows are laid out already (`spread` false).
    """
    with _shuffles_dropped(rows.sparkSession):
        writer = (even(rows, *columns) if spread else rows).write.partitionBy(*columns).option("compression", "zstd")
        if replace:
            writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
        else:
            writer.mode("append").parquet(path)


def drop_partitions(spark: SparkSession, path: str, partitions: list[dict[str, object]]) -> None:
    """Delete partitions that a replacement has left without rows."""
    for partition in partitions:
        name = "/".join(f"{column}={value}" for column, value in partition.items())
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
