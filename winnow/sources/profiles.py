"""The profile store: five tables under one folder, each laid out by a bucket of the candidate and by batch.

All writers of a store use the same number of buckets. A load reads and replaces
a bucket whole, so there should be about as many as the table has GB, or more.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from winnow import schemas
from winnow.operators.ordering import written
from winnow.sources.arrivals import exists
from winnow.sources.buckets import bucket_of, drop_partitions, even, read_buckets, values_of, write_partitions

BUCKETS = 64
# Rows of a number or two that are broadcast whatever Spark takes for small; some 130 MB.
_BROADCAST_ROWS = 1 << 21


def read_profile_json(spark: SparkSession, root: str, key: str, candidate_id: int) -> DataFrame:
    """Import a candidate's JSON array file; a missing or unparsable file gives an empty table."""
    schema = schemas.PROFILE_ENTRIES[key]
    try:
        files = spark.read.text(f"{root}/{key}.json", wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.STORED[key])
    struct = schema.replace(", ", ",").replace(" ", ":")
    entries = F.try_variant_get(F.try_parse_json("value"), "$", f"array<struct<{struct}>>")
    placed = files.select(F.posexplode(entries).alias("seq", "e"))
    return placed.select(F.lit(candidate_id).cast("bigint").alias("candidate_id"), F.col("seq").cast("bigint").alias("seq"), "e.*")


def read_profile(spark: SparkSession, root: str, key: str) -> DataFrame:
    """Read a store table, (candidate_id, seq, entry); one that was never written is empty."""
    try:
        # The folders of buckets and batches are for writers.
        reader = spark.read.schema(schemas.STORED[key]).option("recursiveFileLookup", True)
        return reader.parquet(f"{root}/{key}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.STORED[key])


def _candidates(entries: DataFrame) -> DataFrame:
    """The ids of the entries' candidates, written, so that entries are worked out for them once."""
    return written(entries.select("candidate_id").distinct(), "candidates")


def _touched(own: DataFrame, root: str, key: str, buckets: int) -> DataFrame:
    """What the store holds in the buckets of the own candidates, with `bucket` and `batch`."""
    placed = values_of(own.select(bucket_of(F.col("candidate_id"), buckets).alias("bucket")), "bucket")
    schema = f"{schemas.STORED[key]}, bucket bigint, batch string"
    return read_buckets(own.sparkSession, f"{root}/{key}", schema, "bucket", placed)


def _met_in_place(rows: DataFrame) -> DataFrame:
    """Written rows, to be broadcast up to a bound, so that what they are joined to stays where it lies."""
    return F.broadcast(rows) if rows.count() <= _BROADCAST_ROWS else rows


def _placed(entries: DataFrame, batch: str | Column, buckets: int) -> DataFrame:
    name = F.lit(batch) if isinstance(batch, str) else batch
    return entries.withColumn("bucket", bucket_of(F.col("candidate_id"), buckets)).withColumn("batch", name)


def append_profile(entries: DataFrame, root: str, key: str, batch: str | None = None, buckets: int = BUCKETS) -> None:
    """Append candidates' entries after those that they have; the store never removes duplicates.

    Of the stored entries only the ids and places in the same buckets are read;
    of a new table none, and its entries are worked out once.
    With a name a batch can be written again: it replaces its own entries.
    """
    if exists(entries.sparkSession, f"{root}/{key}"):
        own = _candidates(entries)
        held = _touched(own, root, key, buckets).filter(F.col("batch") != F.lit(batch or ""))
        entries = after(entries, held.join(_met_in_place(own), "candidate_id", "left_semi"))
    rows = _placed(entries, batch or "load", buckets)
    write_partitions(rows, f"{root}/{key}", "bucket", "batch", replace=batch is not None)


def after(entries: DataFrame, held: DataFrame) -> DataFrame:
    """Entries with their places moved on past those that the candidate has already."""
    last = written(held.groupBy("candidate_id").agg(F.max("seq").alias("_last")), "last-places")
    moved = entries.join(_met_in_place(last), "candidate_id", "left")
    moved = moved.withColumn("seq", F.col("seq") + F.coalesce(F.col("_last") + 1, F.lit(0)))
    return moved.select(*entries.columns)


def overwrite_profile(entries: DataFrame, root: str, key: str, buckets: int = BUCKETS) -> None:
    """Replace the entries of the candidates that the new ones belong to; other candidates keep theirs.

    Only the buckets of these candidates are read and replaced. Whoever dies
    half-way leaves all other buckets as they are, and a bucket's old files
    until its new ones are whole. Loads that share no bucket may run side by
    side; others one after the other. The candidates' ids are written first:
    up to a bound they are broadcast, so that what the others keep is copied
    from file to file and only new entries are shuffled.
    """
    spark, path = entries.sparkSession, f"{root}/{key}"
    new = even(_placed(entries, "load", buckets), "bucket", "batch")
    if not exists(spark, path):
        write_partitions(new, path, "bucket", "batch", spread=False)
        return
    own = _candidates(entries)
    held = _touched(own, root, key, buckets)
    others = held.join(_met_in_place(own), "candidate_id", "left_anti")
    whole = others.unionByName(new.select(*others.columns))
    kept = others.select("bucket", "batch").unionByName(_placed(own, "load", buckets).select("bucket", "batch"))
    emptied = [r.asDict() for r in held.select("bucket", "batch").distinct().subtract(kept.distinct()).collect()]
    write_partitions(whole, path, "bucket", "batch", spread=False)
    drop_partitions(spark, path, emptied)
