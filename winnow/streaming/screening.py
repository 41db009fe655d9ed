"""Screening of applications as they arrive, and appending of profile entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from winnow.operators import screening, skills
from winnow.sources.buckets import read_buckets, values_of, write_partitions
from winnow.sources.profiles import append_profile

APPLICATION = "application_id bigint, resume_id bigint, jd_id bigint, submitted_at timestamp"
# Ids that share a folder of what is written.
IDS_TOGETHER = 1 << 16


def read_applications(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(APPLICATION).parquet(path)


def screen_stream(
    applications: DataFrame, resumes: DataFrame, jds: DataFrame, lateness: str | None = None
) -> DataFrame:
    """Routed rows for a stream of applications, as a stream.

    Matching is the array form of the batch operator, so the joins against the
    static tables keep no state. Every batch reads the static tables through;
    where they are large, `screen_arrivals` reads less.

    Applications that come again come out again, and `write_routed` writes each
    once. With `lateness` they are left out here already: ids are state until
    the watermark has passed them, and what arrives later than that is dropped.
    """
    if lateness is not None:
        applications = applications.withWatermark("submitted_at", lateness).dropDuplicatesWithinWatermark(["application_id"])
    return screening.route(skills.match_skills(applications, resumes, jds))


def _ids(key: Column) -> Column:
    return F.floor(key / F.lit(IDS_TOGETHER)).cast("bigint")


def unseen(batch: DataFrame, path: str, number: int) -> DataFrame:
    """The batch's applications, each once, that no other batch has written, with their bucket of ids.

    What is written lies in folders by range of ids, and only those of the
    batch's own ranges are listed and read: the cost doesn't grow with what was
    screened before. Applications without an id are all new.
    """
    spark = batch.sparkSession
    batch = batch.dropDuplicates(["application_id"]).withColumn("ids", _ids(F.col("application_id")))
    own = [v for v in values_of(batch, "ids") if v is not None]
    done = read_buckets(spark, path, "application_id bigint, ids bigint, batch bigint, route string", "ids", own)
    done = done.filter(F.col("batch") != number).select("application_id")
    return batch.join(done, "application_id", "left_anti")


def _put(routed: DataFrame, path: str, number: int) -> None:
    write_partitions(routed.withColumn("batch", F.lit(number).cast("bigint")), path, "ids", "batch", "route")


def _foreach(stream: DataFrame, checkpoint: str, put) -> StreamingQuery:
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def screen_arrivals(
    applications: DataFrame,
    resumes: DataFrame,
    jds: DataFrame,
    path: str,
    checkpoint: str,
    columns: list[str] | None = None,
) -> StreamingQuery:
    """Screen what has arrived and write it to path/ids=…/batch=…/route=…, then stop.

    A batch names few resumes. They are picked by a semi-join first, which
    Spark broadcasts by measured size, so the other resumes are neither
    normalised nor shuffled. A repeated batch replaces its own partitions.
    Applications already written by other batches are left out, whenever they
    come again; no other is, however late. That needs `application_id` among
    the columns.
    """
    if columns and "application_id" not in columns:
        raise ValueError("columns must include application_id")

    def put(batch: DataFrame, number: int) -> None:
        new = unseen(batch, path, number).persist()
        named = resumes.join(new.select("resume_id").distinct(), "resume_id", "left_semi")
        offered = jds.join(new.select("jd_id").distinct(), "jd_id", "left_semi")
        routed = screening.route(skills.match_skills(new, named, offered))
        _put(routed.select(*columns, "ids") if columns else routed, path, number)
        new.unpersist()

    return _foreach(applications, checkpoint, put)


def write_routed(routed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write routed rows that have arrived to path/ids=…/batch=…/route=…, each application once, and stop."""

    def put(batch: DataFrame, number: int) -> None:
        # The ids are asked for first, which must not screen the batch twice.
        batch.persist()
        _put(unseen(batch, path, number), path, number)
        batch.unpersist()

    return _foreach(routed, checkpoint, put)


def append_stream(entries: DataFrame, root: str, key: str, name: str, checkpoint: str) -> StreamingQuery:
    """Append arriving profile entries (candidate_id, seq, entry) to a store table.

    A batch bears a name and a repeated batch replaces its own entries, so a
    retry adds nothing twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        append_profile(batch, root, key, f"{name}-{number}")

    return _foreach(entries, checkpoint, put)
