"""What several operators share: shared folders, written tables, row numbers, words."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from winnow.session import use_checkpoint_dir

# Words are runs of other characters than these.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the checkpoint folder, which all executors share."""
    return f"{use_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The rows, written as Parquet to a shared folder and read again.

    Cuts the lineage, so that a lost executor costs no more than a reread.
    """
    path = shared_folder(rows.sparkSession, name)
    rows.write.partitionBy(*partition_by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def numbered_rows(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the row's number from 0 in the given order, without sorting the whole in one task.

    Rows are sorted within ranges of the order and moved on by the sizes of the
    ranges before; only one row per range meets in one task. Rows that tie in
    the whole order are told apart by their place in the written input, so a
    frequent value is shared out over ranges too.
    """
    placed = stored(rows, "unnumbered").withColumn("_place", F.monotonically_increasing_id())
    in_order = [*order, F.col("_place")]
    ranged = placed.repartitionByRange(*in_order).sortWithinPartitions(*in_order)
    # A task numbers its rows from (task << 33) on.
    ranged = ranged.withColumn("_at", F.monotonically_increasing_id()).drop("_place")
    ranged = stored(
        ranged.withColumn("_range", F.shiftright("_at", 33)).withColumn(
            "_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
        ),
        "numbered",
    )
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    joined = ranged.join(starts, "_range")
    return joined.withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def remainder_of_crc(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo a divisor; a null key counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def give_back_memory() -> None:
    """Return what a task has freed to the system: a worker that waits for its next task would hold it on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it, and keeps back so much
    if trim is not None:
        trim(0)
