"""Whole tables in order, without a task that holds all of a group."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from winnow.session import use_checkpoint_dir


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared checkpoint folder and read again: a lost executor costs a reread."""
    spark = rows.sparkSession
    path = f"{use_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def numbered_in_order(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the row's number from 0 in the order of the whole table.

    Each task sorts one range of the order and numbers its rows; ranges are
    then moved on by the sizes of those before, of which there is one row each.
    A group that the order puts together may lie in any number of ranges. Rows
    that tie in all of the order share a range.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # A task numbers its rows from (task << 33) on.
    local = ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33))
    local = written(local.withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    sizes = local.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return local.join(starts, "_range").withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def runs_of_rows(rows: DataFrame, group: str, number: str, value: str, width: int, overlap: int = 0) -> DataFrame:
    """(group, run, values): the values of each group in order, in arrays of `width` consecutive numbers.

    An array starts with the values of up to `overlap` rows before its own, so
    that what lies across the edge is seen whole; none has more than both.
    """
    run = F.floor(F.col(number) / width).cast("bigint")
    own = F.array(run)
    if overlap:
        last = F.pmod(F.col(number), F.lit(width)) >= width - overlap
        own = F.when(last, F.array(run, run + 1)).otherwise(own)
    spread = rows.select(group, F.col(number).alias("_n"), F.col(value).alias("_v"), F.explode(own).alias("run"))
    in_order = F.array_sort(F.collect_list(F.struct("_n", "_v")))
    return spread.groupBy(group, "run").agg(F.transform(in_order, lambda r: r["_v"]).alias("values"))
