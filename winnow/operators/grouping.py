"""Numbering and joining without putting a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Bitmaps of a filter and bits of each: 8 MB at most.
_BITMAPS, _BITS = 2048, 32768


def numbered(
    rows: DataFrame, key: str, seq: str, name: str = "position", width: int = 65536
) -> DataFrame:
    """Add the 1-based place of each row within its key, in order of a whole-number `seq`.

    A key is cut into ranges of `width` consecutive seq values. Places are
    counted inside each range and moved on by the sizes of the ranges before
    it. These are summed in the same way, ranges of `width` ranges at a time,
    so however sparse seq is, with seq unique in its key and the width as it
    is, no task orders more than `width` rows or ranges of a key together.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(seq) / width))
    offsets = ranged.groupBy(key, "_range").agg(F.count("*").alias("_size"))
    offsets = _with_sizes_before(offsets, key, width, 2).select(key, "_range", "_before")
    local = F.row_number().over(Window.partitionBy(key, "_range").orderBy(seq))
    placed = ranged.withColumn("_local", local).join(offsets, [key, "_range"])
    return placed.withColumn(name, F.col("_before") + F.col("_local")).drop(
        "_range", "_local", "_before"
    )


def _with_sizes_before(sizes: DataFrame, key: str, width: int, levels: int) -> DataFrame:
    """Add to (key, _range, _size) the sizes of all ranges of the key before it; `levels` times by wider ranges first."""
    if levels == 0:
        inside = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        return sizes.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    nested = sizes.withColumn("_wider", F.floor(F.col("_range") / width))
    wider = nested.groupBy(key, F.col("_wider").alias("_range")).agg(F.sum("_size").alias("_size"))
    wider = _with_sizes_before(wider, key, width, levels - 1)
    wider = wider.select(key, F.col("_range").alias("_wider"), F.col("_before").alias("_start"))
    inside = Window.partitionBy(key, "_wider").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    summed = nested.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    placed = summed.join(wider, [key, "_wider"]).withColumn("_before", F.col("_start") + F.col("_inside"))
    return placed.drop("_wider", "_start", "_inside")


def salted_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], spread_by: str, how: str, salts: int = 16
) -> DataFrame:
    """Join rows to a lookup with one row per key, each key's rows shared out over `salts` tasks.

    The salt follows from a column of the row, so a recomputed task makes the
    same rows again. The result is laid out by key and salt, so a ranking by
    key that follows gets a shuffle of its own, with its limit applied before.
    A lookup that measures small is broadcast as ever, and then nothing moves.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def for_skewed_join(lookup: DataFrame, *keys: str) -> DataFrame:
    """Lay out a lookup so that Spark can split a skewed key of the rows it will be joined to.

    Spark splits a key only between two shuffles made for the join itself. A
    lookup that an aggregate has already laid out by the key would not be
    shuffled again, so it is laid out by a hash of the key instead.
    """
    return lookup.repartition(F.xxhash64(*keys))


def likely_among(lookup: DataFrame, name: str) -> Column:
    """Whether a row's `name` may be one of the lookup's: false only for values, or nulls, that a join would not match.

    A bitmap of hashes, of fixed size however large the lookup is, worked out
    once as a subquery. As a condition on one column it goes where the rows are
    read, below the joins and shuffles that made them. With a hash for each
    eighth of its bits it lets an eighth of the other values pass.
    """
    place = F.pmod(F.xxhash64(name), F.lit(_BITMAPS * _BITS))
    bitmap, bit = F.floor(place / _BITS).cast("int"), F.pmod(place, F.lit(_BITS))
    held = lookup.filter(F.col(name).isNotNull()).select(bitmap.alias("_bitmap"), bit.alias("_bit"))
    held = held.groupBy("_bitmap").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    every = lookup.sparkSession.range(_BITMAPS).select(F.col("id").cast("int").alias("_bitmap"))
    listed = F.array_sort(F.collect_list(F.struct("_bitmap", F.coalesce("_bits", F.lit(b"")).alias("_bits"))))
    bitmaps = every.join(held, "_bitmap", "left").agg(F.transform(listed, lambda b: b["_bits"]).alias("bitmaps")).scalar()
    byte = F.substring(F.get(bitmaps, bitmap), F.floor(bit / 8).cast("int") + 1, F.lit(1))
    number = F.conv(F.hex(byte), 16, 10).cast("bigint")
    is_set = F.getbit(number, F.pmod(bit, F.lit(8)).cast("int")) == 1
    return F.col(name).isNotNull() & F.coalesce(is_set, F.lit(False))
