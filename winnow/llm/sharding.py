"""Shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from winnow.llm.common import numbered_rows

_ROUNDS = 6


def shard_rows(
    docs: DataFrame, shards: int, seed: int = 0, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """(id, size, text_crc32, carried columns, row_number, shard, slot): a reproducible shuffle of all rows into shards.

    Rows are numbered by id (null first), then by what their text says. A row's
    number alone tells its shard and slot, and the other way round
    (`row_number`), so counts differ by one at most and slots have no gaps.
    Size: UTF-8 bytes plus 16; a null text has no bytes and the checksum of
    none. Rows equal in id and text are interchangeable and keep a number each.
    An empty table gives no rows. Columns not in `carry` are left behind before
    anything is shuffled.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_text_hash"),
        *carry,
    )
    numbered = numbered_rows(rows, [F.col(id_column), F.col("_text_hash")], "row_number").drop("_text_hash")
    count = numbered.count()
    place = permuted(F.col("row_number"), count, seed)
    return numbered.withColumn("_place", place).select(
        id_column,
        "size",
        "text_crc32",
        *carry,
        "row_number",
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("bigint").alias("slot"),
    )


def permuted(number: Column, count: int, seed: int) -> Column:
    """The place of a row number in a pseudo-random permutation of 0 .. count-1."""

    @F.pandas_udf("bigint")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(permute(values.to_numpy(), count, seed))

    return place(number)


def permute(values: np.ndarray, count: int, seed: int, backwards: bool = False) -> np.ndarray:
    """A Feistel network over the next even power of two, walked on until the value is below count."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    todo, out = np.arange(len(values)), values.astype(np.uint64)
    while len(todo):
        out[todo] = _network(out[todo], half, seed, backwards)
        todo = todo[out[todo] >= count]
    return out.astype(np.int64)


def row_number(shard: np.ndarray, slot: np.ndarray, shards: int, count: int, seed: int) -> np.ndarray:
    """The number of the row that lies at a slot of a shard."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), count, seed, backwards=True)


def _network(values: np.ndarray, half: int, seed: int, backwards: bool) -> np.ndarray:
    mask, width = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = values >> width, values & mask
    rounds = range(_ROUNDS)
    for k in reversed(rounds) if backwards else rounds:
        if backwards:
            left, right = right ^ (_mix(left, k, seed) & mask), left
        else:
            left, right = right, left ^ (_mix(right, k, seed) & mask)
    return (left << width) | right


def _mix(values: np.ndarray, k: int, seed: int) -> np.ndarray:
    key = np.uint64((seed * 0x9E3779B97F4A7C15 + (k + 1) * 0xD1B54A32D192ED03) % (1 << 64))
    x = (values + key) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))
