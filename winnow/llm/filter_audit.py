"""How filters overlap: what each removes in every order, counted by a stream that takes back what it said too early.

The table is read as available-now micro-batches. A text that repeats fails
the filter on repeats unless its id is the smallest, and which id that is can
change with any later batch. The state holds, for each text, its smallest id
so far with the rows of that id; when a smaller one arrives, the mask counted
for the earlier rows is taken back from the counters and counted anew with the
repeat's bit. What the stream writes are differences; their sums are right
after the last batch, whatever the order of the files.

Nulls: a null text is empty; rows without an id are neither repeats nor make
others repeats; a null part is the empty string. Rows that repeat with their
id are alike: all hold the smallest id or none does. Documents without a label
count as neither good nor toxic, and a label given twice counts if any of its
rows says so. An empty table has no parts and gives no rows. Other columns of
the input aren't read.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from winnow.llm.common import shared_folder, stored
from winnow.sources.arrivals import read_written, stream_parquet

FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
# Ids that are met most often in labels are spread over so many tasks.
SALTS = 16
# Texts that share a state row: those of about so many bytes of the table's files.
BUCKET_BYTES = 4 << 20
_UPPER = bytes(range(65, 91))
_MARKS = b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))
_MASKED = "id long, key binary, bucket int, part string, mask int, salt int"
_ENTRY = "bucket int, known boolean, key binary, part string, mask int, good boolean, toxic boolean, id long, here long, more long"
_DELTA = "part string, mask int, good boolean, toxic boolean, n long"
_WHO = ["key", "part", "mask", "good", "toxic"]
_COUNTED = ["part", "mask", "good", "toxic"]


def mask_of(text: bytes) -> int:
    """The bits of the filters that look at the text alone."""
    words = text.split()
    letters = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUED))
    failed = (
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * letters > 3 * points,
        len(text.translate(None, _MARKS)) < len(text),
    )
    return sum(bit << i for i, bit in enumerate(failed))


def _masks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    number = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        keys = [hashlib.sha256(t or b"").digest() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array(keys, pa.binary()),
                pa.array([int.from_bytes(k[:8], "big") % buckets for k in keys], pa.int32()),
                batch.column("part"),
                pa.array([mask_of(t or b"") for t in texts], pa.int32()),
                pa.array([(number + i) % SALTS for i in range(len(keys))], pa.int32()),
            ],
            names=["id", "key", "bucket", "part", "mask", "salt"],
        )
        number += len(keys)


def _labels(labels: DataFrame, key: str) -> DataFrame:
    """(id, salt, good, toxic), an id once for each salt."""
    once = labels.groupBy(F.col(key).alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    return once.filter("id IS NOT NULL").select("*", F.explode(salts).alias("salt"))


def _together(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one text, part and labels as one: the smallest id, its rows, and how many rows have others."""
    for rows in frames:
        by = rows.groupby(["bucket", "known", *_WHO], sort=False)
        rows["least"] = by["id"].transform("min")
        rows["here"] = (rows["id"] == rows["least"]).astype("int64")
        out = by.agg(id=("least", "first"), here=("here", "sum"), more=("here", "size")).reset_index()
        yield out.assign(more=out["more"] - out["here"])


def _least_ids(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Update the smallest ids of a bucket's texts; gives what the counters change by."""
    new = pd.concat(list(frames)).drop(columns="bucket")
    deltas = []

    def count(rows: pd.DataFrame, n: str, sign: int, bit: int) -> None:
        rows = rows[rows[n] != 0]
        if len(rows):
            deltas.append(pd.DataFrame({**{c: rows[c] for c in _COUNTED}, "mask": rows["mask"] | bit, "n": sign * rows[n]}))

    count(new[~new["known"]], "here", 1, 0)
    new = new[new["known"]]
    count(new, "more", 1, REPEAT)
    both = new[[*_WHO, "id", "here"]].assign(old=False)
    if state.exists:
        held = pd.read_parquet(io.BytesIO(state.get[0]))
        both = pd.concat([held.assign(old=True), both], ignore_index=True)
    least = both["id"] == both.groupby("key")["id"].transform("min")
    count(both[least & ~both["old"]], "here", 1, 0)
    count(both[~least & ~both["old"]], "here", 1, REPEAT)
    count(both[~least & both["old"]], "here", -1, 0)
    count(both[~least & both["old"]], "here", 1, REPEAT)
    kept = both[least].groupby([*_WHO, "id"], sort=False)["here"].sum().reset_index()
    if len(kept):
        packed = io.BytesIO()
        kept.to_parquet(packed, index=False)
        state.update((packed.getvalue(),))
    if deltas:
        yield pd.concat(deltas).groupby(_COUNTED, sort=False)["n"].sum().reset_index()


def audit_counters(spark: SparkSession, path: str, labels: DataFrame, key: str = "doc_id", part: str = "lang", batches: int = 4) -> DataFrame:
    """(part, mask, good, toxic, n) of the Parquet table at `path`: how many documents fail which filters.

    `labels` has `key`, `quality` and `toxic`. The table is streamed in about
    `batches` micro-batches of equal bytes.
    """
    table = spark.read.parquet(path)
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(1, -(-size // BUCKET_BYTES))
    place = shared_folder(spark, "filter-audit")
    known = stored(_labels(labels, key), "filter-audit-labels")
    rows = stream_parquet(spark, path, table.schema, maxBytesPerTrigger=max(1, -(-size // batches)))
    rows = rows.select(
        F.col(key).cast("long").alias("id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
    )
    # A left join would send all rows without an id to one task; they carry none of the labels.
    masked = rows.mapInArrow(lambda found: _masks(found, buckets), _MASKED)
    meeting = F.coalesce("id", F.xxhash64("key", "salt"))
    flagged = masked.withColumn("meeting", meeting).join(known.withColumnRenamed("id", "meeting"), ["meeting", "salt"], "left")
    flag = [F.coalesce(F.col("id").isNotNull() & F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    known_id = [F.coalesce("id", F.lit(0).cast("long")).alias("id"), F.col("id").isNotNull().alias("known")]
    flagged = flagged.select(*known_id, "key", "bucket", "part", "mask", *flag)
    entries = flagged.mapInPandas(_together, _ENTRY)
    deltas = entries.groupBy("bucket").applyInPandasWithState(
        _least_ids, _DELTA, "held binary", "append", GroupStateTimeout.NoTimeout
    )
    written = deltas.writeStream.format("parquet").outputMode("append").option("path", f"{place}/deltas")
    written.option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    counted = read_written(spark, f"{place}/deltas", _DELTA).groupBy(*_COUNTED).agg(F.sum("n").alias("n"))
    return counted.filter("n != 0")


def in_every_order(counters: DataFrame) -> DataFrame:
    """What each filter does at each step of each order, per part.

    Counts are sums over the masks, of which there are 32; so a part is one row
    of 32 places, and orders are told apart after that.
    """
    size = 1 << len(FILTERS)

    def by_mask(value: Column, name: str) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, value)), F.lit(0)) for m in range(size)]).alias(name)

    parts = counters.groupBy("part").agg(
        by_mask(F.col("n"), "n"),
        by_mask(F.when(F.col("good"), F.col("n")), "good"),
        by_mask(F.when(F.col("toxic"), F.col("n")), "toxic"),
    )
    steps = []
    for order in itertools.permutations(range(len(FILTERS))):
        for step, own in enumerate(order):
            before = sum(1 << f for f in order[:step])
            steps.append({"filter_order": "".join(FILTERS[f] for f in order), "step": step + 1, "own": 1 << own, "before": before})
    kind = "array<struct<filter_order: string, step: int, own: int, before: int>>"
    every = parts.select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), kind)))

    def total(values: str, fits) -> Column:
        masks = F.sequence(F.lit(0), F.lit(size - 1))
        return F.aggregate(
            masks,
            F.lit(0).cast("long"),
            lambda sum_, m: sum_ + F.when(fits(m), F.element_at(F.col(values), m + 1)).otherwise(F.lit(0).cast("long")),
        )

    def held(mask: Column, bits: str) -> Column:
        return mask.bitwiseAND(F.col(bits)) != 0

    removed = total("n", lambda m: held(m, "own") & ~held(m, "before"))
    # One of k filters comes before the other k - 1 in this many of all orders.
    every_order = math.factorial(len(FILTERS))
    weights = F.array(*[F.lit(every_order // max(1, k)).cast("long") for k in range(len(FILTERS) + 1)])
    share = F.aggregate(
        F.sequence(F.lit(0), F.lit(size - 1)),
        F.lit(0).cast("long"),
        lambda sum_, m: sum_
        + F.when(held(m, "own"), F.element_at(F.col("n"), m + 1) * F.element_at(weights, F.bit_count(m) + 1)).otherwise(
            F.lit(0).cast("long")
        ),
    )
    return every.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: ~held(m, "before") & ~held(m, "own")).alias("kept"),
        removed.alias("removed"),
        total("n", lambda m: held(m, "own") & held(m, "before")).alias("redundant"),
        F.element_at("n", F.col("own") + 1).alias("unique_fails"),
        total("good", lambda m: held(m, "own") & ~held(m, "before")).alias("good_lost"),
        total("toxic", lambda m: held(m, "own") & ~held(m, "before")).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, **options) -> DataFrame:
    """The counters of `audit_counters`, reported by `in_every_order`."""
    return in_every_order(audit_counters(spark, path, labels, **options))
