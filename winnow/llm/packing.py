"""Packing documents into sequences: best fit in each task, then best fit of what is left in a tree."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from winnow.llm.common import give_back_memory, shared_folder, text_or_empty
from winnow.llm.tokens import TokenBytes

CAPACITY = 4096
END = 1
# Bins with no more room than this aren't handed on.
SLACK = 16
# Pieces that are packed together in the first round, and bins and pieces in a task of the later ones.
PIECES_TOGETHER = 200_000
BINS_TOGETHER = 40_000

_MEMBER = [
    ("doc_id", pa.int64()),
    ("piece", pa.int32()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("offset", pa.int64()),
    ("ids", pa.binary()),
]
_BINS = pa.schema([("done", pa.bool_()), ("fill", pa.int64()), ("members", pa.list_(pa.struct(_MEMBER)))])
BIN_SCHEMA = (
    "done boolean, fill bigint, members array<struct<doc_id bigint, piece int, start bigint, length bigint, "
    "ids_crc32 bigint, offset bigint, ids binary>>"
)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, offset, ids, sequence_id): each piece and its place.

    `docs` has doc_id and text; a null text is an empty one. A document is its
    token ids and an end id; longer ones than a sequence are cut into pieces of
    its capacity, the last of which may be shorter; others stay whole. Pieces
    go, longest first, into the bin that they leave the least room in. Each
    task packs the documents of its own input and writes full and nearly full
    bins; bins with room meet those of other tasks as items of the next round,
    until one task holds all that are left or a round no longer thins them out.
    A rerun may number and fill sequences otherwise. Repeated rows and null ids
    are packed like others; an empty table gives no rows. `ids` are null unless
    asked for: little-endian unsigned 32-bit ids of the piece.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().cast("binary").alias("text"))

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = []
        with TokenBytes.at_work(tokenizer) as ids_of:
            for batch in batches:
                texts = ids_of.many(text.as_py() for text in batch.column("text"))
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                    pieces += _pieces(doc_id, ids, capacity, keep_ids)
                    if len(pieces) >= PIECES_TOGETHER:
                        yield from _packed([(p[3], [p]) for p in pieces], capacity)
                        pieces = []
        if pieces:
            yield from _packed([(p[3], [p]) for p in pieces], capacity)

    def next_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = []
        for batch in batches:
            for row in batch.to_pylist():
                bins.append((row["fill"], [tuple(m.values()) for m in row["members"]]))
        if bins:
            yield from _packed(bins, capacity)
        bins.clear()
        give_back_memory()

    written = [f"{folder}/0"]
    rows.mapInArrow(first_round, BIN_SCHEMA).write.partitionBy("done").parquet(written[0])
    left = None
    while True:
        bins = spark.read.schema(BIN_SCHEMA).parquet(written[-1]).filter("not done")
        count, members = bins.agg(F.count("*"), F.coalesce(F.sum(F.size("members")), F.lit(0))).first()
        if count <= 1 or (left is not None and (left[1] == 1 or count > 0.9 * left[0])):
            break
        tasks = max(1, -(-count // BINS_TOGETHER), -(-members // PIECES_TOGETHER))
        left = (count, tasks)
        written.append(f"{folder}/{len(written)}")
        bins.repartition(tasks).mapInArrow(next_round, BIN_SCHEMA).write.partitionBy("done").parquet(written[-1])
    full = [spark.read.schema(BIN_SCHEMA).parquet(path).filter("done") for path in written]
    packed = bins
    for part in full:
        packed = packed.unionByName(part)
    numbered = packed.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    return numbered.select("sequence_id", F.explode("members").alias("m")).select("m.*", "sequence_id")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, from pieces packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of the items in each bin: the longest first, each where it leaves the least room."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[k]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(k)
        else:
            room, at = capacity, len(bins)
            bins.append([k])
        room -= size
        if room:
            with_room[room].append(at)
            rooms |= 1 << room
    return bins


def _pieces(doc_id: int | None, ids: bytes, capacity: int, keep_ids: bool) -> list[tuple]:
    ids += END.to_bytes(4, "little")
    out = []
    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
        part = ids[at : at + 4 * capacity]
        out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), 0, part if keep_ids else None))
    return out


def _packed(items: list[tuple[int, list[tuple]]], capacity: int, batch: int = 2000) -> Iterator[pa.RecordBatch]:
    """Bins of items (fill, members); a member's offset moves on by what lies before its item."""
    rows = []
    for places in best_fit([fill for fill, _ in items], capacity):
        members, fill = [], 0
        for k in places:
            members += [(*m[:5], m[5] + fill, m[6]) for m in items[k][1]]
            fill += items[k][0]
        rows.append((capacity - fill <= SLACK, fill, members))
        if len(rows) == batch:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple[bool, int, list[tuple]]]) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(r[2]) for r in rows)])
    columns = list(zip(*(m for r in rows for m in r[2]), strict=True))
    members = pa.StructArray.from_arrays(
        [pa.array(c, kind) for c, (_, kind) in zip(columns, _MEMBER, strict=True)], [n for n, _ in _MEMBER]
    )
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), members)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), lists], schema=_BINS)
