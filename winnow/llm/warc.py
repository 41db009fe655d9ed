"""WARC archives: written from pages, read back record by record."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from winnow.operators.grouping import for_skewed_join

ARCHIVE_SCHEMA = "path string, records bigint"
RECORD_SCHEMA = (
    "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, "
    "refers_to bigint, verified boolean, path string, record_offset bigint, payload binary"
)
_ID = "urn:x-page:"
_UNSAFE = re.compile(rb"[^\x21-\x7e]")


def write_archives(
    pages: DataFrame,
    folder: str,
    min_revisit_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    archive_bytes: int = 1 << 30,
) -> DataFrame:
    """Write a WARC record per row of (page_id, url, html); give (path, records) of the archives.

    The payload is the html in UTF-8 (null: empty). Of the records whose
    payloads are equal and of at least `min_revisit_bytes`, that with the
    largest page_id is a response and the others are revisits of it; rows that
    share the largest page_id are all responses, and so is every row without a
    page_id. A record is a gzip member of its own. A task writes archives of
    about `archive_bytes` under names that no other attempt uses, and only
    those of the attempt that succeeded are listed. Other columns of `pages`
    are ignored; a null url leaves its header out.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn(
        "digest", F.unhex(F.sha1("payload"))
    )
    copies = (
        rows.filter(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("digest", "first_id")
    )
    kept_id = F.when(F.col("page_id") < F.col("first_id"), F.col("first_id")).alias("refers_to")
    marked = rows.join(for_skewed_join(copies, "digest"), "digest", "left").select(
        "page_id", F.col("url").cast("binary").alias("url"), "payload", "digest", kept_id
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open_folder(folder)
        context = TaskContext.get()
        stem = f"{root}/part-{context.partitionId():05d}-{context.taskAttemptId()}"
        done: list[tuple[str, int]] = []
        out, written, records = None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{stem}-{len(done):03d}.warc.gz"
                    out, written, records = files.open_output_stream(path, compression=None), 0, 0
                member = _member(_record(row, date))
                out.write(member)
                written, records = written + len(member), records + 1
                if written >= archive_bytes:
                    out.close()
                    out = None
                    done.append((path, records))
        if out is not None:
            out.close()
            done.append((path, records))
        yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "records": [d[1] for d in done]})

    return marked.mapInArrow(write, ARCHIVE_SCHEMA)


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of archives listed by `path`, one row each, in RECORD_SCHEMA.

    An archive is read front to back in small pieces; memory holds one record.
    `verified` tells whether the block's digest and, for responses, the
    payload's digest agree with the header's; a record whose length disagrees
    with Content-Length is an error. `payload_bytes` and `payload_digest` are
    those of the bytes read; for revisits, which hold no payload, those the
    record states of the full payload. `payloads=False` leaves payloads null.
    No archives give no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _open_folder(folder)
        names = ("page_id url record_type payload_bytes payload_digest refers_to verified path record_offset").split()
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.binary()]
        schema = pa.schema(list(zip([*names, "payload"], types, strict=True)))
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with files.open_input_stream(path, compression=None) as raw:
                    for offset, headers, block in members(raw):
                        row = _row(headers, block)
                        row |= {"path": path, "record_offset": offset}
                        row["payload"] = row["payload"] if payloads else None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 300
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("path").mapInArrow(read, RECORD_SCHEMA)


def archives_of(spark: SparkSession, folder: str) -> DataFrame:
    """The archives lying in a folder, as `read_archives` takes them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"))


def members(raw: BinaryIO, piece: int = 1 << 16) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """(offset, headers, block) of each gzip member, with incremental decompression."""
    offset, waiting = 0, b""
    while True:
        waiting = waiting or raw.read(piece)
        if not waiting:
            return
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not waiting:
                waiting = raw.read(piece)
                if not waiting:
                    raise ValueError(f"the record at {offset} is cut off")
            parts.append(inflate.decompress(waiting))
            used += len(waiting)
            waiting = b""
        waiting = inflate.unused_data
        head, split, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not split or not lines[0].startswith(b"WARC/1."):
            raise ValueError(f"the record at {offset} has no WARC header")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        length = int(headers[b"content-length"])
        if rest[length:] != b"\r\n\r\n":
            raise ValueError(f"the record at {offset} is not as long as it says")
        yield offset, headers, rest[:length]
        offset += used - len(waiting)


def _open_folder(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder that all executors share, and the folder's path in it."""
    files, root = pa.fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder.removeprefix("file:")))
    files.create_dir(root, recursive=True)
    return files, root


def _digest(data: bytes) -> bytes:
    return base64.b32encode(hashlib.sha1(data).digest())


def _record(row: dict, date: str) -> bytes:
    payload, revisit = row["payload"], row["refers_to"] is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    page = b"" if row["page_id"] is None else b"%d" % row["page_id"]
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <%b%b>" % (_ID.encode(), page),
        b"WARC-Date: " + date.encode(),
        b"WARC-Payload-Digest: sha1:" + base64.b32encode(row["digest"]),
        b"WARC-Block-Digest: sha1:" + _digest(block),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if row["url"] is not None:
        # Bytes that would break the header line are percent-encoded.
        lines.append(b"WARC-Target-URI: " + _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], row["url"]))
    if revisit:
        lines.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(b"WARC-Refers-To: <%b%d>" % (_ID.encode(), row["refers_to"]))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def _row(headers: dict[bytes, bytes], block: bytes) -> dict:
    kind = headers[b"warc-type"].decode()
    head, _, payload = block.partition(b"\r\n\r\n")
    stated = headers.get(b"warc-payload-digest", b"sha1:").removeprefix(b"sha1:")
    verified = headers.get(b"warc-block-digest", b"").removeprefix(b"sha1:") == _digest(block)
    if kind == "revisit":
        said = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
        digest, length, payload = stated, int(said[1]) if said else None, None
    else:
        digest, length = _digest(payload), len(payload)
        verified = verified and digest == stated
    url = headers.get(b"warc-target-uri")
    return {
        "page_id": _page(headers[b"warc-record-id"]),
        "url": None if url is None else url.decode("ascii"),
        "record_type": kind,
        "payload_bytes": length,
        "payload_digest": digest.decode(),
        "refers_to": _page(headers.get(b"warc-refers-to", b"")),
        "verified": verified,
        "payload": payload,
    }


def _page(record_id: bytes) -> int | None:
    found = re.fullmatch(rb"<%b(-?\d+)>" % _ID.encode(), record_id)
    return int(found[1]) if found else None
