"""Near-duplicate documents by order min-hash and banded alignment."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from winnow.llm.common import SPACE_RUN, give_back_memory, stored, text_or_empty
from winnow.llm.components import components
from winnow.operators.grouping import for_skewed_join

SHINGLE = 5
SIMILARITY = 0.8
# Sketches per text, and shingles in each of them.
SKETCHES, KEPT = 16, 2
# A finer summary that screens pairs before texts are compared: least hash in each of so many bins.
BINS = 128
WORDS_KEPT = 400_000
# Members of a bucket that one task compares among themselves.
TOGETHER = 512

_TEXTS = "place long, doc_id long, key binary, n int, sketches array<long>, words binary"
_RANDOM = np.random.RandomState(20240229)
_XOR = _RANDOM.randint(0, 1 << 62, SKETCHES).astype(np.uint64)
_ODD = _RANDOM.randint(0, 1 << 62, SKETCHES).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, kept) of every document; one row of each class is kept.

    Words are runs between ASCII white space. Texts with equal words are one
    class from the start (nulls count as empty). Other texts are linked when
    their five-word shingles, repeats counted, align to `similarity` or more:
    shingles in the longest common order, over those of either text. Classes
    are linked texts and what these are linked to; `class_id` is the smallest
    doc_id in it, null only if all are null, and the row with it is kept, the
    first of them if it repeats. Texts of fewer words than a shingle link to
    equal ones only. Other columns are left out; an empty table gives no rows.

    Texts that share a sketch are compared with one of their bucket, the one
    that shares most buckets. Only where texts of a bucket aren't one class by
    then are the others compared: those of different classes, in blocks of
    bounded size, in the first bucket that a pair shares, screened by a finer
    summary. Such tasks give the links they find, not pairs.
    """
    found = _with_leaders(docs, similarity)
    kept = (F.col("place") == F.col("leader.place")).alias("kept")
    return found.select("doc_id", F.col("leader.doc_id").alias("class_id"), kept)


def _with_leaders(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, place, key, leader): each row with the row of its class that is kept."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    texts = stored(rows.mapInArrow(_summaries, _TEXTS), "near-texts")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place")).alias("first")
    distinct = stored(texts.groupBy("key").agg(F.min("place").alias("node"), first), "near-distinct")
    alone = distinct.select(F.col("node").alias("place"))
    members = stored(_with_centres(_shared_buckets(texts.join(alone, "place", "left_semi"))), "near-buckets")
    # Texts of shared buckets only travel on. The hints keep one plan at every
    # size: words are sorted by text once, however few the pairs that ask for them.
    shared = members.select("node").distinct().hint("merge")
    nodes = texts.select(F.col("place").alias("node"), "sketches", "words").join(shared, "node", "left_semi")
    nodes = stored(nodes, "near-words")

    links = stored(aligned(_central_pairs(members, similarity), nodes, similarity), "near-links")
    rest = stored(_other_links(members, components(links), nodes, similarity), "near-rest")
    labels = components(links.unionByName(rest))

    nodes = distinct.join(labels, "node", "left").select(
        "key", "first", F.coalesce("component", "node").alias("label")
    )
    nodes = stored(nodes, "near-nodes")
    leaders = stored(nodes.groupBy("label").agg(F.min("first").alias("leader")), "near-leaders")
    classes = stored(nodes.join(leaders, "label").select("key", "leader"), "near-classes")
    return texts.select("doc_id", "place", "key").join(classes, "key")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of near-duplicates, columns unchanged.

    Rows are met again by doc_id and words. Of rows equal in both, one stays.
    """
    found = _with_leaders(docs, similarity).withColumn("kept", F.col("place") == F.col("leader.place"))
    kept = found.groupBy("doc_id", "key").agg(F.count("*").alias("times"), F.max("kept").alias("kept")).filter("kept")
    kept = stored(kept.select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"), "times"), "near-kept")
    runs = F.filter(F.split(text_or_empty(), SPACE_RUN), lambda w: w != "")
    key = F.unhex(F.md5(F.array_join(runs, " ").cast("binary")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"), key.alias("key"))
    met = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
    repeated = met.filter("times > 1").dropDuplicates(["id", "key"])
    return met.filter("times = 1").unionByName(repeated).select("row.*")


def similarity_of(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Of two texts' labelled shingles: those in the longest common order over all; 0 if below `at_least`.

    Labels make the shingles of a text distinct, so the longest common order
    is the longest ascending run of places. For texts as similar as asked, no
    pair of the alignment lies further from the diagonal than the shingles that
    may be left out of it: that is the band.
    """
    shorter, longer = sorted((len(a), len(b)))
    needed = int(np.ceil(at_least / (1 + at_least) * (shorter + longer) - 1e-9))
    if not shorter or shorter < needed:
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(at_a) < needed:
        return 0.0
    inside = np.abs(at_a - at_b) <= longer - needed
    places = at_b[inside][np.argsort(at_a[inside])]
    common = len(places) if (np.diff(places) > 0).all() else _longest_ascending(places.tolist())
    found = common / (shorter + longer - common)
    return found if found >= at_least - 1e-12 else 0.0


def _longest_ascending(places: list[int]) -> int:
    ends: list[int] = []
    for place in places:
        at = bisect_left(ends, place)
        ends[at : at + 1] = [place]
    return len(ends)


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the shingles of 16-bit word hashes, each labelled with how often it came before."""
    if len(words) < SHINGLE:
        return np.zeros(0, np.uint64)
    w, n = words.astype(np.uint64), len(words) - SHINGLE + 1
    x = w[:n] | (w[1 : n + 1] << np.uint64(16)) | (w[2 : n + 2] << np.uint64(32)) | (w[3 : n + 3] << np.uint64(48))
    x = _mixed(_mixed(x) + w[4 : n + 4])
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    same = np.concatenate([[False], ordered[1:] == ordered[:-1]])
    if same.any():
        at = np.arange(n)
        before = at - np.maximum.accumulate(np.where(same, 0, at))
        times = np.zeros(n, np.uint64)
        times[order] = before.astype(np.uint64)
        x = np.where(times > 0, _mixed(x + times * np.uint64(0x9E3779B97F4A7C15)), x)
    return x


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def sketches_of(shingles: np.ndarray) -> np.ndarray:
    """For each of several hashes, the least shingles, in text order, as one number; none of no shingles."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    together = SKETCHES if len(shingles) < 20_000 else 1  # so that long texts take little memory
    return np.concatenate([_sketches(shingles, slice(k, k + together)) for k in range(0, SKETCHES, together)])


def _sketches(shingles: np.ndarray, which: slice) -> np.ndarray:
    x = (shingles ^ _XOR[which, None]) * _ODD[which, None]
    rows, least = np.arange(len(x)), []
    for _ in range(min(KEPT, len(shingles))):
        least.append(x.argmin(1))
        x[rows, least[-1]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    value = np.arange(SKETCHES, dtype=np.uint64)[which]
    for places in np.sort(np.array(least), axis=0):
        value = value * np.uint64(0x9E3779B97F4A7C15) + shingles[places]
    return value.view(np.int64)


def _bins_of(shingles: np.ndarray) -> np.ndarray:
    """In each bin of hashes the least, as 16 bits; 65535 where none falls."""
    x = _mixed(shingles + np.uint64(77))
    order = np.argsort(x)
    x = x[order]
    which = (x >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(which, prepend=-1))
    out = np.full(BINS, 0xFFFF, np.uint16)
    # Bits below those that choose the bin, and not the high ones that the least hash has in common.
    out[which[first]] = np.minimum(_mixed(x[first]) >> np.uint64(48), np.uint64(0xFFFE)).astype(np.uint16)
    return out


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    place = TaskContext.get().partitionId() << 33
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    names = [f.split()[0] for f in _TEXTS.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            words = text.as_py().split()
            if len(known) > WORDS_KEPT:
                known.clear()
            for word in set(words).difference(known):
                known[word] = xxhash.xxh64_intdigest(word) >> 48
            hashes = np.fromiter(map(known.__getitem__, words), np.uint16, len(words))
            shingles = labelled_shingles(hashes)
            key = hashlib.md5(b" ".join(words)).digest()
            rows.append((place, doc_id, key, len(shingles), sketches_of(shingles), hashes.tobytes()))
            place += 1
            if len(rows) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    known.clear()
    give_back_memory()


def _shared_buckets(texts: DataFrame) -> DataFrame:
    """(bucket, band, node, n, size): texts by sketch, for sketches that several share."""
    each = texts.select(F.col("place").alias("node"), "n", F.posexplode("sketches").alias("band", "sketch"))
    each = each.select("node", "n", "band", F.xxhash64("band", "sketch").alias("bucket"))
    sizes = each.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    return each.join(for_skewed_join(sizes, "bucket"), "bucket")


def _with_centres(members: DataFrame) -> DataFrame:
    """Add `centre` and `centre_n`: the member of the bucket that shares most buckets with others."""
    members = stored(members, "near-members")
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    best = F.max(F.struct("weight", (-F.col("node")).alias("minus"), "n"))
    centres = members.join(weights, "node").groupBy("bucket").agg(best.alias("c"))
    centres = centres.select("bucket", (-F.col("c.minus")).alias("centre"), F.col("c.n").alias("centre_n"))
    return members.join(for_skewed_join(centres, "bucket"), "bucket")


def _central_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each text with the centres of its buckets, where lengths allow for the similarity."""
    alike = F.least("n", "centre_n") >= F.greatest("n", "centre_n") * similarity - 1e-9
    ends = F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")
    return members.filter(alike & F.expr("node != centre")).select(*ends).distinct()


def _other_links(members: DataFrame, labels: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between different classes that share a bucket, centres left out."""
    # A bucket of two is its centre and the other.
    now = members.filter("size > 2").join(labels, "node", "left").select(
        "bucket", "band", "node", "size", "centre", F.coalesce("component", "node").alias("label")
    )
    now = stored(now, "near-open")
    ends = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    now = now.join(for_skewed_join(ends.select("bucket"), "bucket"), "bucket")
    # A bucket larger than a block is compared block by block.
    now = now.withColumn("blocks", F.ceil(F.col("size") / TOGETHER).cast("int"))
    now = now.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    now = now.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = [F.col("bucket"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    now = now.select(*group, "band", "node", "label", "centre", "block").join(nodes.hint("merge"), "node")
    now = now.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ("bucket", "i", "j")):
            found = _links_in(table, similarity)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
        give_back_memory()

    return now.mapInArrow(compare, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key in turn, of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = [batch.column(k).to_numpy() for k in keys]
        starts = np.flatnonzero(np.logical_or.reduce([np.diff(v, prepend=v[:1]) != 0 for v in values]))
        for start, end in zip([0, *starts], [*starts, len(batch)], strict=True):
            key = tuple(v[start] for v in values) if start < end else last
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _links_in(table: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links between texts of different labels, one for labels that the block itself joins."""
    node, label, block = (table.column(c).to_numpy() for c in ("node", "label", "block"))
    if (label == label[0]).all():
        return []
    i, j, band, centre = (table.column(c)[0].as_py() for c in ("i", "j", "band", "centre"))
    words = [np.frombuffer(w.as_buffer(), np.uint16) for w in table.column("words").combine_chunks()]
    n = np.array([len(w) - SHINGLE + 1 for w in words])
    sketches = np.array(table.column("sketches").combine_chunks().values).reshape(len(node), -1)
    shingles: dict[int, np.ndarray] = {}
    joined: dict[int, int] = {}

    def root(x: int) -> int:
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    def shingles_of(k: int) -> np.ndarray:
        if k not in shingles:
            shingles[k] = labelled_shingles(words[k])
        return shingles[k]

    left, right = (np.flatnonzero((block == x) & (node != centre)) for x in (i, j))
    found = []
    for part in np.array_split(left, max(1, len(left) // 64)):
        open_ = label[part][:, None] != label[right][None, :]
        least, most = np.minimum(n[part][:, None], n[right]), np.maximum(n[part][:, None], n[right])
        open_ &= least >= most * similarity - 1e-9
        if i == j:
            open_ &= part[:, None] < right[None, :]
        at, to = np.nonzero(open_)
        at, to = part[at], right[to]
        # A pair is compared in the first bucket that it shares.
        first = (sketches[at] == sketches[to]).argmax(1) == band
        at, to = at[first], to[first]
        if len(at) > 50:
            used = np.unique(np.concatenate([at, to]))
            bins = np.zeros((len(node), BINS), np.uint16)
            for k in used:
                bins[k] = _bins_of(shingles_of(k))
            good = np.concatenate(
                [_may_be_alike(bins[at[k : k + 20_000]], bins[to[k : k + 20_000]], similarity) for k in range(0, len(at), 20_000)]
            )
            at, to = at[good], to[good]
        for a, b in zip(at.tolist(), to.tolist(), strict=True):
            x, y = root(label[a]), root(label[b])
            if x != y and similarity_of(shingles_of(a), shingles_of(b), similarity) > 0:
                joined[max(x, y)] = min(x, y)
                found.append((node[a], node[b]))
    return found


def _may_be_alike(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether bins agree as often as in similar texts: four standard deviations below the mean of the least similar."""
    used = ((x != 0xFFFF) | (y != 0xFFFF)).sum(1)
    equal = ((x == y) & (x != 0xFFFF)).sum(1)
    return equal >= similarity * used - 4 * np.sqrt(similarity * (1 - similarity) * used)


def aligned(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs whose texts align to the similarity."""
    words = nodes.select("node", "words")
    met = pairs.join(words.withColumnsRenamed({"node": "a", "words": "words_a"}).hint("merge"), "a")
    met = met.join(words.withColumnsRenamed({"node": "b", "words": "words_b"}).hint("merge"), "b")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[int, np.ndarray] = {}

        def shingles(node: int, of: pa.BinaryScalar) -> np.ndarray:
            if node not in recent:
                if len(recent) >= 64:
                    recent.clear()
                recent[node] = labelled_shingles(np.frombuffer(of.as_py(), np.uint16))
            return recent[node]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            kept = [
                k
                for k, (x, y) in enumerate(zip(batch.column("words_a"), batch.column("words_b"), strict=True))
                if similarity_of(shingles(a[k], x), shingles(b[k], y), similarity) > 0
            ]
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))
        recent.clear()
        give_back_memory()

    return met.select("a", "b", "words_a", "words_b").mapInArrow(align, "a long, b long")
