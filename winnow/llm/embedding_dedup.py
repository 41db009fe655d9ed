"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from winnow.llm.common import stored
from winnow.llm.components import components
from winnow.operators.grouping import for_skewed_join

COSINE = 0.93
# Dimensions of a block, and how many of them lay out the cells of its range join.
BLOCK, GRID = 8, 2
# Vectors of a cell that one task compares among themselves.
TOGETHER = 1024
_PAIRS_TOGETHER = 50_000
_SLACK = 1e-7

_ROWS = "place long, vec_id long, label string, dims int, key binary, norm double, raw binary"
_PLACES = "node long, label string, dims int, block int, cell long, home boolean"


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Vectors are linked when their labels are equal and not null, their sizes
    are equal, and their cosine in double precision is `cosine` or more.
    Vectors that are null, zero or hold null or non-finite components link with
    nothing. `n_links` counts other rows, copies included; `component_id` is
    the smallest vec_id reachable by links; kept is the row with that id, or
    each of them if it repeats. Other columns are left out.

    Unit vectors at most so far apart are, in one block of rotated coordinates
    at least, no further apart than the block's share of the squared distance.
    Each block is range-joined by cells of its first coordinates, and pairs
    that pass in a block and in none before it are verified exactly. Equal
    vectors are joined as one. Cells are compared in blocks of bounded size;
    tasks give counts of links and a spanning forest, never all pairs.
    """
    if not -1 < cosine < 1:
        raise ValueError("cosine must lie between -1 and 1")
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"),
        F.col("label").cast("string").alias("label"),
    )
    rows = stored(rows.mapInArrow(_checked, _ROWS), "vectors")
    nodes = rows.filter("key is not null").groupBy("label", "key").agg(
        F.min("place").alias("node"), F.min("vec_id").alias("least"), F.count("*").alias("times")
    )
    nodes = stored(nodes, "vector-nodes")
    kept = rows.select(F.col("place").alias("node"), "label", "dims", "norm", "raw").join(nodes.select("node", "times"), "node")
    kept = stored(kept, "vector-distinct")
    budget = 2.0 - 2.0 * cosine

    places = stored(kept.mapInArrow(lambda b: _placed(b, budget), _PLACES), "vector-places")
    cell = ["label", "dims", "block", "cell"]
    sizes = places.groupBy(*cell).agg(F.count("*").alias("size"), F.max("home").alias("lived_in"))
    sizes = sizes.filter("lived_in and size > 1").select(*cell, F.ceil(F.col("size") / TOGETHER).cast("int").alias("parts"))
    met = places.join(for_skewed_join(sizes, *cell), cell)
    met = met.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select(*cell, "node", "home", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    met = met.join(kept.select("node", "norm", "raw", "times"), "node")

    def compare(table: pa.Table) -> pa.Table:
        return _links(table, cosine, budget)

    found = stored(met.groupBy(*cell, "i", "j").applyInArrow(compare, "a long, b long, n long"), "vector-links")
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    labels = components(found.filter("b is not null").select("a", "b"))
    nodes = nodes.join(counts, "node", "left").join(labels, "node", "left").select(
        "label", "key", "least", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component"),
    )
    nodes = stored(nodes, "vector-counted")
    least = stored(nodes.groupBy("component").agg(F.min("least").alias("component_id")), "vector-least")
    nodes = stored(nodes.join(least, "component").select("label", "key", "n_links", "component_id"), "vector-results")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", "label", "key").join(nodes, ["label", "key"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a place of their own; key, norm and raw are null for vectors that can't be compared."""
    place = TaskContext.get().partitionId() << 33
    for batch in batches:
        columns: list[list] = [[] for _ in range(7)]
        for vec_id, vector, label in zip(*(batch.column(n).to_pylist() if n != "v" else batch.column(n) for n in ("vec_id", "v", "label")), strict=True):
            key = norm = raw = None
            values = vector.values
            if label is not None and values is not None and len(values) and not values.null_count:
                v = values.to_numpy(zero_copy_only=False) + 0.0  # -0.0 and 0.0 are equal
                # Scaled first, so that squares neither overflow nor vanish.
                most = np.abs(v).max()
                if np.isfinite(v).all() and most > 0:
                    v = v / 2.0 ** np.frexp(most)[1]
                    norm = float(np.sqrt((v * v).sum()))
                    small = v.astype(np.float32)
                    raw = (small if (small == v).all() else v).tobytes()
                    key = hashlib.md5(v.tobytes()).digest()
            size = 0 if values is None else len(values)
            for column, value in zip(columns, (place, vec_id, label, size, key, norm, raw), strict=True):
                column.append(value)
            place += 1
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.float64(), pa.binary()]
        names = [f.split()[0] for f in _ROWS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _vectors(raw: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(raw), dims))
    for k, data in enumerate(raw):
        out[k] = np.frombuffer(data, np.float32 if len(data) == 4 * dims else np.float64)
    return out


def _rotated(units: np.ndarray) -> np.ndarray:
    """A rotation made of sign changes and a Hadamard transform, filled up with zeros to a power of two.

    Sums are made row by row, so a vector has the same coordinates in every task.
    """
    dims = units.shape[1]
    size = max(1 << (dims - 1).bit_length(), 1)
    x = np.zeros((len(units), size))
    for turn in range(2):
        signs = np.random.RandomState(7 + turn).randint(0, 2, size) * 2.0 - 1.0
        if turn:
            x *= signs
        else:
            x[:, :dims] = units * signs[:dims]
        step = 1
        while step < size:
            pairs = x.reshape(len(x), -1, 2, step)
            low, high = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
            pairs[:, :, 0], pairs[:, :, 1] = low + high, low - high
            step *= 2
        x /= np.sqrt(size)
    width = min(BLOCK, size)
    return x.reshape(len(x), size // width, width)


def _placed(batches: Iterator[pa.RecordBatch], budget: float) -> Iterator[pa.RecordBatch]:
    """Each vector's own cell in every block, and the cells ahead of it that it may have partners in."""
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
    names = [f.split()[0] for f in _PLACES.split(", ")]
    for batch in batches:
        dims_of = batch.column("dims").to_numpy()
        for dims in np.unique(dims_of):
            part = batch.take(pa.array(np.flatnonzero(dims_of == dims)))
            nodes, norms = (part.column(n).to_numpy() for n in ("node", "norm"))
            x = _rotated(_vectors(part.column("raw").to_pylist(), int(dims)) / norms[:, None])
            labels = np.array(part.column("label").to_pylist(), dtype=object)
            reach = np.sqrt(budget / x.shape[1]) + _SLACK
            lead = x[:, :, : min(GRID, x.shape[2])]
            cells = np.floor(lead / (2 * reach)).astype(np.int64)
            inside = lead - cells * 2 * reach
            near = {1: inside >= reach - _SLACK, -1: inside <= reach + _SLACK, 0: np.ones(inside.shape, bool)}
            for step in product((0, 1, -1), repeat=lead.shape[2]):
                if step < (0,) * len(step):
                    continue
                at, block = np.nonzero(np.logical_and.reduce([near[s][:, :, k] for k, s in enumerate(step)]))
                moved = cells[at, block] + np.array(step)
                cell = np.zeros(len(at), np.int64)
                for k in range(moved.shape[1]):
                    cell = (cell << 28) + moved[:, k] + (1 << 27)
                home = np.full(len(at), not any(step))
                columns = [nodes[at], labels[at], np.full(len(at), dims), block, cell, home]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _links(table: pa.Table, cosine: float, budget: float) -> pa.Table:
    """(node, null, links) counts and (node, other, 0) edges of a spanning forest, of one part of a cell."""
    dims, block = table.column("dims")[0].as_py(), table.column("block")[0].as_py()
    nodes, norms, times, part = (table.column(n).to_numpy() for n in ("node", "norm", "times", "part"))
    home = table.column("home").to_numpy(zero_copy_only=False)
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    units = _vectors(table.column("raw").to_pylist(), dims) / norms[:, None]
    x = _rotated(units)
    blocks = x.shape[1]
    limit = (np.sqrt(budget / blocks) + _SLACK) ** 2
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    own = x[:, block]
    squares = (own * own).sum(1)
    counts = np.zeros(len(nodes), np.int64)
    links = []
    for some in np.array_split(left, max(1, len(left) // 256)):
        close = squares[some][:, None] + squares[right][None, :] - 2 * own[some] @ own[right].T <= limit + 1e-9
        close &= home[some][:, None] | home[right][None, :]
        if i == j:
            close &= some[:, None] < right[None, :]
        at, to = np.nonzero(close)
        at, to = some[at], right[to]
        for k in range(0, len(at), _PAIRS_TOGETHER):
            a, b = at[k : k + _PAIRS_TOGETHER], to[k : k + _PAIRS_TOGETHER]
            apart = ((x[a, : block + 1] - x[b, : block + 1]) ** 2).sum(2) <= limit
            first = apart[:, block] & ~apart[:, :block].any(1)
            a, b = a[first], b[first]
            linked = (units[a] * units[b]).sum(1) >= cosine
            a, b = a[linked], b[linked]
            np.add.at(counts, a, times[b])
            np.add.at(counts, b, times[a])
            links.append((a, b))
    a, b = (np.concatenate([x[k] for x in links]) if links else np.zeros(0, int) for k in (0, 1))
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    joined, counted = np.flatnonzero(label != np.arange(len(label))), np.flatnonzero(counts)
    return pa.table(
        {
            "a": pa.array(np.concatenate([nodes[counted], nodes[joined]]), pa.int64()),
            "b": pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(nodes[label[joined]], pa.int64())]),
            "n": pa.array(np.concatenate([counts[counted], np.zeros(len(joined), np.int64)]), pa.int64()),
        }
    )
