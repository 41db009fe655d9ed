"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from winnow.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of edges (a, b), the smallest node that it is linked to by a path.

    Each round every node gives way to the first of itself and its neighbours,
    and edges run on between those that remain. "First" is by value in the
    first two rounds, which settles stars, and by a hash that changes every two
    rounds from then on, so a long chain shrinks by a constant factor too.
    Edges are written every round; loops and repeated edges do no harm.
    """
    edges = stored(_between(edges.select("a", "b")), "edges")
    labels, turn = None, 0
    while labels is None or not edges.isEmpty():
        seed = turn // 2
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.least(_rank(F.col("a"), seed), F.min(_rank(F.col("b"), seed)))
        near = stored(both.groupBy("a").agg(first["v"].alias("first")).withColumnRenamed("a", "node"), "nearest")
        if labels is None:
            labels = near.withColumnRenamed("first", "label")
        else:
            moved = labels.join(near.withColumnRenamed("node", "label"), "label", "left")
            labels = stored(moved.select("node", F.coalesce("first", "label").alias("label")), "labels")
        ends = near.select(F.col("node").alias("a"), F.col("first").alias("fa"))
        other = near.select(F.col("node").alias("b"), F.col("first").alias("fb"))
        moved = edges.join(ends, "a").join(other, "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
        edges = stored(_between(moved), "edges")
        turn += 1
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return stored(labels.join(stored(smallest, "smallest"), "label").select("node", "component"), "components")


def _rank(node: Column, seed: int) -> Column:
    return F.struct((F.xxhash64(node, F.lit(seed)) if seed else F.lit(0).cast("bigint")).alias("h"), node.alias("v"))


def _between(edges: DataFrame) -> DataFrame:
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return edges.filter("a != b").select(*ends).distinct()
