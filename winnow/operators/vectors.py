"""Cosine search and upsert over an embedding column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from winnow import fixed_values as fixed
from winnow.sources.arrivals import exists
from winnow.sources.buckets import bucket_of, read_buckets, values_of, write_partitions

# Vector cells of the queries that are held in one task, 32 MB of doubles, and of the corpus beside them.
BLOCK_CELLS = 4_000_000
# Folders of a stored vector table.
VECTOR_BUCKETS = 256


def cosine_topk(corpus: DataFrame, queries: DataFrame, k: int, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(query_id, rank, doc_id, score, status): the k nearest corpus vectors of each query, for any number of both.

    Exact search among vectors of the query's own size. Queries that fill one
    block are broadcast: the corpus stays where it is, each task multiplies its
    batches with the query matrix and lets only its k best per query go on.
    More queries are cut into blocks, the corpus too, and each block of the one
    meets each block of the other in a task of bounded size that gives k rows
    per query. Either way the k best of all tasks are merged by query, and the
    corpus is read once.

    The status is 'compared', or, in the one row without rank, document and
    score of a query that cannot be compared, the reason: 'null id', 'null
    vector', 'empty vector', 'null in vector' or 'no vector of its size'. An
    id that repeats is compared if one of its vectors can be. Corpus vectors
    that are null or hold nulls are found by none.
    """
    asked = queries.select("query_id", "embedding").withColumn("status", _hindrance())
    able = asked.filter("status IS NULL").drop("status")
    cells = able.agg(F.sum(F.size("embedding")).alias("n")).first()["n"] or 0
    given = corpus.filter(_whole()).select("doc_id", "embedding")
    kinds = f"query_id {_kind(queries, 'query_id')}, doc_id {_kind(corpus, 'doc_id')}, score double"
    partial = _by_broadcast(given, able, k, kinds) if cells <= block_cells else _by_blocks(given, able, k, kinds, block_cells)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    statuses = asked.groupBy("query_id").agg(
        F.when(F.count_if(F.col("status").isNull()) == 0, F.min("status")).alias("_hindrance")
    )
    status = F.coalesce("_hindrance", F.when(F.col("rank").isNotNull(), "compared").otherwise("no vector of its size"))
    joined = statuses.join(ranked, "query_id", "left")
    return joined.select("query_id", "rank", "doc_id", "score", status.alias("status"))


def _kind(rows: DataFrame, name: str) -> str:
    return rows.schema[name].dataType.simpleString()


def _by_broadcast(corpus: DataFrame, queries: DataFrame, k: int, kinds: str) -> DataFrame:
    """Candidates (query_id, doc_id, score) of queries that are known to fill no more than a block."""
    by_size: dict[int, list[Row]] = {}
    for row in queries.orderBy("query_id").collect():
        by_size.setdefault(len(row["embedding"]), []).append(row)
    asked = {size: (np.array([r["query_id"] for r in alike]), _matrix([r["embedding"] for r in alike])) for size, alike in by_size.items()}
    shared = corpus.sparkSession.sparkContext.broadcast(asked)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for mixed in batches:
            for size, batch in mixed.groupby(mixed["embedding"].map(len), sort=False):
                found = _nearest(*shared.value[size], batch, k)
                best = _first(found if best is None else pd.concat([best, found]), k)
        if best is not None:
            yield _plain(best)

    return corpus.filter(F.size("embedding").isin(list(by_size))).mapInPandas(nearest, kinds)


def _by_blocks(corpus: DataFrame, queries: DataFrame, k: int, kinds: str, block_cells: int) -> DataFrame:
    """Candidates (query_id, doc_id, score) from all blocks of queries and of the corpus, of equal sizes of vectors."""

    def sized(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        rows = rows.withColumn("size", F.size("embedding"))
        blocks = F.ceil(F.count("*") * F.first("size") / F.lit(block_cells)).cast("int")
        return rows, rows.groupBy("size").agg(blocks.alias(name))

    asked, asked_blocks = sized(queries, "query_blocks")
    held, held_blocks = sized(corpus, "doc_blocks")
    both = asked_blocks.join(held_blocks, "size")

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row in its own block, once for every block that it is to meet."""
        block = F.pmod(F.xxhash64(key, "embedding"), F.col(own)).cast("int").alias(own)
        meets = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        return rows.join(both, "size").select("size", block, meets, key, "embedding")

    keys = ["size", "query_blocks", "doc_blocks"]
    left = dealt(asked, "query_id", "query_blocks", "doc_blocks").groupBy(*keys)
    right = dealt(held, "doc_id", "doc_blocks", "query_blocks").groupBy(*keys)

    def nearest(own: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        if own.empty or batch.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []}, dtype=object)
        ids, step = own["query_id"].to_numpy(), max(1, block_cells // len(batch))
        matrix = _matrix(own["embedding"].tolist())
        return _plain(pd.concat(_first(_nearest(ids[i : i + step], matrix[i : i + step], batch, k), k) for i in range(0, len(own), step)))

    return left.cogroup(right).applyInPandas(nearest, kinds)


def _nearest(query_ids: np.ndarray, query_matrix: np.ndarray, batch: pd.DataFrame, k: int) -> pd.DataFrame:
    """All of a batch that may be among the k best of a query."""
    scores = query_matrix @ _matrix(batch["embedding"].tolist()).T
    if len(batch) > k:
        # Whatever reaches the k-th score may still be needed: ties go by id later.
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        query_at, doc_at = np.nonzero(scores >= kth)
    else:
        query_at, doc_at = np.nonzero(np.ones_like(scores, dtype=bool))
    found = {"query_id": query_ids[query_at], "doc_id": batch["doc_id"].to_numpy()[doc_at], "score": scores[query_at, doc_at]}
    return pd.DataFrame(found)


def _plain(found: pd.DataFrame) -> pd.DataFrame:
    """Ids as plain objects: text put together from several frames lies in chunks, which Spark doesn't take."""
    return found.astype({"query_id": object, "doc_id": object})


def _matrix(vectors: list) -> np.ndarray:
    return _unit(np.array(vectors, dtype="float64"))


def _whole() -> Column:
    return F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())


def _hindrance() -> Column:
    """Why a query cannot be compared with any vector; null if it can."""
    return (
        F.when(F.col("query_id").isNull(), "null id")
        .when(F.col("embedding").isNull(), "null vector")
        .when(F.size("embedding") == 0, "empty vector")
        .when(~_whole(), "null in vector")
    )


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _first(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    in_order = frame.sort_values(["score", "doc_id"], ascending=[False, True], kind="stable")
    return in_order.groupby("query_id", sort=False).head(k)


def upsert_into_store(
    new: DataFrame, path: str, dimension: int = fixed.VECTOR_DIMENSION, buckets: int = VECTOR_BUCKETS
) -> None:
    """Upsert (doc_id, embedding, …, version) rows into the vector table at `path`, laid out by a bucket of the id.

    Only the buckets of new ids are read and replaced. All writers of a table
    use the same number of buckets and upsert one after the other.
    """
    spark = new.sparkSession
    placed = new.withColumn("bucket", bucket_of(F.col("doc_id"), buckets))
    held = read_buckets(spark, path, f"{_ddl(new)}, bucket bigint", "bucket", values_of(placed, "bucket"))
    merged = upsert_vectors(held.select(*new.columns), new, dimension)
    write_partitions(merged.withColumn("bucket", bucket_of(F.col("doc_id"), buckets)), path, "bucket")


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a vector table; one that was never written is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def upsert_vectors(
    stored: DataFrame, new: DataFrame, dimension: int = fixed.VECTOR_DIMENSION
) -> DataFrame:
    """One row per doc_id: the highest version, the new row where versions are equal.

    A vector of another dimension is an error. The latest row is an aggregate,
    so copies of a document are reduced before they are shuffled.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    checked = F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(
        F.raise_error(
            F.concat(F.lit("wrong vector dimension for "), F.col("doc_id").cast("string"))
        ).cast("array<float>")
    )
    row = F.struct(*[F.col(c) for c in stored.columns if c != "doc_id"])
    latest = F.max_by(row, F.struct("version", "_new")).alias("row")
    return both.withColumn("embedding", checked).groupBy("doc_id").agg(latest).select("doc_id", "row.*")
