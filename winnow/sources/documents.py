"""Pages and page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Job pages already fetched: (page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def assemble_pages(
    pages: DataFrame, doc: str, order: str, text: str, pages_per_part: int = 1000
) -> DataFrame:
    """Page texts run together in page order; a null page counts as ''.

    A document of up to `pages_per_part` pages is one row, part 0. A longer
    one goes on in further parts, so no group grows without bound.
    """
    part = F.floor(F.col(order) / pages_per_part).cast("bigint").alias("part")
    page = F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    in_order = F.array_sort(F.collect_list(page))
    return pages.groupBy(F.col(doc), part).agg(
        F.array_join(F.transform(in_order, lambda p: p["t"]), "").alias(text),
        F.count("*").alias("n_pages"),
    )
