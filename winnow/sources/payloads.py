"""Tables of JSON payloads to tables of repositories and commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from winnow.functions import payloads as p


def _items(rows: DataFrame, payload: str, item_type: str) -> tuple[DataFrame, Column]:
    """Rows with the payload parsed once, and the expression for its items."""
    return rows.withColumn("_value", p.unwrap(F.col(payload))), p.items_of(F.col("_value"), item_type)


def parse_repo_payload(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per repository, with its place in the payload and the stated total."""
    parsed, items = _items(rows, payload, p.REPO_ITEM)
    kept = [c for c in rows.columns if c != payload]
    total = p.total_of(F.col("_value"), items).alias("total_count")
    return parsed.select(*kept, total, F.posexplode(items).alias("pos", "item")).select(
        *kept, "total_count", "pos", "item.*"
    )


def parse_commit_payload(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per commit, with its place in the payload."""
    kept = [c for c in rows.columns if c != payload]
    parsed, items = _items(rows, payload, p.COMMIT_ITEM)
    return parsed.select(*kept, F.posexplode(items).alias("pos", "item")).select(
        *kept, "pos", "item.*"
    )


def payload_status(payload: str = "payload") -> Column:
    """'error' for text that is not JSON or holds no list, 'empty' for an empty list, else 'ok'."""
    value = p.unwrap(F.col(payload))
    size = F.size(F.try_variant_get(value, "$.items", "array<variant>"))
    size = F.coalesce(size, F.size(F.try_variant_get(value, "$", "array<variant>")))
    is_object = F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))
    return (
        F.when(value.isNull(), "error")
        .when(size > 0, "ok")
        .when((size == 0) | is_object, "empty")
        .otherwise("error")
    )
