"""Repository and commit payloads: one JSON text per row, in any of three shapes.

{"items": [...], "total_count": n}, a bare list, or a list whose first element
carries the real JSON in its "text" field.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

REPO_ITEM = (
    "struct<name:string,html_url:string,description:string,language:string,"
    "stargazers_count:int,topics:array<string>,updated_at:string,pushed_at:string>"
)
COMMIT_ITEM = "struct<sha:string,commit:struct<message:string,author:struct<name:string,date:string>>>"


def unwrap(payload: Column) -> Column:
    """Variant of the payload, the text wrapper taken off; null when it is not JSON."""
    value = F.try_parse_json(payload)
    inner = F.try_variant_get(value, "$[0].text", "string")
    return F.when(inner.isNotNull(), F.try_parse_json(inner)).otherwise(value)


def items_of(value: Column, item_type: str) -> Column:
    """The list of items, or null when the payload has none in either place."""
    listed = f"array<{item_type}>"
    return F.coalesce(
        F.try_variant_get(value, "$.items", listed), F.try_variant_get(value, "$", listed)
    )


def total_of(value: Column, items: Column) -> Column:
    stated = F.try_variant_get(value, "$.total_count", "bigint")
    return F.coalesce(stated, F.size(items).cast("bigint"))
