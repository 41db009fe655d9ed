"""Bring rows into a declared model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from winnow import schemas


def _default(kind: str, value: object) -> Column:
    return (F.array() if isinstance(value, list) else F.lit(value)).cast(kind)


def conform(rows: DataFrame, model: str, keys: list[str]) -> DataFrame:
    """Keys, the model's columns with defaults filled, and `reason`.

    `reason` names the required columns a row lacks and is null for a valid
    row. Columns the input does not have at all count as null.
    """
    fields = schemas.MODELS[model]
    cells, absent = [], []
    for name, (kind, default) in fields.items():
        value = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        if default is schemas.REQUIRED:
            absent.append(F.when(value.isNull(), F.lit(name)))
        else:
            value = F.coalesce(value, _default(kind, default))
        cells.append(value.alias(name))
    reason = F.nullif(F.concat_ws(", ", *absent), F.lit("")) if absent else F.lit(None)
    return rows.select(*keys, *cells, reason.cast("string").alias("reason"))


def conform_json(rows: DataFrame, payload: str, model: str, keys: list[str]) -> DataFrame:
    """The same for one JSON object per row; fields of the wrong type count as absent."""
    fields = schemas.MODELS[model]
    value = rows.select(*keys, F.try_parse_json(payload).alias("_v"))
    cells = [F.try_variant_get("_v", f"$.{n}", kind).alias(n) for n, (kind, _) in fields.items()]
    return conform(value.select(*keys, *cells), model, keys)


def split_valid(conformed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows)."""
    valid = conformed.filter(F.col("reason").isNull()).drop("reason")
    return valid, conformed.filter(F.col("reason").isNotNull())
