"""Prompt templates kept as a table (file, key, template)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def require_template(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Attach the template each request names by (file, key); a missing or empty one is an error.

    Templates may be many, so no side is forced to be broadcast: Spark does
    that by itself when the measured size allows.
    """
    joined = requests.join(templates.select("file", "key", "template"), ["file", "key"], "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no template for"), F.col("file"), F.col("key")))
    found = F.when(
        F.coalesce(F.col("template"), F.lit("")) == "", missing.cast("string")
    ).otherwise(F.col("template"))
    return joined.withColumn("template", found)
