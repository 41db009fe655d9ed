"""Prompt tables out, reply tables in. Model calls happen elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from winnow import schemas
from winnow.functions import replies as r
from winnow.sources.templates import require_template

# Reply kind -> model; the main field takes the raw text of a reply that cannot be parsed.
MAIN_FIELD = {
    "linkedin_reply": "about_section",
    "resume_reply": "professional_summary",
    "readme_reply": "markdown_readme",
}


def render_prompts(requests: DataFrame, templates: DataFrame, slots: dict[str, Column]) -> DataFrame:
    """Add `prompt` to requests (file, key, …) from the template each one names."""
    found = require_template(requests, templates)
    return found.withColumn("prompt", r.render_template(F.col("template"), slots)).drop("template")


def parse_reply(replies: DataFrame, kind: str, raw: str = "raw") -> DataFrame:
    """Add `parsed` and the fields of the reply model.

    A reply that is no JSON object keeps its text in the main field and leaves
    the others empty; a field the object lacks is empty.
    """
    rows = replies.withColumn("_value", r.parsed_object(F.col(raw)))
    is_object = F.col("_value").isNotNull()
    fields = []
    for name, (kind_of, _) in schemas.MODELS[kind].items():
        value = F.try_variant_get("_value", f"$.{name}", kind_of)
        if kind_of == "string":
            if name == MAIN_FIELD[kind]:
                value = F.when(is_object, value).otherwise(r.strip(F.col(raw)))
            value = F.coalesce(value, F.lit(""))
            if name in ("about_section", "markdown_readme"):
                value = r.unescape_newlines(value)
        else:
            value = F.coalesce(value, F.array().cast(kind_of))
        fields.append(value.alias(name))
    return rows.select(*replies.columns, is_object.alias("parsed"), *fields)


def with_hashtags(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("hashtags", r.hashtag_line(F.col("featured_hashtags")))
