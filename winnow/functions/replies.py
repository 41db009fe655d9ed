"""Repair of model replies and rendering of prompt templates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from winnow.functions.text import strip


def strip_fence(raw: Column) -> Column:
    """Take a leading ```json or ``` and a closing ``` off."""
    out = strip(F.coalesce(raw, F.lit("")))
    out = F.regexp_replace(out, "\\A```json", "")
    out = F.regexp_replace(out, "\\A```", "")
    out = F.regexp_replace(out, "```\\z", "")
    return strip(out)


def parsed_object(raw: Column) -> Column:
    """Variant of the reply, or null when it is not a JSON object."""
    value = F.try_parse_json(strip_fence(raw))
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), value)


def unescape_newlines(text: Column) -> Column:
    return strip(F.replace(text, F.lit("\\n"), F.lit("\n")))


def hashtag_line(tags: Column) -> Column:
    kept = F.filter(tags, lambda tag: strip(tag) != "")
    marked = F.transform(kept, lambda tag: F.concat(F.lit("#"), strip(F.replace(tag, F.lit("#"), F.lit("")))))
    return F.coalesce(F.array_join(marked, " "), F.lit(""))


def render_template(template: Column, slots: dict[str, Column]) -> Column:
    """Fill {name} slots; '{{' and '}}' are literal braces.

    The template is cut into pieces once and the pieces are joined, so a value
    that itself holds braces or slot names is never looked at again.
    """
    pieces = F.regexp_extract_all(
        template, F.lit("\\{\\{|\\}\\}|\\{[A-Za-z_][A-Za-z0-9_]*\\}|[^{}]+|[{}]"), F.lit(0)
    )

    def fill(piece: Column) -> Column:
        out = F.when(piece == "{{", F.lit("{")).when(piece == "}}", F.lit("}"))
        for name, value in slots.items():
            out = out.when(piece == "{%s}" % name, F.coalesce(value.cast("string"), F.lit("None")))
        unknown = F.raise_error(F.concat(F.lit("no value for template slot "), piece)).cast("string")
        return out.when(F.rlike(piece, F.lit("[{}]")), unknown).otherwise(piece)

    return F.array_join(F.transform(pieces, fill), "")
