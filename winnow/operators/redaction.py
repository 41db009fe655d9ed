"""Personal data: listing and redacting it, both from the same spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from winnow.functions import pii
from winnow.operators import skills as s

_NAMED_ENTITIES = ["PERSON", "LOCATION"]


def name_values(docs: DataFrame, id: str, text: str, gazetteer: DataFrame) -> DataFrame:
    """(id, entity_type, value) for gazetteer entries (term, entity_type) in the text, once each.

    Spelling counts, so that a name is not found in an ordinary word.
    """
    found = s.tag_terms(
        docs, id, text, gazetteer, "term", s.NAME_TOKEN, ignore_case=False, keep=("entity_type",)
    )
    return found.select(id, "entity_type", F.col("term").alias("value"))


def _with_spans(docs: DataFrame, id: str, text: str, gazetteer: DataFrame | None) -> DataFrame:
    """Documents with `_spans`: what patterns and listed names find, overlaps joined, in order.

    A document none of whose words starts a listed name, by a filter of fixed
    size, is read where it lies. The others meet the names found in them by
    id, once; only their texts are shuffled, and names that come with
    another document of the same id do no harm, as the text is searched.
    """
    found = pii.pattern_spans(F.col(text))
    if gazetteer is None:
        return docs.withColumn("_spans", pii.joined_spans(found))
    may = s.may_hold_terms(F.col(text), gazetteer, "term", s.NAME_TOKEN, ignore_case=False)
    plain = docs.filter(~may).withColumn("_spans", pii.joined_spans(found))
    named = docs.filter(may)
    lists = [F.collect_set(F.when(F.col("entity_type") == e, F.col("value"))).alias("_" + e) for e in _NAMED_ENTITIES]
    names = name_values(named, id, text, gazetteer).groupBy(F.col(id).alias("_id")).agg(*lists)
    spans = F.concat(found, *[pii.name_spans(F.col(text), F.col("_" + e), e) for e in _NAMED_ENTITIES])
    held = named.join(names, F.col(id).eqNullSafe(F.col("_id")), "left").withColumn("_spans", pii.joined_spans(spans))
    return plain.unionByName(held.select(*docs.columns, "_spans"))


def pii_spans(docs: DataFrame, id: str, text: str, gazetteer: DataFrame | None = None) -> DataFrame:
    """(id, entity_type, start_at, end_at, value): the spans that `redact` replaces; places count characters from 0, the end is exclusive."""
    rows = _with_spans(docs, id, text, gazetteer)
    value = F.transform(
        "_spans", lambda p: F.struct(p["entity_type"], p["start"], p["end"], F.substring(F.col(text), p["start"] + 1, p["end"] - p["start"]).alias("value"))
    )
    listed = rows.select(id, F.explode(value).alias("s"))
    return listed.select(id, "s.entity_type", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), "s.value")


def redact(docs: DataFrame, id: str, text: str, gazetteer: DataFrame | None = None) -> DataFrame:
    """Replace personal data by its entity name; `pii_scrubbed` is false for an empty text."""
    rows = _with_spans(docs, id, text, gazetteer)
    return (
        rows.withColumn("pii_scrubbed", F.coalesce(F.col(text), F.lit("")) != "")
        .withColumn(text, pii.splice(F.col(text), F.col("_spans")))
        .drop("_spans")
    )
