"""Personal-data patterns, and spans of text with their places.

A span is a struct (start, end, entity_type) in characters from 0, the end
exclusive. Spans that overlap are joined into one, which bears the type of its
longest part; so nothing that any pattern finds is left in the open. Listing
and redacting use the same joined spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Written for both Java and RE2, so no look-around here.
PATTERNS = {
    "EMAIL_ADDRESS": "[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{2,}",
    "PHONE_NUMBER": "\\+?[0-9]{1,2}[ .-]?\\([0-9]{3}\\)[ .-]?[0-9]{3}[ .-][0-9]{4}"
    "|\\([0-9]{3}\\)[ .-]?[0-9]{3}[ .-][0-9]{4}"
    "|\\+[0-9]{1,3}[ .-][0-9]{2,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4}"
    "|\\+[0-9]{10,14}\\b"
    "|\\b[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\\b"
    "|\\b0[0-9]{2,4} [0-9]{3,4} [0-9]{3,4}\\b",
    "UK_NINO": "(?i:\\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]\\b)",
}
# Prefixes never issued, so such a string is no insurance number.
NINO_UNUSED_PREFIXES = ["BG", "GB", "NK", "KN", "NT", "TN", "ZZ"]

# The same matches, but a long run of letters (base64, say) is tried once and not from each letter.
_JAVA_PATTERNS = dict(
    PATTERNS,
    EMAIL_ADDRESS="(?:\\G|(?<![A-Za-z0-9]))" + PATTERNS["EMAIL_ADDRESS"].replace("-]*@", "-]*+@"),
    UK_NINO=PATTERNS["UK_NINO"].replace("\\b[", f"\\b(?!{'|'.join(NINO_UNUSED_PREFIXES)})[", 1),
)
SPANS = "array<struct<start:int,end:int,entity_type:string>>"
# Spans that are summed, joined or spliced together in one step.
_BLOCK = 256


def placeholder(entity: str) -> str:
    return f"<{entity}>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Work a value out once for an expression that names it more often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _none(kind: str = SPANS) -> Column:
    return F.array().cast(kind)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _running(values: Column, of: Callable[[Column], Column]) -> Column:
    """Sums, or maxima, of the values up to and with each: `of` gives one of a whole array.

    Blocks are taken together first, so many values take little more time each.
    """

    def in_blocks(blocks: Column) -> Column:
        whole = F.transform(blocks, of)
        return _let(whole, lambda whole: F.flatten(F.transform(blocks, lambda block, b: within(block, before(whole, b)))))

    def before(whole: Column, b: Column) -> Column:
        return F.coalesce(of(F.slice(whole, F.lit(1), b)), F.lit(0))

    def within(block: Column, start: Column) -> Column:
        return _let(start, lambda s: F.transform(block, lambda _, i: of(F.concat(F.array(s), F.slice(block, F.lit(1), i + 1)))))

    def cut(values: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))
        return F.transform(places, lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))

    return _let(values, lambda values: _let(cut(values), in_blocks))


def spans_of(text: Column, pattern: Column, entity: str) -> Column:
    """The spans that a pattern finds from left to right: the text is cut at them, and what lies before each is summed."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))

    def placed(values: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        lengths = F.zip_with(
            values,
            F.slice(gaps, F.lit(1), F.size(values)),
            lambda v, gap: F.struct(F.length(v).alias("own"), (F.length(v) + F.length(gap)).alias("both")),
        )
        ends = _running(F.transform(lengths, lambda n: n["both"]), _sum)
        return F.zip_with(
            ends,
            lengths,
            lambda end, n: F.struct((end - n["own"]).alias("start"), end.alias("end"), F.lit(entity).alias("entity_type")),
        )

    return _let(found, lambda values: F.when(F.size(values) > 0, placed(values)).otherwise(_none()))


def pattern_spans(text: Column) -> Column:
    """The spans of all patterns; a null text has none."""
    return F.concat(*[spans_of(text, F.lit(pattern), entity) for entity, pattern in _JAVA_PATTERNS.items()])


def name_spans(text: Column, names: Column, entity: str) -> Column:
    """The spans of each of the given names as whole words. A text has few names, so each is looked for by itself."""

    def of(name: Column) -> Column:
        # What lies between the words of a name is free, as it is where names are found.
        words = F.array_join(F.regexp_extract_all(name, F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)), "[^\\p{L}\\p{N}_]+")
        pattern = F.concat(F.lit("(?<![\\p{L}\\p{N}_])"), words, F.lit("(?![\\p{L}\\p{N}_])"))
        return spans_of(text, pattern, entity)

    return F.coalesce(F.flatten(F.transform(names, of)), _none())


def joined_spans(spans: Column) -> Column:
    """Spans in order, those that overlap as one with the type of its longest part."""
    return _let(spans, lambda found: F.when(F.size(found) > 1, _joined(found)).otherwise(found))


def _joined(spans: Column) -> Column:
    """A span that starts where none before it reaches begins a new one, which goes on up to the next such."""

    def with_reach(found: Column) -> Column:
        reach = _running(F.transform(found, lambda s: s["end"]), F.array_max)
        return _let(reach, lambda reach: _cut(found, reach))

    def _cut(found: Column, reach: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(found) - 1)
        heads = F.filter(places, lambda i: (i == 0) | (F.get(found, i)["start"] >= F.get(reach, i - 1)))

        def one(heads: Column, head: Column, k: Column) -> Column:
            behind = F.coalesce(F.get(heads, k + 1), F.size(found))
            sizes = F.transform(
                F.slice(found, head + 1, behind - head),
                lambda s, i: F.struct((s["end"] - s["start"]).alias("size"), (-i).alias("first"), s["entity_type"].alias("entity_type")),
            )
            return F.struct(
                F.get(found, head)["start"].alias("start"),
                F.get(reach, behind - 1).alias("end"),
                F.array_max(sizes)["entity_type"].alias("entity_type"),
            )

        return _let(heads, lambda heads: F.transform(heads, lambda head, k: one(heads, head, k)))

    return _let(F.array_sort(spans), with_reach)


def splice(text: Column, spans: Column) -> Column:
    """The text with each span, in order and without overlaps, replaced by its type's placeholder.

    The text is first cut before every `_BLOCK` spans, so that a place is looked
    for in a piece of the text.
    """

    def piece(block: Column) -> Column:
        own = F.slice(spans, block * _BLOCK + 1, F.lit(_BLOCK))
        start = F.when(block == 0, 0).otherwise(F.get(spans, block * _BLOCK - 1)["end"])
        return _let(
            F.struct(own.alias("own"), start.alias("start"), F.substring(text, start + 1, F.get(own, F.size(own) - 1)["end"] - start).alias("text")),
            lambda p: F.array_join(
                F.transform(
                    p["own"],
                    lambda s, i: F.concat(
                        _between(p, F.when(i == 0, p["start"]).otherwise(F.get(p["own"], i - 1)["end"]), s["start"]),
                        F.lit("<"),
                        s["entity_type"],
                        F.lit(">"),
                    ),
                ),
                "",
            ),
        )

    def _between(p: Column, start: Column, end: Column) -> Column:
        return F.substring(p["text"], start - p["start"] + 1, end - start)

    blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _BLOCK).cast("int"))
    rest = F.substring(text, F.get(spans, F.size(spans) - 1)["end"] + 1, F.length(text))
    whole = F.concat(F.array_join(F.transform(blocks, piece), ""), rest)
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact_patterns(text: Column) -> Column:
    """The text with what the patterns find replaced."""
    spans = F.coalesce(joined_spans(pattern_spans(text)), _none())
    return _let(spans, lambda found: splice(text, found))
