"""Personal data by pattern, and the words near it that give it away, told from co-occurrence in the whole corpus.

What is protected is each e-mail address, network address, card number and
phone number that the patterns find. A term near one discloses it as far as
knowing the term says that the entity is there: with probabilities over the
documents of the corpus, the pointwise mutual information of term and entity,
as a part of the entity's own information,

    ratio = log(N n(c,t) / (n(c) n(t))) / log(N / n(c)),

which is 1 where the term occurs nowhere but with the entity and 0 where the
two know nothing of each other. From `remove_at` on a term is removed, from
`generalise_at` on it is replaced by its kind. A pair that fewer than `support`
different texts hold is no evidence (a word that occurs once discloses by
chance whatever it stands beside), and exact copies are one text.

n(c) and n(t) are the documents that hold an entity or a term, n(c,t) those
that hold the term within `reach` terms of the entity. A term is a run of
letters and digits of any script, in ASCII lower case; what touches a span found
by pattern is no term. Disclosing terms are covered wherever they stand in a text that
holds the entity.

Nulls: a null text is empty and holds nothing. Repeated rows are counted and
returned as often as they come; ids may be null or repeat, since what is found
depends on the text alone. An empty table gives no rows. Columns that aren't
asked for are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from winnow.llm.common import stored, text_or_empty

REACH = 10
SUPPORT = 3
REMOVE_AT = 0.9
GENERALISE_AT = 0.75
TERMS_TOGETHER = 500_000
KINDS = ("email", "ip", "card", "phone")
# Kinds of what the co-occurrences add, after those of the patterns.
ADDED = ("generalised", "removed")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost matches, in linear time: an address is looked for from its @ outwards."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def _luhn(digits: str) -> bool:
    return sum(_DOUBLED[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _below_256(part: str) -> bool:
    return len(part := part.lstrip("0")) < 4 and int(part or "0") < 256


def spans_of(text: str) -> dict[str, list[Span]]:
    """The spans of each kind, in order; those of one kind don't overlap, and a match that fails its test is dropped."""
    return {
        "email": emails(text),
        "ip": [m.span() for m in _IP.finditer(text) if all(map(_below_256, m.groups()))],
        "card": [m.span() for m in _CARD.finditer(text) if m.end() - m.start() > 15 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15],
    }


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in spans for start, end in spans[kind])


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _digits(value)}"


def terms_of(text: str, spans: dict[str, list[Span]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the terms that touch no span."""
    covered = sorted(s for found in spans.values() for s in found)
    ends, most = [], 0
    for _, end in covered:
        ends.append(most := max(most, end))
    starts = [s for s, _ in covered]
    out = []
    for m in _TERM.finditer(text):
        before = bisect_left(starts, m.end())  # spans that start before the term's end
        if not (before and ends[before - 1] > m.start()):
            out.append((_lower(m[0]), *m.span()))
    return out


def _lower(term: str) -> str:
    return term.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def contexts_of(text: str, spans: dict[str, list[Span]], reach: int) -> dict[str, set[str]]:
    """The terms within `reach` of each entity, on either side."""
    terms = terms_of(text, spans)
    starts, found = [t[1] for t in terms], {}
    for kind, own in spans.items():
        for start, end in own:
            at = bisect_left(starts, start)
            near = found.setdefault(_entity(kind, text[start:end]), set())
            near.update(t for t, *_ in terms[max(0, at - reach) : at + reach])
    return found


_FOUND = pa.schema(
    [("what", pa.string()), ("at", pa.int64()), ("key", pa.binary()), ("text", pa.string()), ("spans", pa.string())]
    + [(f"n_{k}", pa.int64()) for k in KINDS]
    + [("entity", pa.string()), ("term", pa.string()), ("n", pa.int64())]
)


def _scanner(reach: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            rows: list[dict] = []
            for number, text in enumerate(batch.column("text").to_pylist()):
                counts.update(set(_TERM.findall(_lower(text))))
                spans = spans_of(text)
                row = {"what": "text", "at": number, "spans": _joined(spans)} | {f"n_{k}": len(spans[k]) for k in KINDS}
                rows.append(row)
                if row["spans"]:
                    row |= {"key": hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), "text": text}
                    for entity, terms in contexts_of(text, spans, reach).items():
                        rows += [{"what": "pair", "key": row["key"], "entity": entity, "term": t} for t in (None, *terms)]
            yield _beside(batch, rows)
            if len(counts) > TERMS_TOGETHER:
                yield _beside(batch, [{"what": "term", "term": t, "n": n} for t, n in counts.items()])
                counts = Counter()
        if counts:
            yield _beside(batch, [{"what": "term", "term": t, "n": n} for t, n in counts.items()])

    return scan


def _beside(batch: pa.RecordBatch, rows: list[dict]) -> pa.RecordBatch:
    """The rows found, each with the carried columns of the row at its place; null for what belongs to no row."""
    found = pa.RecordBatch.from_pylist(rows, schema=_FOUND)
    names = [n for n in _FOUND.names if n != "at"]
    carried = batch.column("row").take(found.column("at"))
    return pa.RecordBatch.from_arrays([*map(found.column, names), carried], names=[*names, "row"])


def _with_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add the spans of disclosing terms to those of the patterns."""
    for rows in batches:
        spans = []
        for text, base, generalised, removed in zip(rows["text"], rows["spans"], rows["generalised"], rows["removed"], strict=True):
            found = _parsed(base)
            added = {"generalised": set(() if generalised is None else generalised), "removed": set(() if removed is None else removed)}
            added["generalised"] -= added["removed"]
            terms = terms_of(text, found) if any(added.values()) else ()
            more = {kind: [(s, e) for t, s, e in terms if t in wanted] for kind, wanted in added.items()}
            spans.append(",".join(filter(None, [base, _joined(more)])))
        yield rows.drop(columns=["text", "generalised", "removed"]).assign(spans=spans)


def _parsed(spans: str) -> dict[str, list[Span]]:
    found: dict[str, list[Span]] = {}
    for part in filter(None, spans.split(",")):
        kind, start, end = part.split(":")
        found.setdefault(kind, []).append((int(start), int(end)))
    return found


def disclosing(pairs: DataFrame, terms: DataFrame, documents: int, support: int, generalise_at: float) -> DataFrame:
    """(entity, term, n_entity, n_term, n_both, ratio) of the pairs that say enough.

    `pairs` has a row per document, entity and term near it, and one with a
    null term per document and entity; `terms` counts documents per term.
    """
    by_text = pairs.groupBy("entity", "term", "key").agg(F.count("*").alias("n"))
    both = by_text.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("n_texts"))
    entities = both.filter("term IS NULL").select("entity", F.col("n_both").alias("n_entity"))
    often = both.filter(F.col("term").isNotNull() & (F.col("n_texts") >= support))
    whole = terms.groupBy("term").agg(F.sum("n").alias("n_term"))
    joined = often.join(entities, "entity").join(whole, "term")
    n = F.lit(float(documents))
    own = F.log(n / F.col("n_entity"))
    mutual = F.log(n * F.col("n_both") / F.col("n_entity") / F.col("n_term"))
    # An entity that every document holds has nothing left to disclose.
    ratio = F.when(own > 0, mutual / own).otherwise(F.lit(0.0))
    known = joined.withColumn("ratio", ratio).filter(F.col("ratio") >= generalise_at)
    return known.select("entity", "term", "n_entity", "n_term", "n_both", "ratio")


def find(
    docs: DataFrame,
    carry: tuple[str, ...] = ("doc_id",),
    reach: int = REACH,
    support: int = SUPPORT,
    generalise_at: float = GENERALISE_AT,
    remove_at: float = REMOVE_AT,
) -> DataFrame:
    """(row, n_email, n_ip, n_card, n_phone, base_spans, spans), one per row of `docs`; `row` has the columns to carry.

    Spans are written kind:start:end and joined by commas, by kind (those of the
    patterns, then `generalised` and `removed`), then by start; places are code
    points and ends are exclusive.

    The corpus is read once: texts that hold an entity, the pairs near entities
    and the documents per term, summed in each task, are written side by side.
    Other texts are neither kept nor moved.
    """
    given = docs.select(F.struct(*carry).alias("row"), text_or_empty().alias("text"))
    kind = given.schema["row"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    columns = f"what string, key binary, text string, spans string, {counts}, entity string, term string, n long, row {kind}"
    found = stored(given.mapInArrow(_scanner(reach), columns), "disclosure", "what")
    texts = found.filter("what = 'text'")
    base = ["row", *[f"n_{k}" for k in KINDS], F.col("spans").alias("base_spans"), "spans"]
    said = disclosing(
        found.filter("what = 'pair'").select("entity", "term", "key"),
        found.filter("what = 'term'").select("term", "n"),
        texts.count(),
        support,
        generalise_at,
    )
    said = stored(said, "disclosing")
    # Pairs that repeat with their text are looked up once; a text gets its own terms only.
    own = found.filter("what = 'pair' AND term IS NOT NULL").select("entity", "term", "key").distinct()
    per_text = own.join(said.select("entity", "term", "ratio"), ["entity", "term"]).groupBy("key", "term").agg(F.max("ratio").alias("ratio"))
    removed = F.col("ratio") >= remove_at
    lists = per_text.groupBy("key").agg(
        F.collect_list(F.when(~removed, F.col("term"))).alias("generalised"), F.collect_list(F.when(removed, F.col("term"))).alias("removed")
    )
    holding = texts.filter("key IS NOT NULL").select("key", "text", *base).join(lists, "key", "left").drop("key")
    done = holding.mapInPandas(_with_terms, f"row {kind}, {counts}, base_spans string, spans string")
    return texts.filter("key IS NULL").select(*base).unionByName(done)


def sanitised_text(text: str | None, spans: str | None) -> str | None:
    """The text with its spans covered: by their kind, or nothing where a term is removed; overlaps go to the span that starts first."""
    if text is None or not spans:
        return text
    found = _parsed(spans)
    out, end = [], 0
    for start, stop, kind in sorted((s, -e, k) for k, own in found.items() for s, e in own):
        stop = -stop
        if start < end:
            if stop > end:
                end = stop
            continue
        out.append(text[end:start])
        if kind == "generalised":
            term = text[start:stop]
            out.append("<NUMBER>" if term.isdigit() else "<CODE>" if any(c.isdigit() for c in term) else "<NAME>" if term[0].isupper() else "<WORD>")
        elif kind != "removed":
            out.append(f"<{kind.upper()}>")
        end = stop
    return "".join([*out, text[end:]])


def sanitise(text: str | Column, spans: str | Column) -> Column:
    """A text with the spans that `find` gave for it removed or generalised."""

    def covered(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([sanitised_text(t, s) for t, s in zip(texts, found, strict=True)], dtype=object)

    return F.pandas_udf(covered, StringType())(text, spans)
