"""Quality rules as a short-circuit cascade, with DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from winnow.llm.common import SPACES, SPACE_RUN, stored, text_or_empty

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# The method's own rules, by name: true where the document is rejected. They
# see the columns of `with_facts`, n_lines and the text included.
RULES: dict[str, Callable[[], Column]] = {
    "symbols": lambda: F.col("n_symbols") * 10 > F.col("n_words"),
    "long_words": lambda: F.col("word_chars") > F.col("n_words") * 20,
    "short_words": lambda: F.col("word_chars") < F.col("n_words") * 2,
    "repeated_lines": lambda: F.col("n_dup_lines") * 2 > F.col("n_lines"),
    "cut_lines": lambda: F.regexp_count(F.col("_text"), F.lit("(?:\\.\\.\\.|\\x{2026})(?=\\n|\\z)")) * 10
    > F.col("n_lines") * 3,
    "few_letters": lambda: F.regexp_count(F.col("_text"), F.lit("\\p{L}")) * 10 < F.col("word_chars") * 6,
    "shouting": lambda: F.regexp_count(F.col("_text"), F.lit("\\p{Lu}")) * 10 > F.col("word_chars") * 6,
}


def with_facts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, _text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed).

    Counts are over the whole text; a null text counts as ''. `n_lines` and
    `n_dup_lines` are lines that hold a word, and those of them equal to an
    earlier one. `n_repeat_words` counts words within runs of eight that occur
    twice or more in the text. Runs are compared by 64-bit hashes and sorted
    only in texts that repeat one, so a text takes time in proportion to its
    length or, where it repeats itself, of a sort.
    """
    trimmed = F.btrim(F.col("_text"), F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    rows = docs.select(F.struct("*").alias("row"), text_or_empty(text).alias("_text"))
    rows = rows.withColumns({"_words": words, "_lines": lines})
    rows = rows.select(
        "row",
        "_text",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    # Columns used by a function of array elements are named twice, so that
    # Spark keeps them as columns and doesn't work them out for each element.
    run = F.transform(
        F.sequence(F.lit(1), F.size("_hashes") - (WINDOW - 1)),
        lambda i: F.xxhash64(F.slice(F.col("_hashes"), i, WINDOW)),
    )
    rows = rows.withColumn("_runs", F.when(F.size("_hashes") >= WINDOW, run).otherwise(F.array().cast("array<bigint>")))
    in_order = F.array_sort(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn(
        "_sorted", F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), in_order)
    )
    twice = F.filter(
        F.sequence(F.lit(0), F.size("_sorted") - 1),
        lambda j: _same(j, -1) | _same(j, 1),
    )
    rows = rows.withColumn(
        "_starts", F.array_sort(F.transform(F.when(F.size("_sorted") > 0, twice), lambda j: _sorted_at(j)["i"]))
    )
    # Runs in the order of their starts: each adds the words that the one before hasn't covered.
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    repeated = F.coalesce(F.when(F.size("_starts") > 0, covered), F.lit(0).cast("bigint"))
    rows = rows.withColumn("n_repeat_words", repeated)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return rows.withColumn("base_failed", failed).drop("_hashes", "_runs", "_sorted", "_starts")


def _sorted_at(j: Column) -> Column:
    return F.get(F.col("_sorted"), j)


def _same(j: Column, step: int) -> Column:
    return F.coalesce(_sorted_at(j)["h"] == _sorted_at(j + step)["h"], F.lit(False))


def rule_order(facts: DataFrame, rules: dict[str, Callable[[], Column]]) -> list[str]:
    """The rules by rejections per second on the given sample, most first.

    Each rule is timed by a pass of its own over the sample, less what a pass
    without a rule takes. The order decides how much work is saved, never which
    documents are kept.
    """
    rows = facts.cache()
    try:
        rows.count()
        nothing = min(_timed(rows, F.lit(False))[0] for _ in range(2))
        found = {}
        for name, rule in rules.items():
            seconds, rejected = min(_timed(rows, rule()) for _ in range(2))
            found[name] = rejected / max(seconds - nothing, 1e-3)
    finally:
        rows.unpersist()
    return sorted(rules, key=lambda name: -found[name])


def _timed(rows: DataFrame, rule: Column) -> tuple[float, int]:
    started = time.perf_counter()
    rejected = rows.agg(F.sum(F.coalesce(rule, F.lit(False)).cast("int"))).first()[0] or 0
    return time.perf_counter() - started, rejected


def sample_of(docs: DataFrame, rows: int, seed: int) -> DataFrame:
    """About so many rows, drawn with a probability that follows from the count."""
    count = docs.count()
    return docs.sample(min(1.0, rows / max(count, 1)), seed)


def judge(
    docs: DataFrame,
    text: str = "text",
    rules: dict[str, Callable[[], Column]] = RULES,
    sample_rows: int = 1000,
    seed: int = 0,
) -> DataFrame:
    """`with_facts` with `failed_rule`, the first rule that rejects a document, and `kept`.

    The base rules come first; the others in the order that `rule_order` finds
    on a sample of about `sample_rows` documents. A document that one rule
    rejects isn't put to the next. Rules that give null don't reject. Texts
    that are null, empty or of white space fail the base rules; repeated rows
    are judged alike; other columns stay in `row` untouched.
    """
    sample = stored(sample_of(docs.select(text), sample_rows, seed), "rule-sample")
    order = rule_order(with_facts(sample, text).drop("row"), rules)
    cascade = F.when(F.col("base_failed"), "base")
    for name in order:
        cascade = cascade.when(rules[name](), name)
    # Spark would work the facts out again, inside their own array functions, for
    # a filter that it moves below them; it moves none past a row's number.
    judged = with_facts(docs, text).withColumn("_here", F.monotonically_increasing_id())
    judged = judged.withColumn("failed_rule", cascade)
    return judged.withColumn("kept", F.col("failed_rule").isNull() & (F.col("_here") >= 0))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, columns unchanged."""
    return judge(docs, text).filter("kept").select("row.*")
