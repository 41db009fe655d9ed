"""Column expressions over plain text. All of them stay inside the JVM."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from winnow import fixed_values as fixed

# Every character Python calls white space, from the rule rather than a list.
WHITESPACE = "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())


def _set_of(chars: str) -> str:
    """The set of these characters. Java looks those below 256 up in one table, but tries the others one by one: runs of them are ranges."""
    parts: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if code > 256 and parts and parts[-1][1] == code - 1:
            parts[-1][1] = code
        else:
            parts.append([code, code])
    return "[" + "".join("\\x{%x}" % a if a == b else "\\x{%x}-\\x{%x}" % (a, b) for a, b in parts) + "]"


SPACE = _set_of(WHITESPACE)
NON_SPACE = "[^" + SPACE[1:]


def java(pattern: str) -> str:
    """A pattern in Python's notation with the same meaning in Java's, whose \\s and \\d are
    ASCII only and whose dot stops at more than a newline. For patterns without sets of those."""
    for python, same in (("\\s", SPACE), ("\\S", NON_SPACE), (".*?", "[^\\n]*?"), ("\\d", "\\p{Nd}")):
        pattern = pattern.replace(python, same)
    return pattern


def any_of(words: list[str]) -> str:
    """Alternation of literal words as a regular expression."""
    return "|".join("".join(ch if ch.isalnum() or ch in " _" else "\\" + ch for ch in w) for w in words)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def or_default(text: Column, default: str) -> Column:
    """Null and '' both count as absent."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def cap(text: Column, chars: int) -> Column:
    return F.left(text, F.lit(chars))


# --- skills ----------------------------------------------------------------
def norm_skill(skill: Column) -> Column:
    return F.lower(strip(skill))


def norm_skills(skills: Column) -> Column:
    """Distinct normalised skills in first-seen order, blanks dropped; null becomes empty."""
    listed = F.coalesce(skills, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(listed, norm_skill), lambda s: s != ""))


def words(text: Column, min_chars: int = 1) -> Column:
    """Lower-cased letter runs of at least min_chars letters, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit("\\p{L}{%d,}" % min_chars), F.lit(0))


def query_terms(query: Column) -> Column:
    parts = F.split(F.lower(strip(query)), SPACE + "+")
    return F.filter(parts, lambda t: F.length(t) >= fixed.MIN_TERM_CHARS)


def parse_list(text: Column, separator: str) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), any_of([separator]) if separator != "\n" else "\n")
    return F.filter(F.transform(parts, strip), lambda item: item != "")


def contains_word(text: Column, needle: Column, cut: str = "") -> Column:
    """Whole-word search for a literal needle; one next to a `cut` mark doesn't count.

    The plain substring test comes first: it is cheap and spares most rows the
    compilation of a pattern of their own.
    """
    literal = F.regexp_replace(needle, "([^\\p{L}\\p{N}_])", "\\\\$1")
    before, after = (f"(?<!{cut})", f"(?!{cut})") if cut else ("", "")
    pattern = F.concat(F.lit(f"(?U){before}\\b"), literal, F.lit(f"\\b{after}"))
    return (needle != "") & F.contains(text, needle) & F.rlike(text, pattern)


# --- things said in free text ----------------------------------------------
def github_handle(text: Column) -> Column:
    found = F.regexp_extract(text, f"(?i){fixed.HANDLE_PATTERN}", 1)
    return F.nullif(found, F.lit(""))


def job_posting_id(url: Column) -> Column:
    """Numeric posting id where the address names one, else the address itself."""
    found = F.regexp_extract(url, java(fixed.POSTING_PATTERN), 1)
    return F.coalesce(F.nullif(found, F.lit("")), url)


def is_job_posting(url: Column) -> Column:
    return F.rlike(url, F.lit(java(fixed.POSTING_PATTERN)))


def years_experience(text: Column) -> Column:
    pattern = f"(?i)(?<![0-9.])([0-9]{{1,2}}(?:\\.[0-9]+)?){SPACE}*\\+?{SPACE}*(?:years|yrs)"
    stated = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_max(F.transform(stated, lambda n: n.cast("double")))


def seniority_title(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(fixed.SENIORITY_TITLE)), fixed.SENIORITY_TITLE).otherwise(
        fixed.SENIORITY_TITLE_DEFAULT
    )


def seniority_years(text: Column) -> Column:
    lowered = F.lower(text)
    years = F.lit(fixed.SENIORITY_YEARS_DEFAULT)
    for keywords, value in reversed(fixed.SENIORITY_YEARS):
        years = F.when(F.rlike(lowered, F.lit(any_of(list(keywords)))), F.lit(value)).otherwise(years)
    return years


def job_title(text: Column) -> Column:
    found = F.regexp_extract(text, "(?im)^Job Title:[ \\t]*([^\\n]+)$", 1)
    return F.nullif(strip(found), F.lit(""))


# --- lines and markdown ----------------------------------------------------
def lines_of(content: Column) -> Column:
    """Lines under universal newlines; a final newline opens no further line."""
    unified = F.regexp_replace(content, "\\r\\n?", "\n")
    return F.split(F.regexp_replace(unified, "\\n\\z", ""), "\n")


def _rewrite(pattern: str, replacement: str, needs: str, last: str) -> Callable[[Column], Column]:
    """A rewrite that is skipped where `needs` does not occur and looks no further than the `last` mark.

    Both spare work only: no match can lack the one or reach past the other.
    Without them a long line full of opening marks would be scanned to its end
    from every one of them.
    """

    def apply(text: Column) -> Column:
        rest = F.substring_index(text, last, -1)
        head = F.left(text, F.length(text) - F.length(rest))
        return F.when(
            F.contains(text, F.lit(needs)), F.concat(F.regexp_replace(head, pattern, replacement), rest)
        ).otherwise(text)

    return apply


def compress_markdown(text: Column) -> Column:
    """Six rewrites in order: images, links to their text, bare addresses, tags,
    boilerplate phrases, blank lines; then strip. Null gives ''."""
    marked = [
        _rewrite(java(fixed.IMAGE_PATTERN), "", "](", ")"),
        _rewrite(java(fixed.LINK_PATTERN), "$1", "](http", ")"),
        lambda c: F.regexp_replace(c, java(fixed.ADDRESS_PATTERN), ""),
        _rewrite(fixed.TAG_PATTERN, "", "<", ">"),
    ]
    out = F.coalesce(text, F.lit(""))
    for rewrite in marked:
        # One-element array: binds the text, so that it is worked out once per rewrite.
        out = F.get(F.transform(F.array(out), rewrite), F.lit(0))
    out = F.regexp_replace(out, f"(?iu)(?:{any_of(fixed.BOILERPLATE_PHRASES)})", "")
    return strip(F.regexp_replace(out, java(fixed.BLANK_LINES_PATTERN), "\n"))
