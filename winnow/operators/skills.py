"""Skill matching, all-pairs screening and tagging of free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from winnow import fixed_values as fixed
from winnow.functions import text as t
from winnow.operators.grouping import for_skewed_join

# A word of a skill or name: letters, digits, '_', '+', '#', inner dots (node.js) and a leading one (.NET).
SKILL_TOKEN = "(?:(?<![\\p{L}\\p{N}_+#.])\\.(?=\\p{L}))?[\\p{L}\\p{N}_+#]+(?:\\.[\\p{L}\\p{N}_+#]+)*"
NAME_TOKEN = "[\\p{L}\\p{N}_]+"


# --- one application per row -------------------------------------------------
def skill_overlap(required: Column, candidate: Column) -> Column:
    """Distinct normalised skills that both lists hold."""
    return F.array_intersect(t.norm_skills(required), t.norm_skills(candidate))


def exact_matched(required: Column, overlap: Column) -> Column:
    """Required skills that are matched, in their own order, spelling and number."""
    return F.filter(required, lambda s: F.array_contains(overlap, t.norm_skill(s)))


def skill_score(overlap: Column, required_norm: Column) -> Column:
    """Share of the distinct required skills that are matched; 0.0 if none is required."""
    share = F.try_divide(F.size(overlap).cast("double"), F.size(required_norm).cast("double"))
    return F.coalesce(share, F.lit(0.0))


def missing_skills(required: Column, candidate: Column) -> Column:
    """Normalised required skills without a match, in required order."""
    return F.array_except(t.norm_skills(required), t.norm_skills(candidate))


def match_skills(applications: DataFrame, resumes: DataFrame, jds: DataFrame) -> DataFrame:
    """Screen the listed (resume_id, jd_id) pairs.

    The lists are normalised once per resume and once per JD, then meet in one
    row, so matching needs no shuffle beyond the two id joins. The short lists
    of the JDs come first, so the resumes' long ones move once. Added are
    matched_skills (as required), missing_skills (normalised), n_required,
    n_matched and skill_match. Pairs without any match keep their row. A JD
    that many resumes apply to makes one hot key of small rows with one row on
    the other side, which is what the adaptive skew join splits.
    """
    candidates = resumes.withColumn("_candidate", t.norm_skills(F.col("candidate_skills")))
    required = jds.withColumn("_required", t.norm_skills(F.col("required_skills")))
    pairs = applications.join(required, "jd_id", "left").join(candidates, "resume_id", "left")
    none = F.array().cast("array<string>")
    pairs = pairs.withColumn(
        "_overlap",
        F.array_intersect(F.coalesce("_required", none), F.coalesce("_candidate", none)),
    )
    return (
        pairs.withColumn("matched_skills", exact_matched(F.col("required_skills"), F.col("_overlap")))
        .withColumn("missing_skills", F.array_except(F.coalesce("_required", none), F.col("_overlap")))
        .withColumn("n_required", F.size(F.coalesce("_required", none)))
        .withColumn("n_matched", F.size("_overlap"))
        .withColumn("skill_match", skill_score(F.col("_overlap"), F.coalesce("_required", none)))
        .drop("_candidate", "_required", "_overlap")
    )


# --- every resume against every JD ------------------------------------------
def screen_all(
    resumes: DataFrame, jds: DataFrame, min_score: float = fixed.SHORTLIST_MIN_SCORE
) -> DataFrame:
    """All (resume, JD) pairs with skill_match >= min_score, without forming all pairs.

    A JD with n skills needs k = ceil(min_score * n) of them, so every match
    holds at least m of the JD's n - k + m rarest skills, for any m up to k.
    With m a third of k, only those are looked up among the resumes; the
    skills that everyone has are not. The few pairs with m hits are then
    scored exactly from the two lists.
    """
    if not 0.0 < min_score <= 1.0:
        raise ValueError("min_score must be in (0, 1]")
    required_norm = t.norm_skills(F.col("required_skills"))
    required = jds.select("jd_id", required_norm.alias("required"))
    asked = jds.select("jd_id", F.explode(required_norm).alias("skill"))

    # What each resume holds of the skills that any JD asks for. The three uses
    # below share this one shuffle, so the resumes are read and normalised once.
    held = resumes.select("resume_id", F.explode(t.norm_skills(F.col("candidate_skills"))).alias("skill"))
    candidate = (
        held.join(for_skewed_join(asked.select("skill").distinct(), "skill"), "skill", "left_semi")
        .groupBy("resume_id")
        .agg(F.collect_list("skill").alias("candidate"))
    )
    postings = candidate.select("resume_id", F.explode(F.concat("candidate", F.array())).alias("skill"))
    frequency = postings.groupBy("skill").agg(F.count("*").alias("holders"))
    rarest_first = (
        asked.join(for_skewed_join(frequency, "skill"), "skill")  # a skill nobody holds finds nobody
        .groupBy("jd_id")
        .agg(F.array_sort(F.collect_list(F.struct("holders", "skill"))).alias("ranked"))
        .join(required.select("jd_id", F.size("required").alias("n")), "jd_id")
    )
    needed = F.greatest(F.ceil(F.col("n") * F.lit(min_score) - 1e-9).cast("int"), F.lit(1))
    least = F.greatest(F.floor(needed / 3).cast("int"), F.lit(1))
    # Skills that nobody holds are the rarest; they use up part of the prefix.
    prefix = F.greatest(F.size("ranked") - needed + least, F.lit(0))
    probes = rarest_first.select(
        "jd_id", least.alias("least"), F.explode(F.slice("ranked", F.lit(1), prefix)["skill"]).alias("skill")
    )
    found = (
        postings.join(probes, "skill")
        .groupBy("resume_id", "jd_id", "least")
        .agg(F.count("*").alias("hits"))
        .filter(F.col("hits") >= F.col("least"))
        .select("resume_id", "jd_id")
    )
    overlap = F.size(F.array_intersect("candidate", "required"))  # hashes the second, the short one
    return (
        found.join(required, "jd_id")
        .join(for_skewed_join(candidate, "resume_id"), "resume_id")
        .select(
            "resume_id",
            "jd_id",
            overlap.alias("n_matched"),
            F.size("required").alias("n_required"),
        )
        .withColumn("skill_match", F.col("n_matched") / F.col("n_required"))
        .filter(F.col("skill_match") >= min_score)
    )


# --- tagging -------------------------------------------------------------------
# Slots, of a byte each, of the filter of starts.
_START_SLOTS = 1 << 19


def _start_slot(word: Column, n: Column | int) -> Column:
    return F.pmod(F.xxhash64(word, F.lit(n) if isinstance(n, int) else n), F.lit(_START_SLOTS)).cast("int")


def _starts(terms: DataFrame) -> dict[int, bytes]:
    """Per number of words, a filter of fixed size: 1 in the slots of words that start a term of so many words.

    The lexicon is read for it. The more terms there are, the less it tells.
    """
    slots = terms.select("_n", _start_slot(F.element_at("_words", 1), F.col("_n")).alias("slot")).groupBy("_n")
    found = {}
    for n, held in slots.agg(F.collect_set("slot")).collect():
        filled = bytearray(_START_SLOTS)
        for slot in held:
            filled[slot] = 1
        found[n] = bytes(filled)
    return found


def _lexicon(lexicon: DataFrame, term: str, keep: tuple[str, ...], words) -> DataFrame:
    """(term, kept, _words, _n, _gram): each term with its words."""
    return (
        lexicon.select(term, *keep)
        .distinct()
        .withColumn("_words", words(F.col(term)))
        .filter(F.size("_words") > 0)
        .select(term, *keep, "_words", F.size("_words").alias("_n"), F.array_join("_words", " ").alias("_gram"))
    )


def _grams(words: Column, starts: dict[int, bytes]) -> Column:
    """The distinct n-grams of the words that may be terms: those whose first word starts a term of that length."""
    if not starts:
        return F.array().cast("array<string>")

    def of(n: int) -> Column:
        def may_start(word: Column) -> Column:
            return F.substring(F.lit(starts[n]), _start_slot(word, n) + 1, F.lit(1)) == F.lit(b"\x01")

        if n == 1:
            return F.filter(words, may_start)
        places = F.filter(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: may_start(F.element_at(words, i)))
        grams = F.transform(places, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in sorted(starts)]))


def tag_terms(
    docs: DataFrame,
    id: str,
    text: str,
    lexicon: DataFrame,
    term: str,
    token: str = SKILL_TOKEN,
    ignore_case: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, term, kept lexicon columns) for every lexicon term in the text as whole words.

    Of a document's words only those that start a term, by a filter of fixed
    size, are made into n-grams, of the lengths of the terms that they start.
    These few, distinct within the document, meet the lexicon by equality. Only
    ids travel. The lexicon is not forced to be broadcast; Spark does so when
    its measured size allows.
    """

    def words(of: Column) -> Column:
        return F.regexp_extract_all(F.lower(of) if ignore_case else of, F.lit(token), F.lit(0))

    terms = _lexicon(lexicon, term, keep, words)
    cut = docs.select(id, words(F.col(text)).alias("_words"))
    # The array is exploded as an expression, not as a column: for a column Spark
    # would add a size filter below it that works the whole array out again.
    found = cut.select(id, F.explode(_grams(F.col("_words"), _starts(terms))).alias("_gram"))
    return found.join(terms.drop("_n", "_words"), "_gram").select(id, term, *keep)


def may_hold_terms(
    text: Column, lexicon: DataFrame, term: str, token: str = SKILL_TOKEN, ignore_case: bool = True
) -> Column:
    """Whether any word of the text starts a term, by the filter of starts: false only for texts that hold none."""

    def words(of: Column) -> Column:
        return F.regexp_extract_all(F.lower(of) if ignore_case else of, F.lit(token), F.lit(0))

    starts = _starts(_lexicon(lexicon, term, (), words))
    held = F.transform(F.array(words(text)), lambda w: F.size(_grams(w, starts)))
    return F.coalesce(F.get(held, F.lit(0)), F.lit(0)) > 0


def tag_skills(docs: DataFrame, id: str, text: str, lexicon: DataFrame, skill: str = "skill") -> DataFrame:
    """Lexicon skills named in the text."""
    return tag_terms(docs, id, text, lexicon, skill)


def tag_roles(docs: DataFrame, id: str, text: str, roles: DataFrame, role: str = "role") -> DataFrame:
    """Job titles named in the text."""
    return tag_terms(docs, id, text, roles, role)


# --- lists -----------------------------------------------------------------------
def merge_roles(new: Column, old: Column) -> Column:
    """New roles first, then the old ones, first occurrence kept; defaults stand in for no old roles."""
    defaults = F.array(*[F.lit(r) for r in fixed.DEFAULT_ROLES])
    none = F.array().cast("array<string>")
    kept = F.when(F.size(F.coalesce(old, none)) > 0, old).otherwise(defaults)
    return F.array_distinct(F.concat(F.coalesce(new, none), kept))


def resolve_skills(rows: DataFrame, sources: list[str] = fixed.SKILL_SOURCES) -> Column:
    """The skills of the first source that holds any, among the columns the rows have.

    A list gives its items stripped, null and '' left out; a text is split at
    commas and loses its blanks. The first two sources count only as lists.
    """

    def kind_of(name: str) -> str:
        kind = rows.schema
        for part in name.split("."):
            if not hasattr(kind, "names") or part not in kind.names:
                return ""
            kind = kind[part].dataType
        return kind.simpleString()

    found = []
    for name in sources:
        kind = kind_of(name)
        allowed = F.lit(True)
        if name.startswith("resume_analysis.") and "resume_data" in rows.columns:
            allowed = F.col("resume_data").isNull()  # the analysis only stands in for the data
        if kind == "array<string>":
            items = F.filter(F.col(name), lambda s: s.isNotNull() & (s != ""))
            found.append(F.when(allowed & (F.size(F.col(name)) > 0), F.transform(items, t.strip)))
        elif kind == "string" and name not in fixed.LIST_ONLY_SOURCES:
            found.append(F.when(allowed & (F.col(name) != ""), t.parse_list(F.col(name), ",")))
    return F.coalesce(*found, F.array().cast("array<string>"))
