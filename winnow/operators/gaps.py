"""Gap report for rejected applications, audited once for synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from winnow import fixed_values as fixed
from winnow.functions import text as t
from winnow.operators import skills as s
from winnow.operators.grouping import for_skewed_join
from winnow.operators.ordering import written


def missing_rows(matched: DataFrame, keys: list[str]) -> DataFrame:
    """One row per missing skill of matched applications."""
    listed = matched.select(*keys, F.explode_outer("missing_skills").alias("skill"))
    return listed.filter(F.col("skill").isNotNull())


def covered_skills(aliases: DataFrame, resumes: DataFrame) -> DataFrame:
    """(resume_id, covered): skills the resume names by an alias.

    `aliases` is (skill, alias); `resumes` is (resume_id, resume_text). One
    tagging pass finds the aliases and brings their skills along. A resume's
    list is bounded by the words it has.
    """
    known = aliases.select(t.norm_skill(F.col("skill")).alias("skill"), t.norm_skill(F.col("alias")).alias("alias"))
    found = s.tag_terms(resumes, "resume_id", "resume_text", known, "alias", keep=("skill",))
    return found.groupBy("resume_id").agg(F.collect_set("skill").alias("covered"))


def audit_gaps(rows: DataFrame, aliases: DataFrame, resumes: DataFrame) -> DataFrame:
    """Add `overlooked`: missing skills (resume_id, missing_skills, …) the resume has by another name.

    Only resumes of rows with missing skills are looked through. The rows are
    read twice, so they should be cheap to read.
    """
    asked = rows.filter(F.size("missing_skills") > 0).select("resume_id").distinct()
    named = resumes.select("resume_id", "resume_text").join(for_skewed_join(asked, "resume_id"), "resume_id", "left_semi")
    covered = for_skewed_join(covered_skills(aliases, named), "resume_id")
    found = F.array_intersect("missing_skills", F.coalesce("covered", F.array().cast("array<string>")))
    return rows.join(covered, "resume_id", "left").withColumn("overlooked", found).drop("covered")


def gap_report(
    rejects: DataFrame, aliases: DataFrame, resumes: DataFrame, suggestions: Column | None = None
) -> DataFrame:
    """The bounded reflection loop, unrolled.

    Pass 1 lists every missing skill and the audit marks those the resume has
    under another name. Only if it marks any is there a pass 2, without them.
    `rejects` needs application_id, resume_id and missing_skills; it is
    evaluated once, written, and read to find the resumes to look through and
    to meet the aliases found in them.
    """
    rejects = written(rejects.select("application_id", "resume_id", "missing_skills"), "rejects")
    audited = audit_gaps(rejects, aliases, resumes)
    wrong = F.size("overlooked") > 0
    return (
        audited.withColumn("missing", F.array_except("missing_skills", "overlooked"))
        .withColumnRenamed("missing_skills", "first_missing")
        .withColumn("reflection_count", F.when(wrong, fixed.MAX_REFLECTIONS).otherwise(1))
        .withColumn("first_critique", critique_flag(~wrong))
        .withColumn("rejection_feedback", feedback_text(F.col("missing"), suggestions))
    )


def critique_flag(is_valid_gap: Column) -> Column:
    """The flag of a confirmed gap reads as if there were none; kept so."""
    return F.when(is_valid_gap, fixed.FLAG_VALID_GAP).otherwise(fixed.FLAG_WRONG_GAP)


def critique_text(is_valid_gap: Column, notes: Column | None = None) -> Column:
    said = F.lit(fixed.DEFAULT_CRITIQUE_NOTES)
    if notes is not None:
        said = F.coalesce(notes, said)
    return F.concat(critique_flag(is_valid_gap), F.lit(": "), said)


def feedback_text(missing: Column, suggestions: Column | None = None) -> Column:
    advice = F.lit(fixed.DEFAULT_SUGGESTIONS)
    if suggestions is not None:
        advice = F.coalesce(suggestions, advice)
    listed = F.when(F.size(missing) > 0, F.array_join(missing, ", ")).otherwise(
        fixed.NO_MISSING_SKILLS
    )
    return F.concat(F.lit("**Missing Skills:** "), listed, F.lit("\n\n**Suggestions:** "), advice)
