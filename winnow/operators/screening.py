"""Input gate, routing and the reports made from routed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from winnow import fixed_values as fixed
from winnow.functions import text as t


def validate_applications(rows: DataFrame) -> DataFrame:
    """Add `reason`: null for a usable row, else what is missing.

    Columns read: resume_text, input_mode ('url' or 'text'), jd_url, jd_text.
    """
    reason = (
        F.when(F.coalesce("resume_text", F.lit("")) == "", "no resume")
        .when((F.col("input_mode") == "url") & t.blank(F.col("jd_url")), "no job address")
        .when((F.col("input_mode") == "text") & t.blank(F.col("jd_text")), "no job description")
    )
    return rows.withColumn("reason", reason)


def assemble_jd_text(title: Column, overview: Column, pasted: Column) -> Column:
    """Title and overview of an extracted page, or the pasted text when there is no overview."""
    built = F.concat(
        F.lit("Job Title: "), F.coalesce(title, F.lit("None")), F.lit("\nOverview:\n"), overview
    )
    return F.when(F.coalesce(overview, F.lit("")) != "", built).otherwise(pasted)


def route(rows: DataFrame, min_score: float = fixed.SHORTLIST_MIN_SCORE) -> DataFrame:
    """Add `route` from skill_match, candidate_experience and experience_required."""
    score = F.coalesce("skill_match", F.lit(0.0))
    years = F.coalesce("candidate_experience", F.lit(fixed.DEFAULT_CANDIDATE_YEARS))
    wanted = F.coalesce("experience_required", F.lit(fixed.DEFAULT_REQUIRED_YEARS))
    passed = (score >= min_score) & (years >= wanted)
    return rows.withColumn(
        "route", F.when(passed, fixed.ROUTE_SHORTLIST).otherwise(fixed.ROUTE_REJECT)
    )


def split_routes(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shortlisted, rejected): two filters over one plan. To store both use `store_routes`, which screens once."""
    return (
        routed.filter(F.col("route") == fixed.ROUTE_SHORTLIST),
        routed.filter(F.col("route") == fixed.ROUTE_REJECT),
    )


def store_routes(routed: DataFrame, path: str, **measures: Column) -> dict[str, dict[str, object]]:
    """Write both routes to path/route=… in one pass and give, per route, its rows (`n`) and further measures.

    The counts are observed while the rows are written, so nothing is screened
    or read a second time. A measure is a column, summed per route.
    """
    seen = Observation("routes")
    routes = (fixed.ROUTE_SHORTLIST, fixed.ROUTE_REJECT)
    counts = []
    for route_ in routes:
        own = F.col("route") == route_
        counts.append(F.count_if(own).alias(f"{route_}.n"))
        counts += [F.sum(F.when(own, value)).alias(f"{route_}.{name}") for name, value in measures.items()]
    routed.observe(seen, *counts).write.partitionBy("route").parquet(path)
    return {r: {name: seen.get[f"{r}.{name}"] for name in ("n", *measures)} for r in routes}


def outcome_message() -> Column:
    job, company, name = (
        F.coalesce(F.col(c), F.lit("None")) for c in ("job_title", "company_name", "candidate_name")
    )
    return F.when(
        F.col("route") == fixed.ROUTE_SHORTLIST,
        F.format_string(fixed.MESSAGE_SHORTLIST, job, company, name),
    ).otherwise(F.format_string(fixed.MESSAGE_REJECT, job, company, name))


def score_percent(score: Column) -> Column:
    """The score in percent, as a number."""
    return F.coalesce(score, F.lit(0.0)) * 100


def skill_badges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per required and per candidate skill: (keys, side, pos, skill, matched)."""

    # The flag is set within the row, so no list is copied beside each skill.
    def side(name: str, skills: str) -> Column:
        return F.transform(
            F.coalesce(skills, F.array().cast("array<string>")),
            lambda s, i: F.struct(
                F.lit(name).alias("side"),
                i.alias("pos"),
                s.alias("skill"),
                F.coalesce(F.array_contains("_matched", F.lower(s)), F.lit(False)).alias("matched"),
            ),
        )

    both = F.concat(side("required", "required_skills"), side("candidate", "candidate_skills"))
    lowered = rows.withColumn("_matched", F.transform("matched_skills", F.lower))
    return lowered.select(*keys, F.explode(both).alias("b")).select(*keys, "b.*")


def funnel(routed: DataFrame, job: str) -> DataFrame:
    """Counts and mean score by job and route, with subtotals per job and overall.

    `level` is 0 for a job and route, 1 for a job, 3 for all, so that a job
    without a title isn't taken for a subtotal.
    """
    return routed.rollup(job, "route").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.avg("skill_match").alias("mean_score")
    )
