"""A key with a third of the rows and more is split, not handed to one task."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from winnow.operators import code_search as code, gaps, repos as rp, skills

SMALL_DATA_ACTS_LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def skewed_joins(frame):
    """Run the frame and give the skewed joins of its final plan, and its rows."""
    rows = frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "skew=true" in line], rows


def test_a_word_of_every_file(spark):
    number = F.col("id").cast("string")
    files = spark.range(60_000).select(
        F.lit("p").alias("project"),
        F.concat(F.lit("f"), number, F.lit(".py")).alias("path"),
        F.concat(F.lit("hotword x"), number).alias("content"),
    )
    asked = spark.createDataFrame([("hotword",), ("x5999",)], "skill string")
    with settings(spark, SMALL_DATA_ACTS_LARGE):
        joins, rows = skewed_joins(code.first_hit_per_file(files, asked))
    assert joins and len(rows) == 60_000 + 11


def test_a_skill_of_every_resume(spark):
    number = F.col("id").cast("string")
    resumes = spark.range(40_000).select(
        F.col("id").alias("resume_id"), F.array(F.lit("python"), F.concat(F.lit("s"), number)).alias("candidate_skills")
    )
    jds = spark.range(300).select(
        F.col("id").alias("jd_id"), F.array(F.lit("python"), F.concat(F.lit("s"), number)).alias("required_skills")
    )
    with settings(spark, SMALL_DATA_ACTS_LARGE):
        joins, rows = skewed_joins(skills.screen_all(resumes, jds, 1.0))
    # Everyone holds python, but the other skill decides: the hot one finds no candidates.
    assert joins and sorted((r["resume_id"], r["jd_id"]) for r in rows) == [(i, i) for i in range(300)]


def test_a_resume_with_most_applications(spark):
    rejects = spark.range(60_000).select(
        F.col("id").alias("application_id"),
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("resume_id"),
        F.array(F.lit("docker"), F.concat(F.lit("s"), F.col("id").cast("string"))).alias("missing_skills"),
    )
    resumes = spark.range(60_000).select(F.col("id").alias("resume_id"), F.lit("containers").alias("resume_text"))
    aliases = spark.createDataFrame([("docker", "containers")], "skill string, alias string")
    with settings(spark, SMALL_DATA_ACTS_LARGE):
        joins, rows = skewed_joins(gaps.audit_gaps(rejects, aliases, resumes))
    assert joins and len(rows) == 60_000 and all(r["overlooked"] == ["docker"] for r in rows)


def test_a_handle_with_most_repositories(spark):
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 4000).cast("int")), "yyyy-MM-dd")
    repos = spark.range(30_000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("h"), F.col("id").cast("string"))).alias("handle"),
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"),
        day.alias("updated_at"),
        day.alias("pushed_at"),
    )
    with settings(spark, SMALL_DATA_ACTS_LARGE):
        kept = rp.recent_or_all(repos, "2026-01-01")
        largest = kept.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        by_join = rp.top_repos(kept, 3).select("handle", "name", "rank").collect()
        by_rank = rp.top_recent_repos(repos, 3, "2026-01-01").select("handle", "name", "rank").collect()
    assert largest < kept.count() / 2
    assert sorted(by_join) == sorted(by_rank)


def test_a_resume_that_meets_every_job(spark):
    """One resume holds the rare skills of all jobs; others hold one each."""
    jds = spark.range(4000).select(F.col("id").alias("jd_id"), F.array(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("required_skills"))
    all_skills = F.transform(F.sequence(F.lit(0), F.lit(3999)), lambda i: F.concat(F.lit("s"), i.cast("string")))
    own = F.array(F.concat(F.lit("s"), F.col("id").cast("string")))
    resumes = spark.range(4000).select(F.col("id").alias("resume_id"), F.when(F.col("id") == 0, all_skills).otherwise(own).alias("candidate_skills"))
    with settings(spark, SMALL_DATA_ACTS_LARGE | {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB"}):
        joins, rows = skewed_joins(skills.screen_all(resumes, jds, 1.0))
    assert joins and len(rows) == 4000 + 3999


def test_a_handle_with_a_million_repositories(spark):
    """Texts are tested row by row; only those of handles with an open phrase are put in order, in runs of bounded size."""
    number = F.col("id").cast("string")
    repos = spark.range(1_000_000).select(
        F.when(F.col("id") % 50 < 49, "hot").otherwise(F.concat(F.lit("h"), number)).alias("handle"),
        F.concat(F.lit("r"), F.lpad(number, 7, "0")).alias("name"),
        F.when(F.col("id") == 7, "needle").when(F.col("id") == 500_000, "ends with big").otherwise("plain").alias("description"),
        F.lit(None).cast("string").alias("language"),
        F.lit(None).cast("array<string>").alias("topics"),
        F.lit("2024").alias("updated_at"),
    )
    wanted = spark.createDataFrame([("hot", s) for s in ("needle", "big r0500001", "big r0500002", "plain r0000003", "nowhere")], "handle string, skill string")
    with settings(spark, {"spark.sql.shuffle.partitions": "16"}):
        found = rp.skills_in_repos(repos, wanted)
        got = sorted(r["skill"] for r in found.collect())
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert got == ["big r0500001", "needle", "plain r0000003"] and "windowspecdefinition(handle" not in plan
