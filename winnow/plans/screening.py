"""Queries of the screening family: matching, routing, gaps, tagging."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from winnow.functions import text as t
from winnow.operators import gaps, screening, skills
from winnow.plans import tables as src
from winnow.plans.registry import query
from winnow.session import use_checkpoint_dir

# --- shared SQL --------------------------------------------------------------
RESUMES = r"""resumes AS (
  SELECT d.doc_id AS resume_id, d.text AS resume_text, CAST(l.quality * 10 AS DOUBLE) AS years,
         regexp_extract_all(d.text, '\p{L}{3,}') AS raw,
         list_distinct(regexp_extract_all(lower(d.text), '\p{L}{3,}')) AS cand
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
JDS = r"""jds AS (
  SELECT item_id AS jd_id, regexp_extract_all(text, '\p{L}{3,}') AS raw_req,
         list_distinct(regexp_extract_all(lower(text), '\p{L}{3,}')) AS req FROM benchmark)"""
APPS = """apps AS (
  SELECT doc_id AS application_id, doc_id AS resume_id,
         doc_id % (SELECT count(*) FROM benchmark) AS jd_id FROM documents)"""
SCORED = """scored AS (
  SELECT a.*, r.years, r.raw, r.cand, j.raw_req, j.req,
         len(list_intersect(j.req, r.cand)) AS m, len(j.req) AS n,
         CASE WHEN len(j.req) = 0 THEN CAST(0 AS DOUBLE)
              ELSE CAST(len(list_intersect(j.req, r.cand)) AS DOUBLE) / len(j.req) END AS score
  FROM apps a LEFT JOIN resumes r USING (resume_id) LEFT JOIN jds j USING (jd_id))"""
ROUTED = """routed AS (
  SELECT *, CASE WHEN score >= 0.5 AND coalesce(years, 0) >= 8 THEN 'ShortList' ELSE 'Reject' END AS route
  FROM scored)"""
BASE = f"WITH {RESUMES}, {JDS}, {APPS}, {SCORED}, {ROUTED}"
# RE2 cannot look around, so a dot that a word begins with is told from others by marking it first.
TOKENS = (
    r"[replace(w, chr(2), '.') FOR w IN regexp_extract_all(regexp_replace(lower(text), "
    r"'(^|[^\p{L}\p{N}_+#.])\.(\p{L})', '\1' || chr(2) || '\2', 'g'), '\x02?[\p{L}\p{N}_+#]+(?:\.[\p{L}\p{N}_+#]+)*')]"
)


def matched(spark: SparkSession, folder: str) -> DataFrame:
    return skills.match_skills(
        src.applications(spark, folder), src.resumes(spark, folder), src.jds(spark, folder)
    )


def routed(spark: SparkSession, folder: str) -> DataFrame:
    return screening.route(matched(spark, folder))


def joined(items: Column) -> Column:
    return F.array_join(F.array_sort(items), "|")


SCREEN_SQL = f"""{BASE} SELECT application_id, resume_id, jd_id, CAST(n AS INTEGER) AS n_required,
  CAST(m AS INTEGER) AS n_matched, round(score, 6) AS skill_match, route FROM routed"""


@query("screen_applications", SCREEN_SQL)
def screen_applications(spark: SparkSession, folder: str) -> DataFrame:
    return routed(spark, folder).select(*screen_columns())


def screen_columns() -> list[Column]:
    return [
        F.col("application_id"),
        F.col("resume_id"),
        F.col("jd_id"),
        F.col("n_required"),
        F.col("n_matched"),
        F.round("skill_match", 6).alias("skill_match"),
        F.col("route"),
    ]


@query(
    "screen_all_pairs",
    f"""WITH {RESUMES}, {JDS}, p AS (
      SELECT resume_id, jd_id, len(list_intersect(req, cand)) AS m, len(req) AS n
      FROM resumes, jds WHERE len(req) > 0)
    SELECT resume_id, jd_id, CAST(m AS INTEGER) AS n_matched, CAST(n AS INTEGER) AS n_required,
      round(CAST(m AS DOUBLE) / n, 6) AS skill_match FROM p WHERE CAST(m AS DOUBLE) / n >= 0.3""",
)
def screen_all_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = skills.screen_all(src.resumes(spark, folder), src.jds(spark, folder), 0.3)
    return pairs.withColumn("skill_match", F.round("skill_match", 6))


@query(
    "exact_matched",
    f"""{BASE} SELECT application_id,
      array_to_string([x FOR x IN raw_req IF list_contains(cand, lower(x))], '|') AS matched FROM scored""",
)
def exact_matched(spark: SparkSession, folder: str) -> DataFrame:
    return matched(spark, folder).select(
        "application_id", F.array_join("matched_skills", "|").alias("matched")
    )


@query(
    "skill_overlap",
    f"""{BASE} SELECT application_id, array_to_string(list_sort(list_intersect(req, cand)), '|') AS overlap
    FROM scored""",
)
def skill_overlap(spark: SparkSession, folder: str) -> DataFrame:
    both = matched(spark, folder)
    overlap = skills.skill_overlap(F.col("required_skills"), F.col("candidate_skills"))
    return both.select("application_id", joined(overlap).alias("overlap"))


@query(
    "missing_array",
    f"""{BASE} SELECT application_id,
      array_to_string(list_sort([x FOR x IN req IF NOT list_contains(cand, x)]), '|') AS missing FROM scored""",
)
def missing_array(spark: SparkSession, folder: str) -> DataFrame:
    return matched(spark, folder).select(
        "application_id", joined(F.col("missing_skills")).alias("missing")
    )


@query(
    "missing_skills",
    f"""{BASE}, need AS (SELECT application_id, resume_id, unnest(req) AS skill FROM routed WHERE route = 'Reject'),
    have AS (SELECT resume_id, unnest(cand) AS skill FROM resumes)
    SELECT n.application_id, n.skill FROM need n ANTI JOIN have h ON n.resume_id = h.resume_id AND n.skill = h.skill""",
)
def missing_skills(spark: SparkSession, folder: str) -> DataFrame:
    _, rejected = screening.split_routes(routed(spark, folder))
    return gaps.missing_rows(rejected, ["application_id"])


# Every longer word of the job descriptions may also be said without its ending.
ALIASES = r"""aliases AS (
  SELECT DISTINCT skill, left(skill, len(skill) - 2) AS alias
  FROM (SELECT unnest(req) AS skill FROM jds) WHERE len(skill) >= 5)"""
GAPS = f"""{BASE}, {ALIASES},
used AS (SELECT doc_id AS resume_id, unnest(list_distinct({TOKENS})) AS alias FROM documents),
miss AS (
  SELECT application_id, resume_id, [x FOR x IN req IF NOT list_contains(cand, x)] AS first_missing
  FROM routed WHERE route = 'Reject'),
over AS (
  SELECT m.application_id, list_distinct(list(a.skill)) AS overlooked
  FROM (SELECT application_id, resume_id, unnest(first_missing) AS skill FROM miss) m
  JOIN aliases a USING (skill) JOIN used u ON u.resume_id = m.resume_id AND u.alias = a.alias
  GROUP BY 1),
audited AS (
  SELECT m.application_id, m.first_missing, coalesce(o.overlooked, []) AS overlooked,
    list_sort([x FOR x IN m.first_missing IF NOT list_contains(coalesce(o.overlooked, []), x)]) AS missing
  FROM miss m LEFT JOIN over o USING (application_id))"""


def aliases(spark: SparkSession, folder: str) -> DataFrame:
    words = src.jds(spark, folder).select(F.explode(t.norm_skills(F.col("required_skills"))).alias("skill"))
    words = words.distinct().filter(F.length("skill") >= 5)
    return words.select("skill", F.left("skill", F.length("skill") - 2).alias("alias"))


def reports(spark: SparkSession, folder: str) -> DataFrame:
    _, rejected = screening.split_routes(routed(spark, folder))
    return gaps.gap_report(rejected, aliases(spark, folder), src.resumes(spark, folder))


@query(
    "gap_report",
    f"""{GAPS} SELECT application_id, CAST(len(first_missing) AS INTEGER) AS n_first,
      array_to_string(list_sort(overlooked), '|') AS overlooked, array_to_string(missing, '|') AS missing,
      CASE WHEN len(overlooked) > 0 THEN 2 ELSE 1 END AS reflection_count,
      CASE WHEN len(overlooked) > 0 THEN 'MISIDENTIFIED_GAP' ELSE 'NO_GAPS_FOUND' END AS first_critique
    FROM audited""",
)
def gap_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports(spark, folder).select(
        "application_id",
        F.size("first_missing").alias("n_first"),
        joined(F.col("overlooked")).alias("overlooked"),
        joined(F.col("missing")).alias("missing"),
        "reflection_count",
        "first_critique",
    )


@query(
    "feedback_text",
    f"""{GAPS} SELECT application_id, '**Missing Skills:** ' ||
      CASE WHEN len(missing) > 0 THEN array_to_string(missing, ', ')
           ELSE 'No specific technical skills flagged.' END || chr(10) || chr(10) ||
      '**Suggestions:** Focus on building hands-on projects related to core JD requirements.' AS feedback,
      CASE WHEN len(overlooked) > 0 THEN 'MISIDENTIFIED_GAP' ELSE 'NO_GAPS_FOUND' END ||
      ': Verified skill gaps against candidate resume.' AS critique
    FROM audited""",
)
def feedback_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = reports(spark, folder)
    return rows.select(
        "application_id",
        gaps.feedback_text(F.array_sort("missing")).alias("feedback"),
        gaps.critique_text(F.size("overlooked") == 0).alias("critique"),
    )


@query(
    "skill_badges",
    f"""{BASE}, m AS (
      SELECT application_id, list_distinct([lower(x) FOR x IN raw_req IF list_contains(cand, lower(x))]) AS ok,
             raw_req, raw FROM scored),
    b AS (
      SELECT application_id, 'required' AS side, ok, unnest(raw_req) AS skill FROM m
      UNION ALL SELECT application_id, 'candidate', ok, unnest(raw) FROM m)
    SELECT application_id, side, list_contains(ok, lower(skill)) AS matched, count(*) AS n
    FROM b GROUP BY ALL""",
)
def skill_badges(spark: SparkSession, folder: str) -> DataFrame:
    badges = screening.skill_badges(matched(spark, folder), ["application_id"])
    return badges.groupBy("application_id", "side", "matched").agg(F.count("*").alias("n"))


@query(
    "route_funnel",
    f"""{BASE} SELECT 'Position ' || jd_id AS job_title, route,
      CAST(grouping('Position ' || jd_id, route) AS INTEGER) AS level, count(*) AS n, round(avg(score), 6) AS mean_score
    FROM routed GROUP BY ROLLUP ('Position ' || jd_id, route)""",
)
def route_funnel(spark: SparkSession, folder: str) -> DataFrame:
    totals = screening.funnel(routed(spark, folder), "job_title")
    return totals.withColumn("mean_score", F.round("mean_score", 6))


@query(
    "outcome_messages",
    f"""{BASE} SELECT application_id, CASE route WHEN 'ShortList' THEN 'Shortlisted' ELSE 'Rejected' END ||
      ' for Position ' || jd_id || ' at Company ' || jd_id || ' - Candidate ' || resume_id AS message
    FROM routed""",
)
def outcome_messages(spark: SparkSession, folder: str) -> DataFrame:
    rows = routed(spark, folder)
    return rows.select("application_id", screening.outcome_message().alias("message"))


@query(
    "split_route_counts",
    f"""{BASE} SELECT route, count(*) AS n, CAST(sum(m) AS BIGINT) AS n_matched FROM routed GROUP BY route""",
)
def split_route_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Both routes stored; the counts are those seen while writing."""
    path = f"{use_checkpoint_dir(spark).rstrip('/')}/routes-{uuid.uuid4().hex}"
    seen = screening.store_routes(routed(spark, folder), path, n_matched=F.col("n_matched"))
    rows = [(route, counts["n"], counts["n_matched"]) for route, counts in seen.items() if counts["n"]]
    return spark.createDataFrame(rows, "route string, n bigint, n_matched bigint")


@query("score_numeric", f"{BASE} SELECT application_id, round(score * 100, 4) AS score_pct FROM scored")
def score_numeric(spark: SparkSession, folder: str) -> DataFrame:
    percent = screening.score_percent(F.col("skill_match"))
    return matched(spark, folder).select("application_id", F.round(percent, 4).alias("score_pct"))


@query(
    "input_gate",
    """SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 'no resume'
        WHEN d.lang <> 'en' AND coalesce(trim(p.url), '') = '' THEN 'no job address'
        WHEN d.lang = 'en' AND coalesce(trim(b.text), '') = '' THEN 'no job description' END AS reason
    FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id""",
)
def input_gate(spark: SparkSession, folder: str) -> DataFrame:
    urls = src.load(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("jd_url"))
    texts = src.load(spark, folder, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.col("text").alias("jd_text")
    )
    rows = src.load(spark, folder, "documents").select(
        "doc_id",
        F.col("text").alias("resume_text"),
        F.when(F.col("lang") == "en", "text").otherwise("url").alias("input_mode"),
    )
    rows = rows.join(urls, "doc_id", "left").join(texts, "doc_id", "left")
    return screening.validate_applications(rows).select("doc_id", "reason")


@query(
    "skill_tagging",
    f"""WITH lex AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}{{3,}}')) AS skill FROM benchmark),
    tok AS (SELECT doc_id, unnest(list_distinct({TOKENS})) AS skill FROM documents)
    SELECT doc_id, skill FROM tok JOIN lex USING (skill)""",
)
def skill_tagging(spark: SparkSession, folder: str) -> DataFrame:
    words = t.words(F.col("text"), 3)
    lexicon = src.load(spark, folder, "benchmark").select(F.explode(words).alias("skill")).distinct()
    return skills.tag_skills(src.load(spark, folder, "documents"), "doc_id", "text", lexicon)


@query(
    "role_tagging",
    rf"""WITH roles AS (SELECT DISTINCT unnest([a || ' ' || w[i + 1] FOR a, i IN w IF i < len(w)]) AS role
      FROM (SELECT regexp_extract_all(text, '\p{{L}}+') AS w FROM benchmark)),
    tok AS (SELECT doc_id, {TOKENS} AS w FROM documents),
    grams AS (SELECT doc_id, unnest([a || ' ' || w[i + 1] FOR a, i IN w IF i < len(w)]) AS gram FROM tok)
    SELECT DISTINCT doc_id, role FROM grams g JOIN roles r ON g.gram = lower(r.role) WHERE role <> ''""",
)
def role_tagging(spark: SparkSession, folder: str) -> DataFrame:
    words = src.load(spark, folder, "benchmark").select(F.regexp_extract_all("text", F.lit("\\p{L}+"), F.lit(0)).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))
    roles = words.filter(F.size("w") > 1).select(F.explode(pairs).alias("role")).distinct()
    return skills.tag_roles(src.load(spark, folder, "documents"), "doc_id", "text", roles)


@query(
    "role_merge",
    """WITH c AS (
      SELECT s.s_suppkey, [p.p_type, p.p_name, p.p_type] AS new,
        CASE WHEN s.s_acctbal < 1000 THEN [] ELSE [p.p_name, p.p_brand] END AS old
      FROM supplier s JOIN part p ON p.p_partkey = s.s_suppkey),
    a AS (SELECT s_suppkey, list_concat(new, CASE WHEN len(old) > 0 THEN old ELSE
        ['Lead AI Engineer', 'Software Engineer', 'General Professional Experience'] END) AS roles FROM c),
    u AS (SELECT s_suppkey, unnest(roles) AS role, unnest(range(len(roles))) AS i FROM a),
    f AS (SELECT s_suppkey, role, min(i) AS i FROM u GROUP BY 1, 2)
    SELECT s_suppkey, string_agg(role, '|' ORDER BY i) AS roles FROM f GROUP BY 1""",
)
def role_merge(spark: SparkSession, folder: str) -> DataFrame:
    parts = src.load(spark, folder, "part").withColumnRenamed("p_partkey", "s_suppkey")
    rows = src.load(spark, folder, "supplier").join(parts, "s_suppkey")
    new = F.array("p_type", "p_name", "p_type")
    old = F.when(F.col("s_acctbal") >= 1000, F.array("p_name", "p_brand"))
    return rows.select("s_suppkey", F.array_join(skills.merge_roles(new, old), "|").alias("roles"))


@query(
    "skills_cascade",
    """SELECT c.c_custkey, array_to_string(CASE
        WHEN o.o_orderstatus = 'F' THEN [o.o_orderstatus, o.o_orderpriority]
        WHEN p.p_type <> 'ECONOMY' THEN string_split(p.p_name, ' ')
        ELSE [c.c_mktsegment, 'x'] END, '|') AS skills
    FROM customer c LEFT JOIN orders o ON o.o_orderkey = c.c_custkey
    LEFT JOIN part p ON p.p_partkey = c.c_custkey""",
)
def skills_cascade(spark: SparkSession, folder: str) -> DataFrame:
    matched_list = F.when(
        F.col("o_orderstatus") == "F", F.array("o_orderstatus", "o_orderpriority", F.lit(""))
    )
    orders = src.load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("c_custkey"), matched_list.alias("matched_skills")
    )
    resume_list = F.when(F.col("p_type") != "ECONOMY", F.split("p_name", " "))
    parts = src.load(spark, folder, "part").select(
        F.col("p_partkey").alias("c_custkey"), resume_list.alias("candidate_skills")
    )
    rows = src.load(spark, folder, "customer").join(orders, "c_custkey", "left").join(parts, "c_custkey", "left")
    rows = rows.withColumn("skills", F.concat("c_mktsegment", F.lit(" , , x,")))
    resolved = skills.resolve_skills(rows)
    return rows.select("c_custkey", F.array_join(resolved, "|").alias("skills"))
