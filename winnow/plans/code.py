"""Queries of the code-search family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from winnow import fixed_values as fixed
from winnow.operators import code_search as code
from winnow.plans import tables as src
from winnow.plans.registry import query
from winnow.sources import corpus

FILES = r"""raw_files AS (
  SELECT d.source AS project, CASE WHEN d.doc_id = m.first_id THEN 'README.md' ELSE
      CASE WHEN d.doc_id % 7 = 0 THEN 'build/lib' ELSE 'src' END || '/f' || d.doc_id || '.' ||
      ['py', 'ts', 'js', 'swift', 'ipynb'][d.doc_id % 5 + 1] END AS path, d.text AS content
  FROM documents d JOIN (SELECT source, min(doc_id) AS first_id FROM documents GROUP BY 1) m USING (source)),
files AS (SELECT * FROM raw_files WHERE path NOT LIKE '%build%'),
cut AS (SELECT project, path, string_split(regexp_replace(content, '\n$', ''), chr(10)) AS ls FROM files),
lines AS (SELECT project, path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM cut),
asked AS (
  SELECT item_id AS jd_id, unnest(regexp_extract_all(text, '\p{L}{3,}')) AS skill,
         unnest(range(len(regexp_extract_all(text, '\p{L}{3,}')))) AS pos FROM benchmark),
skills AS (SELECT DISTINCT skill, lower(skill) AS term FROM asked),
hits AS (
  SELECT skill, project, path, CASE WHEN path = 'README.md' THEN 'readme' ELSE 'code' END AS kind,
    CASE WHEN path = 'README.md' THEN 0 ELSE
      list_position(['py', 'ts', 'js', 'swift', 'ipynb'], string_split(path, '.')[-1]) END AS ext_rank,
    CASE WHEN path <> 'README.md' THEN min(line_no) END AS line_no
  FROM lines JOIN skills ON contains(lower(line), term) GROUP BY 1, 2, 3),
top AS (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY project, ext_rank, path) AS rank FROM hits
  QUALIFY rank <= 3),
shown AS (
  SELECT t.*, CASE WHEN kind = 'readme' THEN left(f.content, 400) ELSE
    array_to_string(c.ls[greatest(line_no - 8, 1) : line_no + 7], chr(10)) END AS snippet
  FROM top t JOIN files f USING (project, path) JOIN cut c USING (project, path))"""


def files(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.filter_vendor_paths(src.code_files(spark, folder))


def asked(spark: SparkSession, folder: str) -> DataFrame:
    return code.proof_skills(src.jds(spark, folder))


@query(
    "vendor_path_filter",
    f"WITH {FILES} SELECT project, path, length(content) AS n_chars FROM files",
)
def vendor_path_filter(spark: SparkSession, folder: str) -> DataFrame:
    kept = files(spark, folder)
    return kept.select("project", "path", F.length("content").cast("bigint").alias("n_chars"))


@query(
    "limit_projects",
    f"""WITH {FILES} SELECT project, count(*) AS n_files FROM files
    WHERE project IN (SELECT DISTINCT project FROM files ORDER BY project LIMIT 15) GROUP BY 1""",
)
def limit_projects(spark: SparkSession, folder: str) -> DataFrame:
    kept = corpus.limit_projects(files(spark, folder))
    return kept.groupBy("project").agg(F.count("*").alias("n_files"))


@query(
    "first_four_skills",
    f"WITH {FILES} SELECT jd_id, CAST(pos AS INTEGER) AS pos, skill FROM asked WHERE pos < 4",
)
def first_four_skills(spark: SparkSession, folder: str) -> DataFrame:
    return code.proof_skills(src.jds(spark, folder), fixed.MAX_PROOF_SKILLS)


@query(
    "term_search",
    f"""WITH {FILES} SELECT skill, project, path, kind, CAST(ext_rank AS INTEGER) AS ext_rank,
      CAST(line_no AS INTEGER) AS line_no FROM hits""",
)
def term_search(spark: SparkSession, folder: str) -> DataFrame:
    return code.search_code(files(spark, folder), asked(spark, folder))


@query(
    "whole_word_search",
    rf"""WITH {FILES}, words AS (
      SELECT project, path, line_no, unnest(regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}_]+')) AS term FROM lines)
    SELECT skill, project, path, CAST(min(line_no) AS INTEGER) AS line_no FROM words JOIN skills USING (term)
    GROUP BY 1, 2, 3""",
)
def whole_word_search(spark: SparkSession, folder: str) -> DataFrame:
    return code.first_hit_per_file(files(spark, folder), asked(spark, folder), whole_word=True)


@query(
    "top_hits",
    f"""WITH {FILES} SELECT skill, project, path, kind, CAST(line_no AS INTEGER) AS line_no,
      CAST(rank AS INTEGER) AS rank FROM top""",
)
def top_hits(spark: SparkSession, folder: str) -> DataFrame:
    best = code.best_hits(files(spark, folder), asked(spark, folder))
    return best.select("skill", "project", "path", "kind", "line_no", "rank")


@query(
    "first_hit_snippet",
    f"WITH {FILES} SELECT skill, project, path, CAST(line_no AS INTEGER) AS line_no, snippet FROM shown",
)
def first_hit_snippet(spark: SparkSession, folder: str) -> DataFrame:
    best = code.best_hits(files(spark, folder), asked(spark, folder))
    return best.select("skill", "project", "path", "line_no", "snippet")


@query(
    "readme_hits",
    f"""WITH {FILES} SELECT h.skill, h.project, left(f.content, 400) AS overview
    FROM hits h JOIN files f USING (project, path) WHERE kind = 'readme'""",
)
def readme_hits(spark: SparkSession, folder: str) -> DataFrame:
    return code.readme_hits(files(spark, folder), asked(spark, folder))


@query(
    "search_union",
    f"WITH {FILES} SELECT kind, count(*) AS n_hits, count(DISTINCT skill) AS n_skills FROM hits GROUP BY 1",
)
def search_union(spark: SparkSession, folder: str) -> DataFrame:
    hits = code.search_code(files(spark, folder), asked(spark, folder))
    return hits.groupBy("kind").agg(
        F.count("*").alias("n_hits"), F.count_distinct("skill").alias("n_skills")
    )


@query(
    "search_status",
    r"""WITH asked AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ .,\n]+')) AS skill FROM benchmark),
    hit AS (SELECT DISTINCT skill FROM asked JOIN documents ON contains(lower(text), lower(skill))
      WHERE length(skill) > 2 AND NOT (doc_id % 7 = 0 AND doc_id NOT IN (SELECT min(doc_id) FROM documents GROUP BY source)))
    SELECT a.skill, CASE WHEN length(a.skill) <= 2 THEN 'no_terms' WHEN h.skill IS NULL THEN 'no_matches'
      ELSE 'found' END AS status FROM asked a LEFT JOIN hit h USING (skill)""",
)
def search_status(spark: SparkSession, folder: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("[^ .,\\n]+"), F.lit(0))
    skills = src.load(spark, folder, "benchmark").select(F.explode(words).alias("skill"))
    corpus_files = files(spark, folder)
    return code.search_status(corpus_files, skills, code.skills_found(corpus_files, skills))


@query(
    "code_proofs",
    f"""WITH {FILES} SELECT a.jd_id, CAST(a.pos AS INTEGER) AS pos, a.skill AS requirement, s.project AS project_name,
      s.path AS file_path, CAST(s.line_no AS INTEGER) AS line_no, s.snippet AS code_snippet
    FROM asked a JOIN shown s USING (skill)""",
)
def code_proofs(spark: SparkSession, folder: str) -> DataFrame:
    proofs = code.code_proofs(src.jds(spark, folder), files(spark, folder))
    return proofs.select(
        "jd_id", "pos", "requirement", "project_name", "file_path", "line_no", "code_snippet"
    )


@query(
    "proof_counts",
    f"""WITH {FILES} SELECT b.item_id AS jd_id, count(t.skill) AS n_proofs
    FROM benchmark b LEFT JOIN asked a ON a.jd_id = b.item_id LEFT JOIN top t ON t.skill = a.skill GROUP BY 1""",
)
def proof_counts(spark: SparkSession, folder: str) -> DataFrame:
    return code.proof_counts(src.jds(spark, folder), files(spark, folder))
