"""Queries of the repository family: recency, cards, verification, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from winnow.operators import repos as rp
from winnow.plans import tables as src
from winnow.plans.registry import query
from winnow.sources import payloads

CUTOFF = "2001-06-01"

REPOS = """repos AS (
  SELECT 'cust' || o_custkey AS handle, 'order-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS name,
    'https://example.com/' || o_orderkey AS html_url,
    nullif(o_orderpriority || '|' || chr(10) || o_orderstatus, '5-LOW|' || chr(10) || 'P') AS description,
    nullif(o_orderstatus, 'P') AS language, CAST(floor(o_totalprice / 1000) AS INTEGER) AS stars,
    o_orderpriority AS topic, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS updated_at FROM orders),
active AS (
  SELECT *, bool_or(left(updated_at, 10) > '2001-06-01') OVER (PARTITION BY handle) AS any_recent FROM repos),
kept AS (SELECT * FROM active WHERE NOT any_recent OR left(updated_at, 10) > '2001-06-01'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY updated_at DESC, name) AS rank FROM kept)"""
COMMITS = """commits AS (
  SELECT 'cust' || o.o_custkey AS owner, 'order-' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS repo,
    l_linenumber AS pos, md5(concat_ws('/', l_orderkey, l_partkey, l_suppkey, l_linenumber,
      CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS INTEGER),
      CAST(round(l_tax * 100) AS INTEGER), strftime(l_shipdate, '%Y-%m-%d'))) AS sha,
    'Ship part - number ' || l_partkey || ' from the warehouse of the supplier that is number ' || l_suppkey AS message,
    nullif(l_returnflag, 'R') AS author, strftime(l_shipdate, '%Y-%m-%d') AS day
  FROM lineitem JOIN orders o ON o_orderkey = l_orderkey),
recent AS (
  SELECT c.*, row_number() OVER (PARTITION BY owner, repo ORDER BY pos, sha) AS place
  FROM commits c JOIN ranked r ON r.rank = 1 AND r.handle = c.owner AND r.name = c.repo QUALIFY place <= 5)"""


def top(spark: SparkSession, folder: str) -> DataFrame:
    return rp.top_recent_repos(src.order_repos(spark, folder), cutoff=CUTOFF)


def commits(spark: SparkSession, folder: str) -> DataFrame:
    return rp.recent_commits(src.order_repos(spark, folder), src.line_commits(spark, folder), cutoff=CUTOFF)


@query("recent_or_all", f"WITH {REPOS} SELECT handle, name, updated_at FROM kept")
def recent_or_all(spark: SparkSession, folder: str) -> DataFrame:
    kept = rp.recent_or_all(src.order_repos(spark, folder), CUTOFF)
    return kept.select("handle", "name", "updated_at")


@query(
    "top_repos",
    f"WITH {REPOS} SELECT handle, name, updated_at, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10",
)
def top_repos(spark: SparkSession, folder: str) -> DataFrame:
    return top(spark, folder).select("handle", "name", "updated_at", "rank")


@query(
    "repo_cards",
    f"""WITH {REPOS} SELECT handle, name, html_url,
      coalesce(replace(replace(description, '|', '-'), chr(10), ' '), 'No description provided.') AS description,
      coalesce(language, 'N/A') AS language, stars, left(updated_at, 10) AS updated
    FROM ranked WHERE rank <= 10""",
)
def repo_cards(spark: SparkSession, folder: str) -> DataFrame:
    return rp.repo_cards(top(spark, folder), ["handle"])


@query("latest_repo", f"WITH {REPOS} SELECT handle, name AS repo FROM ranked WHERE rank = 1")
def latest_repo(spark: SparkSession, folder: str) -> DataFrame:
    return rp.latest_repo(src.order_repos(spark, folder), CUTOFF)


@query(
    "day_cut",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderdate > '2001-06-01' AS recent FROM orders",
)
def day_cut(spark: SparkSession, folder: str) -> DataFrame:
    orders = src.load(spark, folder, "orders")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return orders.select(
        "o_orderkey",
        F.left(stamp, F.lit(10)).alias("day"),
        (F.left(stamp, F.lit(10)) > CUTOFF).alias("recent"),
    )


@query(
    "recent_commits",
    f"WITH {REPOS}, {COMMITS} SELECT owner, repo, pos, sha, CAST(place AS INTEGER) AS rank FROM recent",
)
def recent_commits(spark: SparkSession, folder: str) -> DataFrame:
    found = commits(spark, folder)
    return found.select("owner", "repo", "pos", "sha", "rank")


@query(
    "commit_cards",
    f"""WITH {REPOS}, {COMMITS} SELECT owner, repo, CAST(place AS INTEGER) AS rank, left(sha, 7) AS sha,
      left(message, 60) AS message, coalesce(author, 'Unknown') AS author, day FROM recent""",
)
def commit_cards(spark: SparkSession, folder: str) -> DataFrame:
    found = commits(spark, folder)
    return rp.commit_cards(found, ["owner", "repo", "rank"])


@query("repo_totals", f"WITH {REPOS} SELECT handle, count(*) AS total FROM repos GROUP BY 1")
def repo_totals(spark: SparkSession, folder: str) -> DataFrame:
    return rp.repo_totals(src.order_repos(spark, folder))


@query(
    "language_mix",
    f"""WITH {REPOS}, c AS (SELECT handle, coalesce(language, 'N/A') AS language, count(*) AS n FROM repos GROUP BY ALL)
    SELECT handle, language, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY handle), 6) AS share FROM c""",
)
def language_mix(spark: SparkSession, folder: str) -> DataFrame:
    return rp.language_mix(src.order_repos(spark, folder)).withColumn("share", F.round("share", 6))


PARTS = """owned AS (
  SELECT s.s_name AS handle, replace(p_name, ' ', '-') || '_' || p_partkey AS name, p_brand, p_type, p_partkey
  FROM part JOIN supplier s ON s.s_suppkey = p_partkey % (SELECT count(*) FROM supplier)),
corpus AS (
  SELECT handle, string_agg(lower(p_type) || ' ' || lower(p_brand) || ' ' || lower(p_type) || ' ' ||
    replace(replace(lower(name), '-', ' '), '_', ' ') || ' ' ||
    lower(p_brand) || ' for the ' || lower(p_type), ' ' ORDER BY p_partkey DESC) AS corpus
  FROM owned GROUP BY 1),
cand AS (
  SELECT s_suppkey AS candidate_id, s_name AS handle,
    list_concat(string_split(p_name, ' '), [p_brand, p_type, replace(p_name, ' ', '-')]) AS skills
  FROM supplier LEFT JOIN part ON p_partkey = s_suppkey),
found AS (
  SELECT candidate_id, s.skill FROM (SELECT candidate_id, handle, unnest(list_distinct(skills)) AS skill FROM cand) s
  JOIN corpus c USING (handle)
  WHERE regexp_matches(corpus, '(^|[^\\p{L}\\p{N}_])' || lower(s.skill) || '($|[^\\p{L}\\p{N}_])'))"""


@query("repo_corpus", f"WITH {PARTS} SELECT handle, 0::BIGINT AS part, corpus FROM corpus")
def repo_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return rp.repo_corpus(src.part_repos(spark, folder))


@query("word_match_verify", f"WITH {PARTS} SELECT candidate_id, skill FROM found")
def word_match_verify(spark: SparkSession, folder: str) -> DataFrame:
    candidates = src.supplier_candidates(spark, folder)
    return rp.verified_rows(candidates, src.part_repos(spark, folder), ["candidate_id"])


@query(
    "verification_summary",
    f"""WITH {PARTS}, v AS (SELECT candidate_id, string_agg(skill, ', ' ORDER BY skill) AS verified FROM found GROUP BY 1)
    SELECT c.candidate_id, coalesce(v.verified, '') AS verified,
      CASE WHEN v.verified IS NULL THEN 'no' ELSE 'yes' END AS verification
    FROM cand c LEFT JOIN v USING (candidate_id)""",
)
def verification_summary(spark: SparkSession, folder: str) -> DataFrame:
    checked = rp.verify_skills(src.supplier_candidates(spark, folder), src.part_repos(spark, folder))
    return checked.select(
        "candidate_id", F.array_join("verified_skills", ", ").alias("verified"), "verification"
    )


@query(
    "verification_status",
    f"""WITH {REPOS}, texts AS (
      SELECT handle, string_agg(lower(coalesce(language, '')) || ' ' || lower(topic) || ' ' || name || ' ' ||
        coalesce(lower(description), ''), ' ') AS corpus FROM repos GROUP BY 1)
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'skipped' WHEN corpus IS NULL OR c_mktsegment = 'FURNITURE'
      THEN 'unable' WHEN regexp_matches(corpus, '(^|\\W)urgent($|\\W)') THEN 'yes' ELSE 'no' END AS verification
    FROM customer LEFT JOIN texts ON handle = 'cust' || c_custkey""",
)
def verification_status(spark: SparkSession, folder: str) -> DataFrame:
    people = src.load(spark, folder, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("cust"), F.col("c_custkey").cast("string"))).alias("handle"),
        F.when(F.col("c_mktsegment") == "FURNITURE", F.array().cast("array<string>"))
        .otherwise(F.array("c_mktsegment", F.lit(" Urgent ")))
        .alias("skills"),
    )
    checked = rp.verify_skills(people, src.order_repos(spark, folder))
    return checked.select("c_custkey", "verification")


# --- payloads --------------------------------------------------------------------
def event_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Each event carries one payload, its shape told by the event type."""
    k = F.get_json_object("props", "$.k")
    item = F.concat(
        F.lit('{"name":"repo'), k, F.lit('","html_url":null,"stargazers_count":'), k,
        F.lit(',"topics":["a","b"],"updated_at":"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('"}'),
    )
    commit = F.concat(
        F.lit('{"sha":"s'), k, F.lit('","commit":{"message":"m'), k,
        F.lit('","author":{"name":"n","date":"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('"}}}'),
    )

    def shaped(one):
        escaped = F.replace(one, F.lit('"'), F.lit('\\"'))
        return (
            F.when(F.col("event_type") == "view", F.concat(F.lit('{"total_count":7,"items":['), one, F.lit("]}")))
            .when(F.col("event_type") == "click", F.concat(F.lit("["), one, F.lit(","), one, F.lit("]")))
            .when(
                F.col("event_type") == "signup",
                F.concat(F.lit('[{"type":"text","text":"{\\"items\\":['), escaped, F.lit(']}"}]')),
            )
            .when(F.col("event_type") == "purchase", '{"total_count":0,"items":[]}')
            .otherwise(F.concat(F.lit("not json {"), one))
        )

    events = src.load(spark, folder, "events")
    return events.select("event_id", shaped(item).alias("repos"), shaped(commit).alias("commits"))


_SHAPES = """e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  strftime(ts, '%Y-%m-%d') AS day FROM events),
r AS (SELECT *, 0 AS pos FROM e WHERE event_type IN ('view', 'click', 'signup')
  UNION ALL SELECT *, 1 FROM e WHERE event_type = 'click')"""


@query(
    "repo_payload_shapes",
    f"""WITH {_SHAPES} SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 7 WHEN 'click' THEN 2 ELSE 1 END AS BIGINT)
      AS total_count, pos, 'repo' || k AS name, k AS stars, 'a|b' AS topics, day AS updated_at FROM r""",
)
def repo_payload_shapes(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_payloads(spark, folder).select("event_id", F.col("repos").alias("payload"))
    parsed = payloads.parse_repo_payload(rows)
    return parsed.select(
        "event_id",
        "total_count",
        "pos",
        "name",
        F.col("stargazers_count").alias("stars"),
        F.array_join("topics", "|").alias("topics"),
        "updated_at",
    )


@query(
    "commit_payload_shapes",
    f"WITH {_SHAPES} SELECT event_id, pos, 's' || k AS sha, 'm' || k AS message, 'n' AS author, day FROM r",
)
def commit_payload_shapes(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_payloads(spark, folder).select("event_id", F.col("commits").alias("payload"))
    return payloads.parse_commit_payload(rows).select(
        "event_id",
        "pos",
        "sha",
        F.col("commit.message").alias("message"),
        F.col("commit.author.name").alias("author"),
        F.col("commit.author.date").alias("day"),
    )


@query(
    "payload_status",
    """SELECT event_id, CASE event_type WHEN 'purchase' THEN 'empty' WHEN 'error' THEN 'error' ELSE 'ok' END AS status
    FROM events""",
)
def payload_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_payloads(spark, folder)
    return rows.select("event_id", payloads.payload_status("repos").alias("status"))
