"""Repositories, commits and payloads."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from winnow import fixed_values as fixed
from winnow.operators import extraction, repos as rp
from winnow.operators.grouping import likely_among
from winnow.sources import payloads

REPO = (
    "handle string, name string, html_url string, description string, language string, topics array<string>, "
    "stargazers_count int, updated_at string, pushed_at string"
)


def repo(handle, name, updated, pushed=None, description=None, language=None, topics=None):
    return (handle, name, None, description, language, topics, None, updated, pushed or updated)


@pytest.fixture(scope="module")
def repos(spark):
    rows = [repo("many", f"r{i:02d}", f"2025-01-{i + 1:02d}T00:00:00Z") for i in range(11)]
    rows += [
        repo("new", "old-one", "2024-01-01T00:00:00Z"),
        repo("new", "new-one", "2026-01-02T00:00:00Z"),
        repo("new", "at-cutoff", "2026-01-01T10:00:00Z"),
        repo("undated", "none", None),
        repo("undated", "dated", "2020-01-01T00:00:00Z"),
        repo("skills", "scikit-learn-demo", "2025-01-01", None, "uses node.js|and\nC#", "Python", ["ML", "Data_Base"]),
    ]
    return spark.createDataFrame(rows, REPO)


def test_recent_or_all(repos):
    got = {(r["handle"], r["name"]) for r in rp.recent_or_all(repos).collect()}
    assert {n for h, n in got if h == "new"} == {"new-one"}
    assert len([1 for h, _ in got if h == "many"]) == 11 and ("undated", "none") in got


def test_top_repos_and_missing_dates_last(repos):
    rows = rp.top_repos(repos).collect()
    many = sorted((r["rank"], r["name"]) for r in rows if r["handle"] == "many")
    assert many[0] == (1, "r10") and len(many) == 10
    assert [r["name"] for r in sorted(rows, key=lambda r: r["rank"]) if r["handle"] == "undated"] == ["dated", "none"]


def test_top_recent_is_top_of_recent_or_all(repos):
    for k in (1, 2, 10):
        got = rp.top_recent_repos(repos, k).select("handle", "name", "rank").collect()
        want = rp.top_repos(rp.recent_or_all(repos), k).select("handle", "name", "rank").collect()
        assert sorted(got) == sorted(want)


def test_rank_limit_comes_before_the_shuffle(repos, spark):
    plan = rp.top_repos(repos)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_cards(repos):
    cards = {r["name"]: r for r in rp.repo_cards(repos, ["handle"]).collect()}
    assert cards["scikit-learn-demo"]["description"] == "uses node.js-and C#"
    empty = cards["none"]
    assert (empty["description"], empty["language"], empty["stars"], empty["updated"], empty["html_url"]) == (
        "No description provided.", "N/A", 0, "", "#",
    )


def test_corpus_and_word_matches(spark, repos):
    corpus = {(r["handle"], r["part"]): r["corpus"] for r in rp.repo_corpus(repos).collect()}
    assert corpus["skills", 0] == "python ml data_base scikit learn demo uses node.js|and\nc#"
    people = spark.createDataFrame(
        [
            (1, "skills", ["C#", " Node.js ", "scikit-learn", "python", "Python", "Data"]),
            (2, None, ["python"]),
            (3, "skills", []),
            (4, "nobody", ["python"]),
            (5, "skills", ["rust"]),
        ],
        "id int, handle string, skills array<string>",
    )
    got = {r["id"]: r for r in rp.verify_skills(people, repos).collect()}
    assert got[1]["verified_skills"] == ["Node.js", "Python", "python"] and got[1]["verification"] == "yes"
    assert [got[i]["verification"] for i in (2, 3, 4, 5)] == ["skipped", "unable", "unable", "no"]


def test_commits(spark, repos):
    kind = "owner string, repo string, pos int, sha string, commit struct<message:string,author:struct<name:string,date:string>>"
    rows = [("new", "new-one", i, f"sha{i}4567890", ("a|b " + "x" * 80 + "\nmore", (None, "2026-01-02T03:04:05Z"))) for i in range(6)]
    rows += [("new", "old-one", 0, "other", ("m", ("n", "d"))), ("many", "r10", 0, None, (None, None))]
    commits = spark.createDataFrame(rows, kind)
    cards = rp.commit_cards(rp.recent_commits(repos, commits), ["owner", "rank"]).collect()
    new = sorted((r for r in cards if r["owner"] == "new"), key=lambda r: r["rank"])
    assert len(new) == 5 and new[0]["sha"] == "sha0456" and new[0]["day"] == "2026-01-02"
    assert new[0]["message"] == ("a-b " + "x" * 80)[:60] and new[0]["author"] == "Unknown"
    (many,) = [r for r in cards if r["owner"] == "many"]
    assert (many["message"], many["sha"], many["day"]) == ("No commit message", "", "")


def test_commits_of_other_repositories_are_left_out_where_they_are_read(spark):
    number = F.col("id").cast("string")
    repos = spark.range(5000).select(
        F.concat(F.lit("h"), F.floor(F.col("id") / 10).cast("string")).alias("handle"),
        F.when(F.col("id") == 4999, None).otherwise(F.concat(F.lit("r"), number)).alias("name"),
        F.concat(F.lit("2026-01-1"), (F.col("id") % 10).cast("string")).alias("updated_at"),
        F.lit("2026-01-01").alias("pushed_at"),
    )
    owners = spark.range(5000).select("id", F.concat(F.lit("h"), F.floor(F.col("id") / 10).cast("string")).alias("owner"))
    lines = spark.range(40_000).select((F.col("id") % 5000).alias("id"), F.col("id").alias("pos"))
    commits = lines.join(owners.hint("merge"), "id").select(
        "owner", F.concat(F.lit("r"), number).alias("repo"), "pos", F.lit("s").alias("sha"), F.lit("m").alias("commit")
    )
    found = rp.recent_commits(repos, commits, 5)
    got = sorted((r["owner"], r["repo"], r["pos"], r["rank"]) for r in found.collect())
    want = [(f"h{i // 10}", f"r{i}", i + 5000 * n, n + 1) for i in range(9, 4999, 10) for n in range(5)]
    assert got == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("Join Inner") < plan.index("scalar-subquery")


def test_likely_among(spark):
    held = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")).unionByName(
        spark.createDataFrame([(None,)], "key string")
    )
    rows = spark.range(100_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    passed = rows.filter(likely_among(held, "key"))
    assert passed.join(held, "key", "left_semi").count() == 3000 and passed.count() < 3100
    nulls = spark.createDataFrame([(None,)], "key string")
    assert nulls.filter(likely_among(held, "key")).count() == 0
    assert rows.filter(likely_among(held.limit(0), "key")).count() == 0


def test_totals_and_languages(repos):
    assert {r["handle"]: r["total"] for r in rp.repo_totals(repos).collect()}["many"] == 11
    mix = [r for r in rp.language_mix(repos).collect() if r["handle"] == "skills"]
    assert [(r["language"], r["n"], r["share"]) for r in mix] == [("Python", 1, 1.0)]


def test_payload_shapes(spark):
    item = {"name": "a", "description": None, "topics": ["x"], "stargazers_count": 3, "updated_at": "2025"}
    texts = [
        json.dumps({"items": [item, item], "total_count": 9}), json.dumps({"items": [item]}), json.dumps([item]),
        json.dumps([{"type": "text", "text": json.dumps({"items": [item]})}]), "not json", json.dumps({"items": []}),
        "[]", "7", None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, payload string")
    got = [(r["id"], r["pos"], r["total_count"], r["name"], r["topics"]) for r in payloads.parse_repo_payload(rows).collect()]
    assert sorted(got) == [
        (0, 0, 9, "a", ["x"]), (0, 1, 9, "a", ["x"]), (1, 0, 1, "a", ["x"]), (2, 0, 1, "a", ["x"]), (3, 0, 1, "a", ["x"]),
    ]
    status = rows.select("id", payloads.payload_status().alias("s")).orderBy("id").collect()
    assert [r["s"] for r in status] == ["ok"] * 4 + ["error", "empty", "empty", "error", "error"]


def test_tiers(spark):
    long = "<p>" + "w" * 200 + "</p>"
    rows = spark.createDataFrame(
        [(1, "http://a/jobs/view/7", "<h2>J</h2>" + long), (2, "http://a/jobs/view/8", "short"), (3, "http://a", "<h1>B</h1>" + long),
         (4, "http://a", "<p> </p>")],
        "page_id bigint, url string, html string",
    )
    got = {r["page_id"]: (r["tier"], r["title"]) for r in extraction.extract_pages(rows).collect()}
    assert got == {1: (1, "J"), 2: (2, "Job Position"), 3: (2, "B"), 4: (None, None)}
    kept = extraction.latest_per_posting(rows).collect()
    assert sorted(r["page_id"] for r in kept) == [1, 2, 4]


def test_all_repositories_count_unless_fewer_are_asked_for(spark):
    kind = "handle string, name string, description string, language string, topics array<string>, updated_at string"
    repos = spark.createDataFrame([("h", f"r{i:03d}", f"word{i:03d} here", None, None, f"2024-{i:03d}") for i in range(150)], kind)
    candidates = spark.createDataFrame([(1, "h", ["word000", "word149"])], "candidate_id bigint, handle string, skills array<string>")
    assert rp.verify_skills(candidates, repos).first()["verified_skills"] == ["word000", "word149"]
    assert rp.verify_skills(candidates, repos, fixed.MAX_REPOS_SEARCHED).first()["verified_skills"] == ["word149"]


def test_corpus_in_parts_and_phrases_over_repositories(spark):
    """Against one text per handle, made in Python."""
    kind = "handle string, name string, description string, language string, topics array<string>, updated_at string"
    draw = random.Random(4)
    words = ["red", "blue", "big data", "c#", "x", "node.js", "", "data", "a-b"]
    rows = []
    for i in range(700):
        handle = draw.choice(["hot"] * 6 + ["small", "tiny", None])
        day = draw.choice([None, "2024-01-01", "2024-05-05", f"2023-{i:04d}"])
        rows.append((handle, f"{draw.choice(words)}", draw.choice(words), draw.choice([None, "Data", ""]), draw.choice([None, [], ["Red"]]), day))
    rows = sorted({(r[0], r[5], r[1]): r for r in rows}.values(), key=repr)
    texts = {}
    for handle, name, description, language, topics, day in sorted(rows, key=lambda r: r[1]):
        parts = [language.lower()] if language else []
        parts += [x.lower() for x in topics or []] + [(c or "").lower().replace("-", " ").replace("_", " ") for c in (name, description)]
        texts.setdefault(handle, []).append((day or "", " ".join(parts)))
    texts = {h: [x for _, x in sorted(own, key=lambda r: r[0], reverse=True)] for h, own in texts.items()}
    repos = spark.createDataFrame(rows, kind)
    got = {(r["handle"], r["part"]): r["corpus"] for r in rp.repo_corpus(repos, per_part=50).collect()}
    assert got == {(h, i // 50): " ".join(own[i : i + 50]) for h, own in texts.items() for i in range(0, len(own), 50)}
    hot = " ".join(texts["hot"])
    asked = {"big data", "data red", "red big", "node.js x", "data red blue", "x  x", "blue c#", "nowhere", "red red red data", "c", hot[40:75].strip()}
    candidates = spark.createDataFrame([(1, "hot", sorted(asked)), (2, "tiny", sorted(asked))], "id int, handle string, skills array<string>")
    for r in rp.verify_skills(candidates, repos).collect():
        text = " ".join(texts[r["handle"]])
        assert r["verified_skills"] == sorted(a for a in asked if re.search(rf"\b{re.escape(a)}\b", text))
