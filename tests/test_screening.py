"""Matching, routing, gap reports, tagging."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from winnow import fixed_values as fixed
from winnow.operators import gaps, redaction, screening, skills

RESUME = "resume_id bigint, resume_text string, candidate_name string, candidate_experience double, candidate_skills array<string>"
JD = "jd_id bigint, company_name string, job_title string, experience_required double, required_skills array<string>"
APP = "application_id bigint, resume_id bigint, jd_id bigint"


@pytest.fixture(scope="module")
def routed(spark):
    resumes = spark.createDataFrame(
        [
            (1, "t", "Ada Example", 14.0, ["Weaving", "Dyeing", "Kiln", "Python", "Glaze", "Loom", "Node.js"]),
            (2, "t", "Bo Example", 8.0, ["PYTHON"]),
            (3, "t", "Cy Example", None, None),
        ],
        RESUME,
    )
    jds = spark.createDataFrame(
        [
            (1, "Acme", "Head of the workshop", 10.0,
             ["Weaving", "Carding", "Dyeing", "Felt work", "Spinning", "Python", "Carving", "Kiln", "Glaze"]),
            (2, "Acme", "Master of the forge", 18.0, ["Anvil", "C++", "Bellows", "Quench"]),
            (3, "Acme", "Dev", None, ["Python", " python ", "SQL"]),
            (4, "Acme", "Any", 0.0, []),
        ],
        JD,
    )
    pairs = [(1, 1, 1), (2, 1, 2), (3, 2, 3), (4, 2, 4), (5, 3, 3), (6, 1, 3), (7, 9, 1)]
    apps = spark.createDataFrame(pairs, APP)
    rows = screening.route(skills.match_skills(apps, resumes, jds)).collect()
    return {r["application_id"]: r for r in rows}


def test_scenario_pair(routed):
    assert routed[1]["skill_match"] == pytest.approx(5 / 9) and routed[1]["route"] == "ShortList"
    assert routed[2]["skill_match"] == 0.0 and routed[2]["route"] == "Reject"


def test_duplicates_count_once_but_stay_listed(routed):
    assert routed[3]["skill_match"] == 0.5 and routed[3]["matched_skills"] == ["Python", " python "]
    assert routed[3]["route"] == "ShortList"  # exactly the threshold, and the default of 8 years


def test_nothing_required_scores_zero(routed):
    assert routed[4]["skill_match"] == 0.0 and routed[4]["route"] == "Reject"


def test_absent_values_and_unknown_resumes_keep_a_row(routed):
    assert routed[5]["route"] == "Reject" and routed[5]["skill_match"] == 0.0
    assert routed[7]["skill_match"] == 0.0 and routed[7]["route"] == "Reject"


def test_invariants_over_the_tables(spark, sf_dir):
    from winnow.plans import screening as plans

    rows = plans.routed(spark, sf_dir)
    missing = skills.missing_skills(F.col("required_skills"), F.col("candidate_skills"))
    bad = rows.filter(
        (F.col("skill_match") < 0)
        | (F.col("skill_match") > 1)
        | (F.size(missing) + F.col("n_matched") != F.col("n_required"))
        | (F.size(F.array_except("matched_skills", "required_skills")) > 0)
    )
    assert bad.count() == 0
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.75, 1.0])
def test_screen_all_equals_brute_force(spark, threshold):
    random.seed(int(threshold * 100))
    words = [f"s{i}" for i in range(25)]
    weights = [30 // (i + 1) + 1 for i in range(25)]  # a few skills that nearly everyone has
    people = {i: random.choices(words, weights, k=random.randint(0, 9)) for i in range(60)}
    jobs = {i: random.choices(words + ["rare"], weights + [1], k=random.randint(0, 6)) for i in range(40)}
    got = skills.screen_all(
        spark.createDataFrame(list(people.items()), "resume_id bigint, candidate_skills array<string>"),
        spark.createDataFrame(list(jobs.items()), "jd_id bigint, required_skills array<string>"),
        threshold,
    )
    want = {
        (p, j, len(set(need) & set(have)))
        for p, have in people.items()
        for j, need in jobs.items()
        if need and len(set(need) & set(have)) / len(set(need)) >= threshold
    }
    assert {(r["resume_id"], r["jd_id"], r["n_matched"]) for r in got.collect()} == want


def test_screen_all_refuses_a_threshold_that_means_all_pairs(spark):
    empty = spark.createDataFrame([], "resume_id bigint, candidate_skills array<string>")
    with pytest.raises(ValueError):
        skills.screen_all(empty, empty, 0.0)


def test_input_gate(spark):
    rows = spark.createDataFrame(
        [("r", "url", " ", None), ("r", "url", "http://x", None), ("r", "text", None, "\n"), ("", "text", None, "j"),
         ("r", "text", None, "j")],
        "resume_text string, input_mode string, jd_url string, jd_text string",
    )
    got = [r["reason"] for r in screening.validate_applications(rows).collect()]
    assert got == ["no job address", None, "no job description", "no resume", None]


def test_jd_text(spark):
    rows = spark.createDataFrame([("T", "O", "p"), ("T", "", "p"), ("T", None, "p")], "t string, o string, p string")
    out = rows.select(screening.assemble_jd_text(F.col("t"), F.col("o"), F.col("p")).alias("j")).collect()
    assert [r["j"] for r in out] == ["Job Title: T\nOverview:\nO", "p", "p"]


def test_badges_ignore_case(spark):
    rows = spark.createDataFrame(
        [(1, ["A", "b"], ["B", "c"], ["b"])],
        "id int, required_skills array<string>, candidate_skills array<string>, matched_skills array<string>",
    )
    got = {(r["side"], r["skill"]): r["matched"] for r in screening.skill_badges(rows, ["id"]).collect()}
    assert got == {("required", "A"): False, ("required", "b"): True, ("candidate", "B"): True, ("candidate", "c"): False}


def test_gap_report_reflects_once(spark):
    kind = "application_id bigint, resume_id bigint, missing_skills array<string>"
    rejects = spark.createDataFrame([(1, 1, ["docker", "sql"]), (2, 2, []), (3, 3, ["docker"])], kind)
    aliases = spark.createDataFrame([("docker", "Containerization"), ("SQL", "relational databases")], "skill string, alias string")
    resumes = spark.createDataFrame(
        [(1, "Containerization of services"), (2, "x"), (3, "Containerizations")], "resume_id bigint, resume_text string"
    )
    got = {r["application_id"]: r for r in gaps.gap_report(rejects, aliases, resumes).collect()}
    assert got[1]["first_missing"] == ["docker", "sql"] and got[1]["missing"] == ["sql"]
    assert (got[1]["reflection_count"], got[1]["first_critique"]) == (2, fixed.FLAG_WRONG_GAP)
    assert got[2]["missing"] == [] and fixed.NO_MISSING_SKILLS in got[2]["rejection_feedback"]
    assert (got[3]["reflection_count"], got[3]["missing"]) == (1, ["docker"])
    assert got[1]["rejection_feedback"].startswith("**Missing Skills:** sql\n\n**Suggestions:** Focus")


def test_tagging_by_whole_words_of_any_length(spark):
    docs = spark.createDataFrame([(1, "C++ and Node.js, not Java-Script."), (2, "a b c d e f"), (3, None)], "id int, text string")
    lexicon = spark.createDataFrame(
        [("c++",), ("node.js",), ("java script",), ("java",), ("C",), ("b c d e",), ("Not",)], "skill string"
    )
    got = {(r["id"], r["skill"]) for r in skills.tag_skills(docs, "id", "text", lexicon).collect()}
    assert got == {(1, "c++"), (1, "node.js"), (1, "java script"), (1, "java"), (1, "Not"), (2, "b c d e"), (2, "C")}


def test_tagging_with_an_empty_lexicon(spark):
    docs = spark.createDataFrame([(1, "a")], "id int, text string")
    lexicon = spark.createDataFrame([], "skill string")
    assert skills.tag_skills(docs, "id", "text", lexicon).count() == 0


def test_redact_with_gazetteer(spark):
    docs = spark.createDataFrame(
        [(1, "Ann Lee of York wrote to Ann, annually. x@y.zz"), (2, ""), (3, None)], "id int, text string"
    )
    names = spark.createDataFrame(
        [("Ann Lee", "PERSON"), ("Ann", "PERSON"), ("York", "LOCATION"), ("Y.k", "LOCATION")], "term string, entity_type string"
    )
    got = {r["id"]: r for r in redaction.redact(docs, "id", "text", names).collect()}
    assert got[1]["text"] == "<PERSON> of <LOCATION> wrote to <PERSON>, annually. <EMAIL_ADDRESS>"
    assert [got[i]["pii_scrubbed"] for i in (1, 2, 3)] == [True, False, False]
    spans = {(r["id"], r["entity_type"], r["value"]) for r in redaction.pii_spans(docs, "id", "text", names).collect()}
    assert (1, "PERSON", "Ann Lee") in spans and (1, "EMAIL_ADDRESS", "x@y.zz") in spans


def test_merge_roles(spark):
    row = spark.createDataFrame([(["b", "a"], ["c", "b"])], "n array<string>, o array<string>")
    none = F.lit(None).cast("array<string>")
    got = row.select(
        skills.merge_roles(F.col("n"), F.col("o")).alias("merged"), skills.merge_roles(F.col("n"), none).alias("seeded")
    ).first()
    assert got["merged"] == ["b", "a", "c"] and got["seeded"] == ["b", "a", *fixed.DEFAULT_ROLES]


def test_skill_sources_in_order(spark):
    kind = (
        "id int, matched_skills array<string>, candidate_skills string, resume_skills string, skills array<string>, "
        "resume_data struct<skills:array<string>,core_skills:string>"
    )
    rows = spark.createDataFrame(
        [
            (1, [" ", "x ", None, ""], "no", "p, ,q", ["s"], None),
            (2, [], "ignored text", "p, ,q", ["s"], None),
            (3, None, None, "", ["s"], None),
            (4, None, None, None, None, ([], "c, d")),
            (5, None, None, None, None, None),
        ],
        kind,
    )
    got = rows.select("id", skills.resolve_skills(rows).alias("s")).orderBy("id").collect()
    assert [r["s"] for r in got] == [["", "x"], ["p", "q"], ["s"], ["c", "d"], []]


def test_a_leading_dot_belongs_to_the_skill(spark):
    docs = spark.createDataFrame([(1, "net profit"), (2, "knows .NET, C++ and node.js."), (3, "a.net b ..net")], "id bigint, text string")
    lexicon = spark.createDataFrame([(".NET",), ("net",), ("node.js",), ("c++",)], "skill string")
    got = sorted(tuple(r) for r in skills.tag_skills(docs, "id", "text", lexicon).collect())
    assert got == [(1, "net"), (2, ".NET"), (2, "c++"), (2, "node.js"), (3, "net")]


def test_subtotals_are_told_from_jobs_without_a_title(spark):
    rows = spark.createDataFrame([(None, "Reject", 0.5), ("a", "Reject", 0.5), ("a", "ShortList", 1.0)], "job string, route string, skill_match double")
    got = {(r["level"], r["job"], r["route"]): r["n"] for r in screening.funnel(rows, "job").collect()}
    assert got == {(0, None, "Reject"): 1, (0, "a", "Reject"): 1, (0, "a", "ShortList"): 1, (1, None, None): 1, (1, "a", None): 2, (3, None, None): 3}
