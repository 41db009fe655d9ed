"""What the physical plans of the registered queries may and may not hold."""

from __future__ import annotations

import re

import pytest

from winnow.plans import QUERIES

STREAMS = {"stream_screen", "screen_arrivals", "profile_store", "stream_profile"}  # run when they are built
NUMPY = {"cosine_topk"}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_all_pairs_join_and_no_python(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert ("Python" in plan or "InPandas" in plan) == (name in NUMPY)


@pytest.mark.parametrize(
    "name, columns",
    [
        ("screen_applications", {"doc_id", "text", "quality", "item_id"}),
        ("recent_or_all", {"o_orderkey", "o_custkey", "o_orderdate"}),
        ("repo_totals", {"o_custkey"}),
        ("skill_tagging", {"doc_id", "text"}),
    ],
)
def test_scans_read_only_what_is_used(spark, sf_dir, name, columns):
    read = set()
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES[name](spark, sf_dir))):
        read |= {field.split(":")[0] for field in schema.split(",") if field}
    assert read and read <= columns


@pytest.mark.parametrize("name", ["top_repos", "top_hits", "commit_cards", "cosine_topk"])
def test_limits_come_before_the_shuffle(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert re.search(r"WindowGroupLimit .* Partial", plan)


def test_text_is_cut_once_for_tagging(spark, sf_dir):
    plan = plan_of(QUERIES["role_tagging"](spark, sf_dir))
    assert plan.count("regexp_extract_all(lower(text") == 1
