"""Profile store, prompts, conforming, vectors, streaming."""

from __future__ import annotations

import datetime as dt
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow import schemas
from winnow.operators import conform, profiles, prompts, vectors
from winnow.operators.grouping import numbered
from winnow.session import use_checkpoint_dir
from winnow.sources import documents, profiles as store, templates
from winnow.streaming import screening as streaming


def test_json_import(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "skills.json").write_text(json.dumps([{"category": "c", "skills": ["a"]}, {"category": "d"}], indent=4))
    (tmp_path / "misc.json").write_text('[{"category": "c", ')
    got = [tuple(r) for r in store.read_profile_json(spark, root, "skills", 7).collect()]
    assert got == [(7, 0, "c", ["a"]), (7, 1, "d", None)]
    assert store.read_profile_json(spark, root, "misc", 7).count() == 0
    assert store.read_profile_json(spark, root, "projects", 7).count() == 0


def test_append_and_overwrite(spark, tmp_path):
    root = str(tmp_path)
    entry = spark.createDataFrame([(1, 0, "c", ["a"]), (2, 0, "d", None)], schemas.STORED["skills"])
    assert store.read_profile(spark, root, "skills").count() == 0
    store.append_profile(entry, root, "skills")
    store.append_profile(entry.filter("candidate_id = 1"), root, "skills")
    held = store.read_profile(spark, root, "skills")
    assert sorted(tuple(r)[:3] for r in held.collect()) == [(1, 0, "c"), (1, 1, "c"), (2, 0, "d")]
    store.overwrite_profile(held.filter("candidate_id = 1 and seq = 1"), root, "skills")
    assert sorted(tuple(r)[:3] for r in store.read_profile(spark, root, "skills").collect()) == [(1, 1, "c"), (2, 0, "d")]


def test_candidates_are_loaded_apart(spark, tmp_path):
    root = str(tmp_path)
    row = lambda n, *skills: (n, ["r"], [("cat", list(skills))], [], [], [("m", "x")])
    for loaded in ([row(1, "a"), row(2, "b")], [row(2, "c")]):
        profiles.populate_profile(spark.createDataFrame(loaded, schemas.PARSED_RESUME), root)
    skills = {r["candidate_id"]: r["skills"] for r in store.read_profile(spark, root, "skills").collect()}
    assert skills == {1: ["a"], 2: ["c"]}
    tables = {k: store.read_profile(spark, root, k) for k in ("skills", "misc")}
    context = {r["candidate_id"]: json.loads(r["context_json"]) for r in profiles.build_context(tables).collect()}
    assert len(context[1]["misc"]) == 1 and len(context[2]["misc"]) == 2
    assert {r["candidate_id"] for r in profiles.profile_ready(tables["skills"], store.read_profile(spark, root, "projects")).collect()} == {1, 2}


def test_the_named_checkpoint_folder_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = use_checkpoint_dir(spark)
    assert folder == (named or spark.sparkContext.getCheckpointDir())
    assert folder.removeprefix("file:") in spark.sparkContext.getCheckpointDir()
    assert use_checkpoint_dir(spark) == folder


def parsed(spark):
    row = (
        1, ["r"], [("cat", ["a", "b"])], [("p", ["x"], "d")],
        [("", ["do"]), ("Lead", ["run"])], [("Certifications", "c")],
    )
    return spark.createDataFrame([row, (2, None, None, None, None, None)], schemas.PARSED_RESUME)


def test_fan_out(spark):
    fanned = profiles.fan_out(parsed(spark))
    roles = profiles.entries_of(fanned, "responsibilities").orderBy("seq").collect()
    assert [tuple(r) for r in roles] == [(1, 0, "General Experience", ["do"]), (1, 1, "Lead", ["run"])]
    assert fanned.count() == 5 and fanned.filter("candidate_id = 2").count() == 0


@pytest.mark.parametrize("dedupe, grown", [(False, 2), (True, 1)])
def test_populating_twice(spark, tmp_path, dedupe, grown):
    root = str(tmp_path)
    for _ in range(2):
        profiles.populate_profile(parsed(spark), root, dedupe)
    counts = {k: store.read_profile(spark, root, k).count() for k in ("skills", "projects", "misc", "responsibilities")}
    assert counts == {"skills": 1, "projects": grown, "misc": grown, "responsibilities": 2 * grown}


def test_saved_projects_also_give_skills(spark, tmp_path):
    root = str(tmp_path)
    projects = spark.createDataFrame([(3, 0, "P", ["x", "y"], "d")], schemas.STORED["projects"])
    profiles.save_project(spark, projects, root)
    assert [tuple(r) for r in store.read_profile(spark, root, "skills").collect()] == [(3, 0, "Project Stack (P)", ["x", "y"])]


def test_numbering_equals_row_number_for_a_hot_key(spark):
    random.seed(5)
    rows = [("hot" if i % 3 else f"k{i % 7}", i * random.choice([1, 1, 5])) for i in range(2000)]
    rows = [(k, s * 2000 + i) for i, (k, s) in enumerate(rows)]
    got = numbered(spark.createDataFrame(rows, "k string, s bigint"), "k", "s", width=50_000).collect()
    want = {}
    for key in {k for k, _ in rows}:
        for place, seq in enumerate(sorted(s for k, s in rows if k == key), 1):
            want[key, seq] = place
    assert {(r["k"], r["s"]): r["position"] for r in got} == want


def test_numbers_of_sparse_places(spark):
    draw = random.Random(6)
    seqs = sorted({-(1 << 63), (1 << 63) - 1, *(draw.randrange(-(1 << 63), 1 << 63) for _ in range(500)), *range(-9, 9), *range(1 << 40, (1 << 40) + 99)})
    rows = spark.createDataFrame([("hot", s) for s in draw.sample(seqs, len(seqs))] + [("k", 1 << 50)], "k string, s bigint")
    placed = numbered(rows, "k", "s")
    got = {(r["k"], r["s"]): r["position"] for r in placed.collect()}
    assert got == {**{("hot", s): i for i, s in enumerate(seqs, 1)}, ("k", 1 << 50): 1}
    # Ranges are summed within wider ones, not all those of a key in one window.
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"windowspecdefinition\(k#\d+, _wider#\d+L?, _range#", plan)) == 2


def test_quick_glance(spark):
    rows = spark.createDataFrame(
        [(1, 10, "T", ["a", "b"]), (1, 20, None, ["c"])],
        "candidate_id bigint, seq bigint, context_title string, responsibilities array<string>",
    )
    got = sorted(tuple(r) for r in profiles.quick_glance(rows).collect())
    assert got == [(1, 1, "T", 0, "a"), (1, 1, "T", 1, "b"), (1, 2, "Role Context #2", 0, "c")]


def test_context_is_nested_in_order_and_parted_without_loss(spark):
    skills = spark.createDataFrame([(1, 5, "b", ["y"]), (1, 2, "a", None)], "candidate_id bigint, seq bigint, " + schemas.SKILL_ENTRY)
    misc = spark.createDataFrame([(1, i, f"c{i}", "x") for i in range(5)] + [(2, 0, "z", "x")], "candidate_id bigint, seq bigint, " + schemas.MISC_ENTRY)
    whole = {r["candidate_id"]: json.loads(r["context_json"]) for r in profiles.build_context({"skills": skills, "misc": misc}).collect()}
    assert whole[1]["skills"] == [{"category": "a", "skills": None}, {"category": "b", "skills": ["y"]}]
    assert list(whole[1]) == ["skills", "projects", "responsibilities", "challenges", "misc"]
    assert whole[2]["skills"] == [] and len(whole[1]["misc"]) == 5
    parts = profiles.build_context({"skills": skills, "misc": misc}, entries_per_part=2).filter("candidate_id = 1")
    got = {r["part"]: [m["category"] for m in r["context"]["misc"]] for r in parts.collect()}
    assert got == {0: ["c0", "c1"], 1: ["c2", "c3"], 2: ["c4"]}


def test_read_pages_takes_three_columns(spark, sf_dir):
    pages = documents.read_pages(spark, f"{sf_dir}/pages.parquet")
    assert pages.columns == ["page_id", "url", "html"] and pages.count() == 50


def test_pages_in_order_and_parts(spark):
    rows = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, None)], "d bigint, n int, t string")
    assert [tuple(r) for r in documents.assemble_pages(rows, "d", "n", "t").collect()] == [(1, 0, "ac", 3)]
    parts = documents.assemble_pages(rows, "d", "n", "t", pages_per_part=2)
    assert sorted(tuple(r) for r in parts.collect()) == [(1, 0, "a", 2), (1, 1, "c", 1)]


# --- prompts, replies ----------------------------------------------------------------
def test_missing_template_is_an_error(spark):
    known = spark.createDataFrame([("f", "k", "x"), ("f", "empty", "")], "file string, key string, template string")
    wanted = spark.createDataFrame([("f", "k")], "file string, key string")
    assert templates.require_template(wanted, known).first()["template"] == "x"
    for key in ("other", "empty"):
        asked = spark.createDataFrame([("f", key)], "file string, key string")
        with pytest.raises(Exception, match="no template for f " + key):
            templates.require_template(asked, known).collect()


def test_reply_repair(spark):
    raws = [
        '```json\n{"headline":"h","about_section":" a\\\\nb ","featured_hashtags":["#x"]}\n```',
        '{"headline":"h"}', "[1,2]", " prose\\n ", "```\nx\n```", '{"about_section":null}',
    ]
    rows = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    got = {r["id"]: r for r in prompts.parse_reply(rows, "linkedin_reply").collect()}
    assert (got[0]["headline"], got[0]["about_section"], got[0]["featured_hashtags"]) == ("h", "a\nb", ["#x"])
    assert (got[1]["headline"], got[1]["about_section"], got[1]["parsed"]) == ("h", "", True)
    assert (got[2]["about_section"], got[2]["parsed"], got[2]["featured_hashtags"]) == ("[1,2]", False, [])
    assert got[3]["about_section"] == "prose" and got[4]["about_section"] == "```\nx\n```"
    assert got[5]["about_section"] == ""
    other = prompts.parse_reply(rows, "resume_reply").orderBy("id").collect()
    assert other[3]["professional_summary"] == "prose\\n" and other[1]["highlighted_bullets"] == []


# --- conforming ----------------------------------------------------------------------
def test_conform_fills_defaults_and_quarantines(spark):
    rows = spark.createDataFrame([(1, "c", None), (2, None, ["a"])], "id int, category string, skills array<string>")
    checked = conform.conform(rows, "skill_entry", ["id"])
    good, bad = conform.split_valid(checked)
    assert [tuple(r) for r in good.collect()] == [(1, "c", [])]
    assert [(r["id"], r["reason"]) for r in bad.collect()] == [(2, "category")]


def test_conform_every_model(spark):
    rows = spark.createDataFrame([(1, "{}")], "id int, payload string")
    for model, fields in schemas.MODELS.items():
        got = conform.conform_json(rows, "payload", model, ["id"]).first()
        needed = [n for n, (_, default) in fields.items() if default is schemas.REQUIRED]
        assert got["reason"] == (", ".join(needed) or None), model
        for name, (_, default) in fields.items():
            assert got[name] == (None if default is schemas.REQUIRED else default)


# --- vectors -----------------------------------------------------------------------
def test_cosine_topk_equals_numpy(spark):
    rng = np.random.default_rng(1)
    corpus, queries = rng.normal(size=(300, 8)), rng.normal(size=(5, 8))
    corpus[7] = 0.0
    kind = "bigint, embedding array<double>"
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "doc_id " + kind).repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id " + kind)
    got = vectors.cosine_topk(table, asked, 4).collect()
    norm = np.linalg.norm(corpus, axis=1)
    norm[7] = 1.0
    scores = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ (corpus / norm[:, None]).T
    for i in range(5):
        want = np.argsort(-scores[i], kind="stable")[:4].tolist()
        rows = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["query_id"] == i)
        assert [r[1] for r in rows] == want
        assert np.allclose([r[2] for r in rows], scores[i][want])


def test_many_more_queries_than_a_block_holds(spark):
    """Ten times as many cells as a block, blocks of queries against blocks of the corpus, with ties and two sizes."""
    rng = np.random.default_rng(3)
    corpus, queries = rng.integers(-2, 3, size=(900, 6)).astype(float), rng.integers(-2, 3, size=(500, 6)).astype(float)
    kind = "bigint, embedding array<double>"
    longer = [(10_000 + i, [1.0, float(i), 2.0, 0.0, 1.0, 3.0, 1.0]) for i in range(40)]
    table = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(corpus)), *longer], "doc_id " + kind).repartition(3)
    asked = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(queries)), *longer[:9]], "query_id " + kind)
    plain = vectors.cosine_topk(table, asked, 4)
    blocked = vectors.cosine_topk(table, asked, 4, block_cells=300)
    assert "CoGroup" in blocked._jdf.queryExecution().toString() and "CoGroup" not in plain._jdf.queryExecution().toString()
    exact = lambda rows: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in rows)
    found = blocked.collect()
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    scores = np.round(unit(queries) @ unit(corpus).T, 9)
    want = [(q, r + 1, int(d), scores[q, d]) for q in range(500) for r, d in enumerate(np.argsort(-scores[q], kind="stable")[:4])]
    by_score = lambda rows: sorted((q, r, s) for q, r, _, s in rows)
    # Scores that differ in the last bits only may swap places, so ids are compared where scores are alike in both.
    assert by_score(r for r in exact(found) if r[0] < 10_000) == by_score(want) == by_score(r for r in exact(plain.collect()) if r[0] < 10_000)
    assert len(found) == 509 * 4 and {r["doc_id"] >= 10_000 for r in found if r["query_id"] >= 10_000} == {True}


def test_upsert_keeps_the_latest_and_checks_the_dimension(spark):
    kind = "doc_id string, embedding array<float>, metadata map<string,string>, version bigint"
    old = spark.createDataFrame([("a", [1.0, 0.0], {"k": "old"}, 2), ("b", [0.0, 1.0], {}, 1)], kind)
    new = spark.createDataFrame([("a", [0.5, 0.5], {"k": "new"}, 2), ("b", [9.0, 9.0], {}, 0), ("c", [1.0, 1.0], {}, 1)], kind)
    got = {r["doc_id"]: (r["embedding"], r["metadata"]) for r in vectors.upsert_vectors(old, new, 2).collect()}
    assert got == {"a": ([0.5, 0.5], {"k": "new"}), "b": ([0.0, 1.0], {}), "c": ([1.0, 1.0], {})}
    with pytest.raises(Exception, match="wrong vector dimension"):
        vectors.upsert_vectors(old, new, 3).collect()


# --- streaming -----------------------------------------------------------------------
def test_stream_equals_batch_and_drops_repeats(spark, tmp_path):
    from winnow.operators import screening, skills

    resumes = spark.createDataFrame([(1, 9.0, ["a"]), (2, 9.0, ["z"])], "resume_id bigint, candidate_experience double, candidate_skills array<string>")
    jds = spark.createDataFrame([(1, None, ["A", "b"])], "jd_id bigint, experience_required double, required_skills array<string>")
    at = dt.datetime(2025, 1, 1)
    apps = spark.createDataFrame([(1, 1, 1, at), (2, 2, 1, at)], streaming.APPLICATION)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    apps.write.parquet(source)
    for _ in range(2):
        arriving = streaming.read_applications(spark, source)
        routed = streaming.screen_stream(arriving, resumes, jds).select("application_id", "skill_match", "route")
        streaming.write_routed(routed, out, state).awaitTermination()
        apps.filter("application_id = 2").write.mode("append").parquet(source)
    batch = screening.route(skills.match_skills(apps, resumes, jds)).select("application_id", "skill_match", "route")
    got = spark.read.parquet(out).select("application_id", "skill_match", "route")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    arrived = str(tmp_path / "arrived")
    columns = ["application_id", "skill_match", "route"]
    for _ in range(2):
        arriving = streaming.read_applications(spark, source)
        streaming.screen_arrivals(arriving, resumes, jds, arrived, str(tmp_path / "state2"), columns).awaitTermination()
        apps.filter("application_id = 1").write.mode("append").parquet(source)
    got = spark.read.parquet(arrived).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_late_and_repeated_applications_are_neither_lost_nor_doubled(spark, tmp_path):
    from winnow.operators import screening, skills

    resumes = spark.createDataFrame([(i, 9.0, ["a"]) for i in range(4)], "resume_id bigint, candidate_experience double, candidate_skills array<string>")
    jds = spark.createDataFrame([(1, None, ["A", "b"])], "jd_id bigint, experience_required double, required_skills array<string>")
    newest = dt.datetime(2025, 6, 1)
    days = [0, 40, 3, 400]  # before the newest, in the order in which they arrive
    rows = [(i, i, 1, newest - dt.timedelta(days=d)) for i, d in enumerate(days)]
    columns = ["application_id", "skill_match", "route"]
    batch = screening.route(skills.match_skills(spark.createDataFrame(rows, streaming.APPLICATION), resumes, jds)).select(*columns)
    source, arrived, out = (str(tmp_path / n) for n in ("in", "arrived", "out"))
    for row in [*rows, rows[1], rows[0]]:
        spark.createDataFrame([row], streaming.APPLICATION).write.mode("append").parquet(source)
        arriving = streaming.read_applications(spark, source)
        streaming.screen_arrivals(arriving, resumes, jds, arrived, str(tmp_path / "s1"), columns).awaitTermination()
        routed = streaming.screen_stream(arriving, resumes, jds).select(*columns)
        streaming.write_routed(routed, out, str(tmp_path / "s2")).awaitTermination()
    want = sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, spark.read.parquet(arrived).select(*columns).collect())) == want
    assert sorted(map(tuple, spark.read.parquet(out).select(*columns).collect())) == want
    with pytest.raises(ValueError, match="application_id"):
        streaming.screen_arrivals(arriving, resumes, jds, arrived, out, ["route"])


def test_streamed_entries_join_the_batch_ones(spark, tmp_path):
    root, source = str(tmp_path / "store"), str(tmp_path / "in")
    entry = spark.createDataFrame([(1, 0, "c", "x")], schemas.STORED["misc"])
    store.append_profile(entry, root, "misc")
    entry.write.parquet(source)
    for _ in range(2):
        arriving = spark.readStream.schema(schemas.STORED["misc"]).parquet(source)
        streaming.append_stream(arriving, root, "misc", "form", str(tmp_path / "state")).awaitTermination()
    assert sorted(tuple(r) for r in store.read_profile(spark, root, "misc").collect()) == [(1, 0, "c", "x"), (1, 1, "c", "x")]


def test_search_passes_over_vectors_that_cannot_be_compared(spark):
    kind = "string, embedding array<double>"
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0, None]), ("d", [1.0]), ("e", [0.0, 1.0])], f"doc_id {kind}")
    queries = spark.createDataFrame([("q", [1.0, 0.1]), ("r", None), ("s", [1.0])], f"query_id {kind}")
    got = [(r["query_id"], r["doc_id"]) for r in vectors.cosine_topk(corpus, queries, 5).filter("rank > 0").collect()]
    assert sorted(got) == [("q", "a"), ("q", "e"), ("s", "d")]
    assert vectors.cosine_topk(corpus, queries.limit(0), 5).schema["doc_id"].dataType.simpleString() == "string"


def test_search_compares_each_query_with_vectors_of_its_size(spark, tmp_path):
    kind = "string, embedding array<double>"
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0, None]), ("d", [1.0, 2.0, 3.0]), ("e", [0.0, 1.0])], f"doc_id {kind}")
    asked = [("q", [1.0, 0.1]), ("r", None), ("s", [1.0, 2.0, 3.0]), ("t", [1.0, None]), ("u", [1.0]), ("v", []), (None, [1.0, 0.0])]
    queries = spark.createDataFrame(asked, f"query_id {kind}")
    want = [(None, None, None, "null id"), ("q", 1, "a", "compared"), ("q", 2, "e", "compared"), ("r", None, None, "null vector")]
    want += [("s", 1, "d", "compared"), ("t", None, None, "null in vector"), ("u", None, None, "no vector of its size"), ("v", None, None, "empty vector")]
    rows = lambda frames: sorted((tuple(r)[:3] + (r["status"],) for f in frames for r in f.collect()), key=str)
    for cells in (vectors.BLOCK_CELLS, 4, 1):
        assert rows([vectors.cosine_topk(corpus, queries, 5, cells)]) == sorted(want, key=str)
    assert vectors.cosine_topk(corpus, queries.limit(0), 5).count() == 0


def test_one_longer_embedding_costs_other_labels_nothing(spark, tmp_path):
    rows = [(i, [float(i % 5 + 1), float(i % 3), 1.0], i % 2) for i in range(40)]
    kind = "vec_id bigint, embedding array<float>, label int"
    from winnow.plans import QUERIES

    for name, more in (("even", []), ("odd", [(40, [1.0, 2.0, 3.0, 4.0], 1)])):
        spark.createDataFrame(rows + more, kind).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    even, odd = ({tuple(r) for r in QUERIES["cosine_topk"](spark, f"{tmp_path}/{name}").collect()} for name in ("even", "odd"))
    assert {r for r in odd if r[0] == 0} == {r for r in even if r[0] == 0} and len({r for r in odd if r[0] == 0}) == 10
    assert [r[:3] for r in odd if r[0] == 1] == [(1, 1, 40)]


def test_inventory_and_readiness(spark):
    skills = spark.createDataFrame([("c", ["a", "A", "b"]), ("d", ["a"])], schemas.SKILL_ENTRY)
    got = sorted(tuple(r) for r in profiles.skill_inventory(skills).collect())
    assert got == [("c", 3, 2), ("d", 1, 1)]
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "candidate_id bigint")
    ready = profiles.profile_ready(ids(1, 1), ids(2)).select(F.col("candidate_id")).collect()
    assert sorted(r["candidate_id"] for r in ready) == [1, 2]
