"""Code corpus and search."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from winnow import fixed_values as fixed
from winnow.functions import text as t
from winnow.operators import code_search as code
from winnow.plans import tables
from winnow.sources import corpus

from tests.test_skew import SMALL_DATA_ACTS_LARGE, settings

LONG = "\n".join(f"line {i}" for i in range(1, 41)).replace("line 20", "line 20 Needle")


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("p1", "a.py", "needle first\nneedle second\nlast"),
        ("p1", "b.js", LONG),
        ("p1", "c.ts", "x\ny\nthe needles"),
        ("p2", "README.md", "About azure things. " + "z" * 500),
        ("p2", "d.py", "nothing"),
    ]
    return spark.createDataFrame(rows, corpus.CORPUS)


def asked(spark, *skills):
    return spark.createDataFrame([(s,) for s in skills], "skill string")


def test_first_hit_and_window(spark, files):
    hits = code.best_hits(files, asked(spark, "Needle"))
    got = {r["path"]: r for r in hits.collect()}
    assert got["a.py"]["line_no"] == 1 and got["a.py"]["snippet"] == "needle first\nneedle second\nlast"
    assert got["b.js"]["line_no"] == 20
    assert got["b.js"]["snippet"].split("\n") == [
        "line 20 Needle" if i == 20 else f"line {i}" for i in range(12, 28)
    ]
    assert got["c.ts"]["snippet"] == "x\ny\nthe needles"
    assert len(got) == 3


def test_any_term_of_a_skill_matches_and_readmes_come_whole(spark, files):
    got = code.readme_hits(files, asked(spark, "Azure AI Foundry")).collect()
    assert [(r["project"], len(r["overview"])) for r in got] == [("p2", 400)]


def test_encounter_order(spark, files):
    best = code.top_hits(code.search_code(files, asked(spark, "needle azure")))
    got = [(r["project"], r["path"]) for r in best.orderBy("rank").collect()]
    assert got == [("p1", "a.py"), ("p1", "c.ts"), ("p1", "b.js")]


def test_whole_words(spark, files):
    got = code.first_hit_per_file(files, asked(spark, "needle"), whole_word=True).collect()
    assert {r["path"] for r in got} == {"a.py", "b.js"}


def test_status(spark, files):
    wanted = asked(spark, "C#", "needle", "absent")
    status = code.search_status(files, wanted, code.search_code(files, wanted)).collect()
    assert dict(map(tuple, status)) == {"C#": "no_terms", "needle": "found", "absent": "no_matches"}
    nothing = files.limit(0)
    status = code.search_status(nothing, wanted, code.search_code(nothing, wanted)).collect()
    assert {r["status"] for r in status} == {"no_corpus"}


def test_all_skills_are_proven_unless_fewer_are_asked_for(spark, files):
    jds = spark.createDataFrame(
        [(1, ["a1", "b1", "c1", "d1", "needle"]), (2, ["needle", "qqq"])], "jd_id bigint, required_skills array<string>"
    )
    proofs = code.code_proofs(jds, files, 4).collect()
    assert {(r["jd_id"], r["requirement"]) for r in proofs} == {(2, "needle")} and len(proofs) == 3
    assert dict(map(tuple, code.proof_counts(jds, files, 4).collect())) == {1: 0, 2: 3}
    assert {(r["jd_id"], r["pos"]) for r in code.code_proofs(jds, files).collect()} == {(1, 4), (2, 0)}
    assert dict(map(tuple, code.proof_counts(jds, files).collect())) == {1: 3, 2: 3}


def test_search_equals_brute_force(spark):
    random.seed(11)
    parts = ["ab", "ba", "abc", "é", "c", "a.b", "#", "the", "he"]
    word = lambda: "".join(random.choices(parts, k=random.randint(1, 4)))
    texts = {
        (f"p{i % 4}", f"f{i}.py"): "\n".join(" ".join(word() for _ in range(random.randint(0, 6))) for _ in range(5))
        for i in range(80)
    }
    skills = {word() for _ in range(40)} | {f"{word()} {word()}" for _ in range(10)}
    corpus_rows = spark.createDataFrame([(*k, v) for k, v in texts.items()], corpus.CORPUS)
    wanted = asked(spark, *skills)
    got = code.first_hit_per_file(corpus_rows, wanted).collect()
    want = set()
    for skill in skills:
        terms = [w.lower() for w in skill.split() if len(w) > 2]
        for (project, path), content in texts.items():
            for number, line in enumerate(content.split("\n"), 1):
                if any(term in line.lower() for term in terms):
                    want.add((skill, project, path, number))
                    break
    assert {(r["skill"], r["project"], r["path"], r["line_no"]) for r in got} == want
    found = code.matching_files(corpus_rows, wanted).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == {hit[:3] for hit in want}
    columns = ["skill", "project", "path", "kind", "ext_rank", "line_no", "rank"]
    for whole_word in (False, True):
        best = code.best_hits(corpus_rows, wanted, 2, whole_word).select(*columns).collect()
        cut = code.top_hits(code.search_code(corpus_rows, wanted, whole_word), 2)
        assert best and sorted(best) == sorted(cut.select(*columns).collect())


def test_long_words_equal_brute_force(spark):
    random.seed(5)
    words = ["".join(random.choices("abcdeé.-", k=random.choice([3, 200, 400, 1000]))) for _ in range(60)]
    rows = [("p", f"f{i}.py", "\n".join([f"x{i}", w, w[:90]])) for i, w in enumerate(words)]
    skills = {w[k : k + random.randint(3, 140)] for w in words for k in random.sample(range(max(1, len(w) - 2)), 2 if len(w) > 3 else 1)}
    skills = {s for s in skills if len(s) > 2}
    corpus_rows, wanted = spark.createDataFrame(rows, corpus.CORPUS), asked(spark, *skills)
    for whole_word in (False, True):

        def holds(line, term):
            found = re.search(rf"\b{re.escape(term)}\b", line) if whole_word else term in line
            return bool(found)

        want = set()
        for _, path, content in rows:
            for term in skills:
                line = next((n for n, x in enumerate(content.split("\n"), 1) if holds(x, term)), None)
                want |= {(term, "p", path, line)} if line else set()
        got = code.first_hit_per_file(corpus_rows, wanted, whole_word).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        assert {tuple(r) for r in code.matching_files(corpus_rows, wanted, whole_word).collect()} == {w[:3] for w in want}


def test_a_megabyte_without_a_space(spark):
    rows = spark.range(4).select(
        F.lit("p").alias("project"),
        F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".js")).alias("path"),
        F.concat(F.repeat(F.lit("abcdefghij"), 100_000), F.lit("Needle"), F.col("id").cast("string")).alias("content"),
    )
    with settings(spark, SMALL_DATA_ACTS_LARGE):
        got = code.best_hits(rows, asked(spark, "needle2", "jabc", "absent"), 9).collect()
    assert sorted((r["skill"], r["path"]) for r in got) == [("jabc", f"f{i}.js") for i in range(4)] + [("needle2", "f2.js")]


def test_corpus_scan(spark, tmp_path):
    made = {
        "p1/README.md": b"read me", "p1/docs/README.md": b"not at the top", "p1/notes.md": b"ignored",
        "p1/a.py": b"bad \xff byte\r\nnext", "p1/sub/deep/b.swift": b"s", "p1/build/c.py": b"vendor",
        "p1/.venv/d.py": b"vendor", "p1/node_modules/x/e.js": b"vendor", "p1/__init__.py": b"init",
        "p1/_priv/f.py": b"under", "p1/g.txt": b"other", "p 2/h.ts": b"spaced", "top.py": b"in no project",
        "p1/.hidden.py": b"hidden", "p1/n+1%.ipynb": b"{}", "_p3/README.md": b"own", "_p3/i.py": b"i",
        f"p1{tmp_path}/j.py": b"the root's path once more",
    }
    for name, content in made.items():
        place = tmp_path / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(content)
    def scan(root):
        return {(r["project"], r["path"]): r["content"] for r in corpus.read_code_corpus(spark, root).collect()}

    got = scan(str(tmp_path))
    assert got == scan(f"file:{tmp_path}/") == scan(f"file://{tmp_path}")
    assert got == {
        ("p1", "README.md"): "read me", ("p1", "a.py"): "bad  byte\r\nnext", ("p1", "sub/deep/b.swift"): "s",
        ("p1", "__init__.py"): "init", ("p1", "_priv/f.py"): "under", ("p 2", "h.ts"): "spaced",
        ("p1", "n+1%.ipynb"): "{}", ("_p3", "README.md"): "own", ("_p3", "i.py"): "i",
        ("p1", f"{str(tmp_path)[1:]}/j.py"): "the root's path once more",
    }


def test_project_limit(spark):
    rows = [(f"p{i:02d}", f"f{j}.py", "x") for i in range(20) for j in range(2)]
    kept = corpus.limit_projects(spark.createDataFrame(rows, corpus.CORPUS)).collect()
    assert {r["project"] for r in kept} == {f"p{i:02d}" for i in range(fixed.MAX_PROJECTS)} and len(kept) == 30


def test_content_lines_survive_window_ends(spark):
    rows = spark.createDataFrame([("a\nb", 1), ("a\nb", 2)], "c string, n int")
    got = rows.select(code.snippet(t.lines_of(F.col("c")), F.col("n")).alias("s")).collect()
    assert [r["s"] for r in got] == ["a\nb", "a\nb"]


def test_first_files_of_words_hold_the_first_files_of_skills(spark):
    """Against ranking every hit; a term of every file sends three rows a word, not a row per file."""
    draw = random.Random(8)
    words = ["alpha", "alphabet", "beta", "betamax", "gamma", "common"]
    rows = [
        (f"p{draw.randint(0, 5)}", f"src/f{i:04d}.{draw.choice(['py', 'ts', 'js'])}", " ".join(["common", *draw.choices(words, k=4)]))
        for i in range(600)
    ]
    corpus_rows = spark.createDataFrame(rows, "project string, path string, content string").repartition(3)
    wanted = asked(spark, "alpha", "beta", "common", "alpha gamma", "nothing")
    every = code.top_hits(code.search_code(corpus_rows, wanted))
    best = code.top_files(corpus_rows, wanted)
    key = ["skill", "project", "path", "kind", "ext_rank", "rank"]
    assert sorted(best.select(*key).collect()) == sorted(every.select(*key).collect())
    first = code.first_files_of_words(corpus_rows, wanted, 3)
    assert first.count() == 3 * len(words)
    assert {r["skill"] for r in code.skills_found(corpus_rows, wanted).collect()} == {"alpha", "beta", "common", "alpha gamma"}
    # Words' files are cut before they're shuffled, and no table of skills and files is made.
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit \[word.* Partial", plan) and "xxhash64(project" not in plan


def test_words_without_a_term_are_not_ranked(spark):
    """The texts are cut into words once in what is left to run, and of their words those that no term is in are left out first."""
    rows = spark.createDataFrame([("p", f"src/f{i}.py", f"needle{i} hay{i}\nstraw") for i in range(50)], "project string, path string, content string")
    wanted = asked(spark, "needle", "hay7")
    best = code.top_files(rows, wanted)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(content") == 1 and "scalar-subquery" in plan
    got = sorted((r["skill"], r["path"], r["rank"]) for r in best.collect())
    assert got == [("hay7", "src/f7.py", 1), ("needle", "src/f0.py", 1), ("needle", "src/f1.py", 2), ("needle", "src/f10.py", 3)]


def test_texts_stay_where_they_are_read(spark, sf_dir):
    """The first documents of the sources are few, so the texts are not shuffled to meet them."""
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "20KB"}):
        plan = tables.code_files(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_skills_of_the_first_files_are_not_looked_for_in_all_files(spark, monkeypatch):
    monkeypatch.setattr(code, "_FIRST_FILES", 40, raising=False)
    rows = [(f"p{i % 3}" if i % 50 else None, f"f{i:03}.py" if i % 41 else None, f"common x{i} y{i % 90}") for i in range(300)]
    rows += rows[60:120]  # files listed twice
    files = spark.createDataFrame(rows, "project string, path string, content string")
    asked = spark.createDataFrame([("common",), ("x299",), ("y77",), ("absent",), ("x2",), (None,), ("common",)], "skill string")
    seen, found = [], code.skill_words

    def skill_words(vocabulary, skills, whole_word):
        seen.append({r["skill"] for r in skills.collect()})
        return found(vocabulary, skills, whole_word)

    monkeypatch.setattr(code, "skill_words", skill_words)
    got = sorted(code.top_files(files, asked).collect(), key=str)
    assert "common" not in seen[-1] and {"x299", "y77", "absent"} <= seen[-1]
    assert got == sorted(code._top_files(files, asked, 3, False).collect(), key=str)
    assert sorted(r["rank"] for r in got if r["skill"] == "common") == [1, 2, 3]


def test_words_that_outgrow_a_broadcast_stay_where_they_are(spark):
    """Every file brings words of its own that hold the term, so the words with terms are more than Spark broadcasts."""
    files = spark.range(4000).selectExpr("'p' AS project", "concat('f', id, '.py') AS path", "concat('first\\n', sha2(string(id), 256), 'needle', id) AS content")
    wanted = asked(spark, "Needle", "needle", "first needle", "absent")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "64KB"}):
        hits = code.first_hit_per_file(files, wanted)
        rows = hits.collect()
        plan = hits._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert "hashpartitioning(word" not in plan and "hashpartitioning(gram" not in plan
    lines = {"Needle": 2, "needle": 2, "first needle": 1}
    assert len(rows) == 12_000 and all(r["line_no"] == lines[r["skill"]] for r in rows)


def test_terms_meet_words_alike_whether_they_are_broadcast_or_not(spark):
    random.seed(17)
    parts = ["ab", "\U0001f600", "é", "ß", "İ", "\u0307", "c.", "#", "the", "aaa", "\t", " ", "\u3000", "\n"]
    text = lambda most: "".join(random.choices(parts, k=random.randint(0, most)))
    rows = [(f"p{i % 3}", f"f{i}.py", text(60)) for i in range(150)] + [(None, None, "the aaa"), ("p", "n.py", None), ("p0", "f0.py", "aaa")]
    files = spark.createDataFrame(rows, corpus.CORPUS)
    wanted = spark.createDataFrame([(text(5),) for _ in range(150)] + [(None,), ("the",), ("the",), ("aaaa the",)], "skill string")
    found = {}
    for most in ("10MB", "-1"):
        with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": most}):
            found[most] = sorted(map(tuple, code.search_code(files, wanted).collect()), key=str)
    assert found["10MB"] == found["-1"] and len(found["-1"]) > 500
