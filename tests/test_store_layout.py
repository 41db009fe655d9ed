"""Buckets: few rows touch few files, whatever lies beside them and whoever dies half-way."""

from __future__ import annotations

import datetime as dt
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow import schemas
from winnow.operators import profiles, vectors
from winnow.session import use_checkpoint_dir
from winnow.sources import buckets, profiles as store
from winnow.streaming import screening as streaming


def files_below(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def entries(spark, ids, text="x"):
    return spark.createDataFrame([(i, 0, "c", f"{text}{i}") for i in ids], schemas.STORED["misc"])


def test_a_load_rewrites_the_buckets_of_its_candidates(spark, tmp_path):
    root = str(tmp_path)
    store.append_profile(entries(spark, range(400)), root, "misc", buckets=16)
    before = files_below(tmp_path)
    store.overwrite_profile(entries(spark, [7], "new"), root, "misc", buckets=16)
    after = files_below(tmp_path)
    gone = {os.path.dirname(f) for f in before.keys() - after.keys()}
    assert len(gone) == 1 and len({os.path.dirname(f) for f in before}) == 16
    held = {r["candidate_id"]: r["content"] for r in store.read_profile(spark, root, "misc").collect()}
    assert held == {i: f"x{i}" if i != 7 else "new7" for i in range(400)}


def test_a_batch_left_without_rows_goes(spark, tmp_path):
    root = str(tmp_path)
    store.append_profile(entries(spark, [1]), root, "misc", batch="form-0")
    store.append_profile(entries(spark, [1, 2]), root, "misc", batch="form-1")
    store.append_profile(entries(spark, [1, 2]), root, "misc", batch="form-1")
    assert sorted(tuple(r)[:2] for r in store.read_profile(spark, root, "misc").collect()) == [(1, 0), (1, 1), (2, 0)]
    store.overwrite_profile(entries(spark, [1], "new"), root, "misc")
    got = sorted((r["candidate_id"], r["seq"], r["content"]) for r in store.read_profile(spark, root, "misc").collect())
    assert got == [(1, 0, "new1"), (2, 0, "x2")]
    assert not [f for f in files_below(tmp_path) if "form-0" in f]


def test_a_load_that_dies_leaves_the_store_readable(spark, tmp_path):
    root = str(tmp_path)
    store.append_profile(entries(spark, range(50)), root, "misc", buckets=4)
    broken = entries(spark, range(10)).withColumn("content", F.when(F.col("candidate_id") == 9, F.raise_error(F.lit("lost"))).otherwise("y"))
    with pytest.raises(Exception, match="lost"):
        store.overwrite_profile(broken, root, "misc", buckets=4)
    held = {r["candidate_id"]: r["content"] for r in store.read_profile(spark, root, "misc").collect()}
    assert held == {i: f"x{i}" for i in range(50)}


def test_rare_and_null_candidates(spark, tmp_path):
    root = str(tmp_path)
    odd = spark.createDataFrame([(None, 0, "c", "n"), (5, 0, None, None)], schemas.STORED["misc"])
    store.append_profile(odd, root, "misc")
    store.overwrite_profile(entries(spark, [5]), root, "misc")
    assert sorted((tuple(r) for r in store.read_profile(spark, root, "misc").collect()), key=str) == [(5, 0, "c", "x5"), (None, 0, "c", "n")]
    store.overwrite_profile(entries(spark, []), root, "misc")
    assert store.read_profile(spark, root, "misc").count() == 2


def test_a_batch_reads_only_its_own_ranges_of_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "IDS_TOGETHER", 10)
    resumes = spark.createDataFrame([(1, 9.0, ["a"])], "resume_id bigint, candidate_experience double, candidate_skills array<string>")
    jds = spark.createDataFrame([(1, None, ["a"])], "jd_id bigint, experience_required double, required_skills array<string>")
    listed = []
    read = buckets.read_buckets

    def watched(spark, path, schema, column, values):
        found = read(spark, path, schema, column, values)
        listed.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(streaming, "read_buckets", watched)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    at = dt.datetime(2025, 1, 1)
    for start in [*range(0, 80, 10), 20]:
        rows = [(i, 1, 1, at) for i in range(start, start + 10)]
        spark.createDataFrame(rows, streaming.APPLICATION).coalesce(1).write.mode("append").parquet(source)
        arriving = streaming.read_applications(spark, source)
        streaming.screen_arrivals(arriving, resumes, jds, out, state, ["application_id", "route"]).awaitTermination()
    assert listed[:8] == [0] * 8 and 0 < listed[8] <= 2  # new ranges read nothing, the repeated one only its own
    got = [r["application_id"] for r in spark.read.parquet(out).collect()]
    assert sorted(got) == list(range(80))


def test_upsert_reads_and_replaces_few_buckets(spark, tmp_path):
    path, kind = str(tmp_path / "v"), "doc_id bigint, embedding array<float>, metadata string, version bigint"
    rng = np.random.default_rng(0)
    first = [(i, rng.normal(size=3).tolist(), "old", 1) for i in range(3000)]
    assert vectors.read_store(spark, path, kind).count() == 0
    vectors.upsert_into_store(spark.createDataFrame(first, kind), path, 3, buckets=64)
    before = files_below(path)
    new = [(5, [1.0, 2.0, 3.0], "new", 2), (6, [1.0, 2.0, 3.0], "stale", 0), (9000, [0.0, 0.0, 1.0], "added", 1)]
    vectors.upsert_into_store(spark.createDataFrame(new, kind), path, 3, buckets=64)
    assert len(before.keys() - files_below(path).keys()) <= 3 * len(before) / 64 + 3
    held = {r["doc_id"]: r["metadata"] for r in vectors.read_store(spark, path, kind).collect()}
    assert held == {**{i: "old" for i in range(3000)}, 5: "new", 9000: "added"}
    with pytest.raises(Exception, match="wrong vector dimension"):
        vectors.upsert_into_store(spark.createDataFrame([(1, [1.0], "x", 9)], kind), path, 3, buckets=64)
    assert vectors.read_store(spark, path, kind).count() == 3001


def test_lists_of_texts_travel_as_one_text_and_come_back(spark):
    lists = [["a", "b c", ""], [], [""], None, ["a", None], [None], ["x\x01y", "z"], ["\x01"], ["é\n", " "]]
    rows = spark.createDataFrame([(i, i % 3, v, [1]) for i, v in enumerate(lists)], "id int, bucket int, texts array<string>, n array<int>")
    laid_out = buckets.even(rows, "bucket")
    assert laid_out.schema.simpleString() == rows.schema.simpleString()
    assert {r["id"]: r["texts"] for r in laid_out.collect()} == dict(enumerate(lists))
    many = spark.range(20_000).select("id", F.lit(0).alias("bucket"), F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.concat(F.lit("w"), i)).alias("texts"))
    plan = buckets.even(many, "bucket")._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan and "_one_texts" in plan.split("RebalancePartitions")[1]


def shuffled_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {os.path.join(d, f) for top in folders for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def test_a_load_leaves_no_copy_of_its_entries_behind(spark, tmp_path):
    kept = use_checkpoint_dir(spark).removeprefix("file:")
    copies = lambda: sum(name.startswith("rdd-") for _, names, _ in os.walk(kept) for name in names)
    lines = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("line "), i))
    parsed = spark.range(500).select(
        F.col("id").alias("candidate_id"),
        F.array(F.lit("r")).alias("roles"),
        F.transform(lines, lambda x: F.struct(x.alias("category"), F.array(x).alias("skills"))).alias("categorized_skills"),
        F.transform(lines, lambda x: F.struct(x.alias("project_name"), F.array(x).alias("tech_stack"), x.alias("description"))).alias("projects"),
        F.transform(lines, lambda x: F.struct(x.alias("role_title"), F.array(x).alias("responsibilities"))).alias("responsibilities"),
        F.array(F.struct(F.lit("m").alias("category"), F.lit("x").alias("content"))).alias("misc"),
    )
    before, held = copies(), shuffled_files(spark)
    profiles.populate_profile(parsed, str(tmp_path))
    assert copies() == before
    large = lambda: [f for f in shuffled_files(spark) - held if f.endswith(".data") and os.path.exists(f) and os.path.getsize(f) > 5_000]
    until = time.monotonic() + 20
    while large() and time.monotonic() < until:
        time.sleep(0.2)
    assert not large()
    profiles.populate_profile(parsed.filter("candidate_id < 9"), str(tmp_path))
    counts = {t: store.read_profile(spark, str(tmp_path), t).count() for t in profiles.FAN_OUT_TABLES}
    assert counts == {"skills": 10_000, "projects": 10_180, "responsibilities": 10_180, "misc": 509}


def test_more_candidates_than_are_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "_BROADCAST_ROWS", 0)
    root = str(tmp_path)
    for _ in range(2):
        store.append_profile(entries(spark, [1, 2, None]), root, "misc", buckets=4)
    store.overwrite_profile(entries(spark, [2], "new"), root, "misc", buckets=4)
    got = sorted(map(tuple, store.read_profile(spark, root, "misc").collect()), key=str)
    assert got == sorted([(1, 0, "c", "x1"), (1, 1, "c", "x1"), (2, 0, "c", "new2"), (None, 0, "c", "xNone"), (None, 0, "c", "xNone")], key=str)
