"""What stays where it lies."""

from __future__ import annotations

import os
import struct
import subprocess
import sys
import uuid

from pyspark.sql import functions as F

from winnow.llm import collocations
from winnow.llm.tokens import TokenBytes
from winnow.operators import code_search as code
from winnow.session import use_checkpoint_dir
from winnow.sources import profiles as store


def final_plan(frame):
    rows = frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0], rows


def test_words_of_the_corpus_are_not_shuffled(spark):
    files = spark.range(200).selectExpr("'p' AS project", "concat('f', id, '.py') AS path", "concat('needle\\nx', id) AS content")
    asked = spark.createDataFrame([("needle",), ("x199",)], "skill string")
    plan, rows = final_plan(code.first_hit_per_file(files, asked))
    assert "hashpartitioning(word" not in plan and "hashpartitioning(file" not in plan
    assert len(rows) == 201 and {r["line_no"] for r in rows} == {1, 2}


def test_files_listed_twice_give_their_hits_twice(spark):
    rows = [("p", "a.py", "needle"), ("p", "a.py", "\nneedle"), ("p", None, "needle"), ("p", "b.py", "other")]
    files = spark.createDataFrame(rows, "project string, path string, content string")
    asked = spark.createDataFrame([("needle",)], "skill string")
    got = [(r["path"], r["line_no"]) for r in code.first_hit_per_file(files, asked).collect()]
    assert sorted(got, key=str) == [("a.py", 1), ("a.py", 1), (None, 1)]


def test_a_load_shuffles_its_own_entries_only(spark, monkeypatch):
    root = f"{use_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    entry = store.schemas.STORED["misc"]
    name = next(f.split()[0] for f in entry.split(", ") if f.split()[0] not in ("candidate_id", "seq"))

    def entries(ids):
        rows = ids.select(F.col("id").alias("candidate_id"), F.lit(0).cast("bigint").alias("seq"))
        empty = spark.createDataFrame([], entry)
        return empty.unionByName(rows, allowMissingColumns=True).select(*empty.columns)

    store.overwrite_profile(entries(spark.range(500)), root, "misc", buckets=4)
    plans, write = [], store.write_partitions
    monkeypatch.setattr(store, "write_partitions", lambda rows, *a, **k: (plans.append(final_plan(rows)[0]), write(rows, *a, **k)))
    store.overwrite_profile(entries(spark.range(10)), root, "misc", buckets=4)
    assert name and "BroadcastHashJoin" in plans[0] and plans[0].count("REBALANCE") <= 1
    assert "SortMergeJoin" not in plans[0]
    assert store.read_profile(spark, root, "misc").count() == 500


def test_room_is_made_for_words_but_those_just_met_stay():
    import public_tokenizers

    ids = TokenBytes(public_tokenizers.path("word_bpe_49k.json"), most=50)
    fresh = TokenBytes(public_tokenizers.path("word_bpe_49k.json"))
    for i in range(20):
        text = ("often seen " + " ".join(f"w{i}x{k}" for k in range(10))).encode()
        assert ids(text) == fresh(text)
        assert b"often" in ids.runs and len(ids.runs) <= 70
    assert len(fresh.runs) > 200


def test_words_are_held_as_columns_between_tasks():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [b"Often seen, often told!\x0bOne two", b"", b" \n ", b"\xff broken \xc3\xa9t\xc3\xa9", "une \u00a0 \u0130x ".encode() * 3]
    plain = TokenBytes(path)
    whole = [struct.pack(f"<{len(f)}I", *f) for f in (plain.tokenizer.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids for x in texts)]
    for _ in range(2):
        with TokenBytes.at_work(path) as own:
            assert list(own.many(texts)) == whole
            assert b"Often" in own.runs
        assert not own.runs and not own.older and not own.words
    with TokenBytes.at_work(path) as own:
        assert b"Often" in own.older and own.words["often"] and not own.packed


def test_the_classifier_remembers_no_words():
    from winnow.llm import quality_classifier

    at, values = quality_classifier.features(b"one two one")
    assert len(at) == len(values) and not hasattr(quality_classifier, "WordHashes")


def test_counts_of_a_task_are_handed_on_in_small_parts():
    import numpy as np

    keys = (np.arange(i * 100_000, (i + 1) * 100_000) for i in range(20))
    parts = list(collocations._together((k, np.ones(len(k), np.int64)) for k in keys))
    assert max(len(k) for k, _ in parts) <= 1_400_000 and sum(int(n.sum()) for _, n in parts) == 2_000_000


_IDLE = """
import re
import public_tokenizers
from winnow.llm.tokens import TokenBytes

def held():
    return int(re.search(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1])

path = public_tokenizers.path("word_bpe_49k.json")
with TokenBytes.at_work(path):
    pass
before = held()
with TokenBytes.at_work(path) as ids:
    for k in range(20):
        ids(b" ".join(b"w%dx" % (k * 10_000 + i) for i in range(10_000)))
    ids = None
    working = held()
print(before, working, held())
"""


def test_an_idle_worker_gives_back_what_its_task_has_freed():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", _IDLE], cwd=here, capture_output=True, text=True, check=True).stdout
    before, working, idle = map(int, said.split())
    assert working - before > 30_000
    assert idle - before < 0.45 * (working - before)
