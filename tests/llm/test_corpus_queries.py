"""The registered corpus queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from tools import check_oracles
from winnow.llm import queries
from winnow.llm.common import stored


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_its_sql(spark, sf_dir, name, monkeypatch):
    monkeypatch.setitem(check_oracles.QUERIES, name, queries.QUERIES[name])
    monkeypatch.setitem(check_oracles.ORACLES, name, queries.ORACLES[name])
    assert check_oracles.compare(spark, check_oracles.connect(sf_dir), sf_dir, name) == ""


def test_all_are_registered():
    names = driver.queries()
    assert sum(n.startswith("op") and n[2].isdigit() for n in names) == 13 and "pipeline" in names


CONTRACTS = {
    "op3_mixing": "doc_id size source_size target taken",
    "op4_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op5_order_minhash": "doc_id class_id",
    "op6_licenses": "doc_id",
    "op8_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_quality_classifier": "doc_id held_out score predicted",
    "op12_disclosure": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_queries_give_a_row_per_document(spark, sf_dir, name):
    """Over the whole table, with the agreed columns."""
    found = stored(queries.QUERIES[name](spark, sf_dir), "contract-test")
    assert set(CONTRACTS[name].split()) <= set(found.columns)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    assert sorted(r[0] for r in found.select("doc_id").collect()) == sorted(r[0] for r in docs.collect())


def test_packing_query_holds_every_piece(spark, sf_dir):
    found = stored(queries.QUERIES["op2_packing"](spark, sf_dir), "contract-test")
    assert found.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found.filter("piece = 0").count() == docs.count() and found.agg(F.max("length")).first()[0] <= 4096


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), "pipeline-test")
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name in ("quality classifier", "quality rules"):
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
            clean = before.join(labels, "doc_id").filter(F.size(F.split("text", " ")) > 60)
            assert docs.join(clean, "doc_id", "left_semi").count() >= 0.98 * clean.count()
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3]
    assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    places = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert places.filter("n != end or n > 4096").count() == 0
