"""Streams over tables of one file, of many files and of no rows."""

from __future__ import annotations

import os

import pytest

from tools.check_oracles import compare, connect
from winnow.plans import QUERIES, tables as src

COLUMNS = ["application_id", "resume_id", "jd_id", "n_required", "n_matched", "skill_match", "route"]


@pytest.mark.parametrize("name", ["stream_screen", "screen_arrivals"])
def test_streams_read_tables_of_many_files(spark, sf_dir, tmp_path, name):
    for table in os.listdir(sf_dir):
        os.symlink(f"{sf_dir}/{table}", tmp_path / table)
    os.unlink(tmp_path / "documents.parquet")
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
    assert got == sorted(map(tuple, QUERIES["screen_applications"](spark, sf_dir).select(*COLUMNS).collect()))
    assert compare(spark, connect(sf_dir), sf_dir, name) == ""


@pytest.mark.parametrize("name", ["stream_screen", "screen_arrivals"])
@pytest.mark.parametrize("files", [0, 1])
def test_streams_of_empty_tables_give_no_rows(spark, sf_dir, tmp_path, name, files):
    for table in os.listdir(sf_dir):
        os.symlink(f"{sf_dir}/{table}", tmp_path / table)
    os.unlink(tmp_path / "documents.parquet")
    if files:
        empty = spark.createDataFrame([], src.SCHEMAS["documents"])
        empty.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    else:
        os.mkdir(tmp_path / "documents.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    assert found.columns == COLUMNS and found.count() == 0
