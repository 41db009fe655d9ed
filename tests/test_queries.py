"""Every registered query against its SQL, and the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from tools.check_oracles import compare, connect
from winnow.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, connection, sf_dir, name):
    assert compare(spark, connection, sf_dir, name) == ""


def test_entry(spark, sf_dir):
    rows = driver.entry(spark)
    assert rows.count() == 200 and set(rows.columns) >= {"application_id", "skill_match", "route"}


def test_contract():
    assert driver.queries().keys() >= QUERIES.keys()
    assert set(driver.oracle_sql()) >= set(ORACLES) == set(QUERIES)
