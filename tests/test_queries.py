"""Registered queries against their SQL twins at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry_points
from check_queries import compare, connect

SF = "/root/testdata/sf0.001"
LLM = ("op", "pipeline")  # held against brute force in tests/llm

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def wanted():
    return [n for n in entry_points.queries() if not n.startswith(LLM)]


@pytest.mark.parametrize("name", wanted())
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = entry_points.oracle_sql().get(name)
    if sql is not None:
        result = duck.sql(sql)
        assert compare(df.columns, rows, result.columns, result.fetchall()) is None


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["label", "rows", "percent"] and df.count() == 4


def test_every_twin_has_its_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
