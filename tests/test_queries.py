"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    outcome = compare(name, spark, con, FOLDER, QUERIES, ORACLES)
    assert "FAIL" not in outcome, outcome


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("table, key", [("orders", "o_orderkey"), ("part", "p_partkey"), ("customer", "c_custkey"), ("documents", "doc_id"), ("events", "event_id")])
def test_order_keys_are_unique(spark, table, key):
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key)
    assert rows.count() == rows.distinct().count()
