"""Every registered query against its check SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from compare import compare, connect

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    # Below the least volume the guarded window is rightly empty.
    assert problem is None or (name == "guarded_window" and problem == "no rows")


def test_every_check_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    languages = spark.read.parquet(f"{contract.SMALL}/documents.parquet").where("not lang <=> 'en'").select("lang").distinct()
    assert contract.entry(spark).count() == languages.count() > 1
