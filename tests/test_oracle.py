"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import os

import oracle
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PLANS, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    names, got = oracle.spark_rows(PLANS[name](spark, SF))
    want_names, want = oracle.duck_rows(SF, SQL[name])
    assert names == want_names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_runs(spark, name):
    assert PLANS[name](spark, SF).count() >= 0
