"""Driver contract and the oracle gate at sf0.001: every registered query
runs, and every key with an oracle matches DuckDB on the same parquet."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["category", "category_revenue"]
    assert df.count() > 0


def test_contract_shapes():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_against_oracle(spark, con, name):
    info = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF)
    assert info["ok"] is not False, info
