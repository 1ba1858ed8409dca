"""Every registered query against its DuckDB oracle on the smallest tables."""
from __future__ import annotations

import pytest

import __spark_entry__ as entry
from pricesieve.plans import registry
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLE = entry.oracle_sql()
#: Checked by cases in other tests; DuckDB cannot name the folder or gives no plain text.
NO_SQL = {"binary_catalogue", "pair_scores"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) - set(registry.ORACLE) == NO_SQL


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    r = compare(spark, con, SF, key, QUERIES[key], ORACLE.get(key))
    assert r.get("ok") is not False, r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["category", "n"]
    assert df.count() > 0
