"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from conftest import SMALL
from oracle import compare, duck

QUERIES = entry_module.queries()
SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    verdict = compare(spark, con, SMALL, name, QUERIES[name], SQL.get(name))
    assert verdict.startswith(("ok", "rows")) and "types" not in verdict, verdict


def test_entry_returns_sorted_ids(spark):
    ids = [r.uid for r in entry_module.entry(spark).collect()]
    assert ids and ids == sorted(ids)
