"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    note, ok = compare(spark, duck, SF, QUERIES[name], SQL[name])
    assert ok, f"{name}: {note}"


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
