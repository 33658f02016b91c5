"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import check, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert check(spark, con, SF, QUERIES[name], ORACLE.get(name)) == []


def test_entry_has_one_row_per_table(spark):
    assert entry.entry(spark).count() == 9
