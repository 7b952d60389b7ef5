"""Every query of the engine's own against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from polymere import queries

from .oracle import connection, differs

SAMPLE = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connection(SAMPLE)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_those_of_sql(spark, duck, name):
    assert differs(QUERIES[name](spark, SAMPLE), SQL[name], duck) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_give_rows(spark, name):
    assert QUERIES[name](spark, SAMPLE).columns


def test_entry_works(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
