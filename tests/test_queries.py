"""Every contact query against its SQL; training-text queries have tests of their own."""

import pytest

import __spark_entry__ as entry
from checks import oracle, queries
from checks.compare import differences

QUERIES, ORACLE = queries.queries(), oracle.oracle_sql()


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "row_index" and len(df.columns) == 11


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), duck, ORACLE[name]) is None
