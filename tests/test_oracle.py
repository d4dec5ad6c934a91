"""Every registered query with a SQL twin agrees with it; the others return rows."""

import os

import pytest
from oracle import compare

import __spark_entry__ as entry

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in SQL:
        problem = compare(df, FOLDER, SQL[name])
        assert problem is None, problem
    else:
        assert df.limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert set(SQL) <= set(entry.queries())
