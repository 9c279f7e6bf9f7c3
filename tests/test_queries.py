"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest
from compare import connect, duck_rows, spark_rows

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    if name not in ORACLE:
        assert rows
        return
    want_columns, want = duck_rows(con, ORACLE[name])
    assert columns == want_columns
    assert rows == want


def test_every_check_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).count() == 10
