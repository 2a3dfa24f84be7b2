"""Every registered query next to its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as driver
from lectern.workloads import all_queries, all_sql
from lectern.workloads.check import TABLES, compare

QUERIES, SQL = all_queries(), all_sql()
# whole-table flows without an SQL form; their parts are tested against plain loops
ROWS_ONLY = {"diagnosis", "bias_calibration", "fit_and_score", "view_scores"}


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def test_registry():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert not set(SQL) - set(QUERIES)
    assert set(driver.queries()) >= set(QUERIES) and set(driver.oracle_sql()) >= set(SQL)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toArrow()
    if name in SQL:
        assert compare(got, duck.execute(SQL[name]).to_arrow_table()) is None
    else:
        assert got.num_rows > 0
