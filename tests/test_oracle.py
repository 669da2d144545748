"""Every query that SQL can express, at the smallest scale, against DuckDB."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tools.compare import TABLES, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF).toArrow()
    want = duck.sql(contract.oracle_sql()[name]).to_arrow_table()
    assert rows(got) == rows(want)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
