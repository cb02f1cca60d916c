"""Each registered query against its DuckDB oracle SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
import tools.oracle_check as OC
from tools.oracle_check import TABLES, digest

OC.EXACT = True   # doubles compared bit for bit

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    srows = [tuple(r) for r in df.collect()]
    drows = rel.fetchall()
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(rel.columns, drows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["target", "messages", "bytes"]
    assert df.count() == 5
