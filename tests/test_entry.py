"""Queries over the smallest tables run, and agree with their SQL in number of rows."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_a_query_each():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["section_starts", "dissents", "signatures", "class_report", "sliding_chunks", "split", "time_analysis"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    result = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert mine == sorted(str(tuple(r)) for r in result)
