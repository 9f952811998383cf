"""Queries of corpus operators that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from lodestone.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_duckdb(spark, name):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    want = c.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
