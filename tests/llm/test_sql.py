"""Registered queries against their SQL on the smallest tables."""
import os

import duckdb
import pytest

from chronoscribe.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW \"{f.removesuffix('.parquet')}\" AS SELECT * FROM '{FOLDER}/{f}'")
    got = QUERIES[name](spark, FOLDER)
    result = con.execute(SQL[name])
    names = [c[0] for c in result.description]
    order = sorted(names)
    rows = lambda columns, data: sorted(tuple(repr(r[columns.index(c)]) for c in order) for r in data)
    assert sorted(got.columns) == order
    assert rows(got.columns, got.collect()) == rows(names, result.fetchall())
