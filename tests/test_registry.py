"""Every registered query against its SQL twin on the smallest tables."""
import os
import re

import duckdb
import pytest

import __spark_entry__ as registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        name = f.removesuffix(".parquet")
        c.execute(f"CREATE VIEW \"{name}\" AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def canonical(columns, rows):
    """Rows with columns in name order, sorted, as text (numbers of one kind)."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in rows)


PIPELINE = re.compile(r"op\d+_|pipeline$")  # tested in tests/llm


@pytest.mark.parametrize("name", [n for n in registry.queries() if not PIPELINE.match(n) and n in registry.oracle_sql()])
def test_query(spark, con, name):
    got = registry.queries()[name](spark, FOLDER)
    result = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert canonical(got.columns, got.collect()) == canonical(names, result.fetchall())


def test_entry(spark):
    assert registry.entry(spark).count() > 0
