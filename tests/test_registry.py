"""Every registered query with SQL gives DuckDB's rows; the others run and have brute-force tests of their own."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{data}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, con, data, name):
    ours = registry.QUERIES[name](spark, data)
    theirs = con.sql(registry.ORACLE[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    kinds = dict(zip(theirs.columns, map(str, theirs.types), strict=True))
    assert {c: TYPES[t] for c, t in ours.dtypes} == kinds
    order = sorted(ours.columns)
    at = [theirs.columns.index(c) for c in order]
    assert sorted(repr(tuple(r[c] for c in order)) for r in ours.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_does_not_import_the_text_operators():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "lectern")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as file:
                        assert "lectern.llm" not in file.read(), name
