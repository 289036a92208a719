"""Every registered query against its SQL, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["documents", "embeddings", "conversations", "labels", "pages", "benchmark"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    kept = [tuple(repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(kept)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name not in entry.oracle_sql():
        assert rows
        return
    found = duck.execute(entry.oracle_sql()[name])
    expected = plain([c[0] for c in found.description], found.fetchall())
    assert plain(df.columns, rows) == expected


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert {"latent", "rank", "tokens"} <= set(df.columns)
    assert df.count() > 0


@pytest.mark.parametrize("name", [
    "token_rows", "token_frequency", "chunks", "lookup_activations", "token_activation_rms", "top_activations", "rebuilt_text",
])
def test_texts_go_to_python_once(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 1
