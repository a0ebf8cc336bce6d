"""Every registered query of the engine against its SQL in DuckDB, and as a smoke test where there is none."""

import glob
import os

import duckdb
import pytest

from quillstream.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def shown(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    found = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    places = [found.columns.index(c) for c in columns]
    mine = sorted(tuple(shown(r[c]) for c in columns) for r in rows)
    theirs = sorted(tuple(shown(r[i]) for i in places) for r in found.fetchall())
    assert mine == theirs


def test_entry_runs_without_the_optional_package(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 1
    monkeypatch.setattr(entry, "llm_queries", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
