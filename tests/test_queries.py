"""Every registered query against its SQL in another engine, on the small driver tables."""

import os

import duckdb
import pytest

from tasklathe.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}{'/*.parquet' if os.path.isdir(f'{SF}/{file}') else ''}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(map(plain, r)) for r in frame.select(*columns).collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    result = engine.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(row[i]) for i in order) for row in result.fetchall()), key=repr)
    assert got == want


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_corpus_operators():
    import pathlib

    root = pathlib.Path(catalogue.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            text = path.read_text()
            assert "llm" not in text, path
