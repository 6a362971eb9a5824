"""Every query with SQL against that SQL, value by value, over the smallest tables."""

import ast
from pathlib import Path

import duckdb
import pytest

from termlode.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def rows(found, names):
    def plain(x):
        return round(x, 6) + 0.0 if isinstance(x, float) else x

    return sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found), key=repr)


@pytest.fixture(scope="module")
def tables(small):
    with duckdb.connect() as db:
        for f in Path(small).glob("*.parquet"):
            db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        yield db


@pytest.mark.parametrize("name", SQL)
def test_same_rows(spark, small, tables, name):
    df = QUERIES[name](spark, small)
    got = tables.execute(SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(got.fetchall(), names)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_nothing_outside_llm_imports_it():
    for path in (Path(__file__).resolve().parents[1] / "termlode").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text(encoding="utf-8"))):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), path
