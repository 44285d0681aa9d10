"""Every registered query with SQL gives the same rows in both engines."""

import math

import duckdb
import pytest

from plumbline.queries import FLAGSHIP, oracle_sql, queries

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _cell(v):
    return repr("nan" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(_cell(r[c]) for c in columns) for r in df.collect())
    found = db.execute(oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(_cell(r[i]) for i in at) for r in found.fetchall())


def test_the_flagship_has_every_segment(spark):
    assert FLAGSHIP(spark, SF).count() == 10


def test_the_entry_module_stands_without_the_corpus_operators(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(queries()) and set(entry.oracle_sql()) == set(oracle_sql())
    sys.modules.pop("__spark_entry__")


def test_nothing_else_imports_the_corpus_operators():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "plumbline"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
