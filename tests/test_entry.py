import importlib
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from folioscope.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the bench tables are not here")


def shown(v):
    return "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.sql(queries.SQL[name])
    found = queries.QUERIES[name](spark, DATA)
    assert sorted(found.columns) == sorted(want.columns)
    order = sorted(found.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(tuple(shown(r[c]) for c in order) for r in found.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


@needs_data
def test_queries_without_sql_give_rows(spark):
    for name in sorted(set(queries.QUERIES) - set(queries.SQL)):
        assert queries.QUERIES[name](spark, DATA).count() > 0


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_works_without_the_training_data_operators(tmp_path):
    """With the subpackage and the pipeline gone, the rest imports and keeps its queries."""
    root = Path(entry.__file__).resolve().parent
    for p in root.iterdir():
        if p.name not in ("corpus_pipeline.py", "folioscope", ".git", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "folioscope").mkdir()
    for p in (root / "folioscope").iterdir():
        if p.name != "llm":
            (tmp_path / "folioscope" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True).stdout
    assert said.split()[-2:] == [str(len(queries.QUERIES)), str(len(queries.SQL))]


def test_nothing_else_imports_them():
    root = Path(queries.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "folioscope.llm" not in p.read_text(encoding="utf-8"), p
    importlib.reload(entry)
