"""The driver's contract, and every registered query against its SQL."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tremolo.plans import registry

registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    made = duckdb.connect()
    for name in TABLES:
        made.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return made


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(found, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf)
    want = con.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    table = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert rows(got.collect(), columns) == rows(table, columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(registry.QUERIES) <= set(queries)
    found = entry.entry(spark)
    assert found.columns == ["pair", "n_used", "rank_biserial", "z", "large"] and found.count() == 2


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, pipeline):
    """In a copy without their folders, with corpus_pipeline.py and without it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    code = "import __spark_entry__ as e; from tremolo.plans import registry; print(set(e.queries()) == set(registry.QUERIES) and e.oracle_sql() == registry.ORACLES and len(registry.QUERIES) > 100)"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.strip() == "True", out.stderr


def test_nothing_else_imports_the_training_data_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "tremolo")):
        if os.sep + "llm" not in folder:
            for name in names:
                if name.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, name)).read()
