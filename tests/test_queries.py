from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

from evalfold.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name not in ORACLES:
        assert got.num_rows
        return
    want = duck.sql(ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    columns = sorted(got.column_names)
    rows = lambda t: sorted(repr([None if r[c] is None else float(r[c]) if isinstance(r[c], float) else r[c] for c in columns]) for r in t.to_pylist())
    assert rows(got) == rows(want)


def test_entry_works_without_the_llm_folders():
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("evalfold.llm"):
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert "task_mean" in e.queries() and not any(n.startswith("op1") or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_nothing_outside_imports_the_llm_folders():
    for top, _, files in os.walk(f"{ROOT}/evalfold"):
        if "/llm" not in top:
            for f in files:
                if f.endswith(".py"):
                    assert "evalfold.llm" not in open(f"{top}/{f}").read(), f
