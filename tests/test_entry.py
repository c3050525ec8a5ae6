"""The driver's contract."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from lodestrata import queries

ROOT = Path(__file__).parents[1]
SMALL = Path("/root/testdata/sf0.001")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.QUERIES) <= set(entry.queries())


def test_entry_without_the_text_operators():
    code = "import sys; sys.modules['lodestrata.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert set(e.queries()) == set(e._own.QUERIES); assert set(e.oracle_sql()) == set(e._own.ORACLE_SQL)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


@pytest.mark.skipif(not SMALL.exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["column_bounds", "merge_runs", "eps_join_nd", "cluster_redundancy"])
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = entry.queries()[name](spark, str(SMALL))
    want = con.execute(entry.oracle_sql()[name]).df().to_dict("records")
    names = sorted(got.columns)
    rows = lambda t: sorted(tuple(r[c] for c in names) for r in t)
    assert rows(r.asDict() for r in got.collect()) == rows(want)


@pytest.mark.skipif(not SMALL.exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["normalize_minmax_all", "merge_runs_all", "level2_regions_all", "cluster_sizes_all"])
def test_queries_over_all_columns_equal_sql(spark, name):
    test_queries_equal_sql(spark, name)
    if "dim" in (got := entry.queries()[name](spark, str(SMALL))).columns:
        assert {r["dim"] for r in got.select("dim").distinct().collect()} == set(range(64))
