"""Every registered query runs on the smallest tables; a sample is checked
against its DuckDB oracle (the driver checks all of them at sf0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF

TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "problem_class" in df.columns


def test_every_query_has_an_oracle():
    from oracle.queries import ORACLE
    from samplesmith.catalog import QUERIES
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["w1_merge", "d1_dedup_wide", "c6_tool_call", "c22_extract_code", "w8_benchmark_scoring",
                                  "p26a_repo_snippets", "w4_thread_samples", "g1_template_grid", "a2_prefix_breakdown"])
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted(repr(tuple(r[i] for i in idx)) for r in res.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_all_queries_run(spark):
    from samplesmith.catalog import QUERIES
    for fn in QUERIES.values():
        fn(spark, SF).collect()
