"""Plan regression tests: the physical properties the scale design relies on."""

import re

import pytest

from samplesmith.catalog import QUERIES
from tests.conftest import SF


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["w3_tree_samples", "c15_transform_v1", "c17_transform_with_tools", "c22_extract_code",
                                  "g1_template_grid", "p1_p4_routed_normalize", "p29_line_provenance_chunks"])
def test_narrow_jobs_do_not_shuffle(spark, name):
    # (the v_samples adapter's own join may broadcast; no shuffle exchange is allowed)
    assert not re.search(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan(spark, name))


@pytest.mark.parametrize("name", ["d1_dedup_wide", "d2_dedup_narrow", "l4_files_per_repo", "j2_l5_thread_comments",
                                  "w10_repo_snippets"])
def test_keep_first_and_heads_limit_before_every_exchange(spark, name):
    lines = [l.strip(" :+-") for l in plan(spark, name).split("\n")]
    exchanges = [i for i, l in enumerate(lines) if l.startswith("Exchange hashpartitioning")]
    # keep-first moves whole rows once; heads in two stages (map-task salt, then key)
    assert len(exchanges) == 1 if name.startswith("d") else len(exchanges) >= 2
    for i in exchanges:
        assert lines[i + 1].startswith("WindowGroupLimit") and lines[i + 1].endswith("Partial")


def test_no_single_partition_window(spark):
    for name in QUERIES:
        if name.startswith(("s1", "s2", "s3", "s4", "s5", "s6", "s9", "o1", "o2b", "w1b", "w2b", "w5", "w6", "w9")):  # these write files or count first
            continue
        p = plan(spark, name)
        assert not re.search(r"Window \[.*\], \[\], \[", p), name


def test_aggregates_are_partial_first(spark):
    for name in ("a1_rows_per_dataset", "a3_l7_per_problem", "j3_a7_base_vs_tuned", "a6_summary_table"):
        assert "partial_" in plan(spark, name), name


def test_tests_join_after_aggregation(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for inputs too large to broadcast
    try:
        assert plan(spark, "w8_benchmark_scoring").count("Exchange hashpartitioning") <= 4
        assert plan(spark, "a3_l7_per_problem").count("Exchange hashpartitioning") <= 2
        assert "Join" not in plan(spark, "o2b_exact_split").replace("SortMergeJoin [conv_id", "")  # the adapter's own join
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_tree_scan_pushes_the_byte_bound(spark, tmp_path):
    from samplesmith.sources import trees as TR
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.py").write_text("x = 1\n")
    df = TR.scan_tree(spark, str(tmp_path), exts=[".py"], max_bytes=30000)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(length,30000\)", p)
