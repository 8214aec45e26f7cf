"""Summarise the physical plan of every registered query (for PLANS.md).

For each query: shuffles (hash / range / single-partition), broadcasts,
joins, partial vs final per-group limits and aggregates, global top-k, and
the columns each parquet scan reads.  Usage:
    python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarize(plan: str) -> dict:
    c = Counter()
    joins = []
    reads = []
    for line in plan.split("\n"):
        s = line.strip(" :+-")
        if s.startswith("Exchange hashpartitioning"):
            c["hash"] += 1
        elif s.startswith("Exchange rangepartitioning"):
            c["range"] += 1
        elif s.startswith("Exchange SinglePartition"):
            c["single"] += 1
        elif s.startswith("BroadcastExchange"):
            c["broadcast"] += 1
        m = re.match(r"(\w*Join) .*?(Inner|LeftOuter|LeftSemi|LeftAnti|RightOuter|FullOuter|Cross)", s)
        if m:
            joins.append(f"{m.group(1)}:{m.group(2)}")
        if s.startswith("WindowGroupLimit") and s.rstrip().endswith("Partial"):
            c["wgl_partial"] += 1
        if s.startswith("HashAggregate") and "partial_" in s:
            c["agg_partial"] += 1
        if s.startswith("TakeOrderedAndProject"):
            c["topk"] += 1
        if s.startswith("FileScan parquet"):
            m2 = re.search(r"FileScan parquet \[([^\]]*)\]", s)
            loc = re.search(r"\[file:[^\]]*/([a-z_]+)\.parquet\]", s)
            reads.append(f"{loc.group(1) if loc else '?'}({re.sub(r'#[0-9]+L?', '', m2.group(1)) if m2 else ''})")
    return {"counts": c, "joins": joins, "reads": sorted(set(reads))}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from samplesmith.catalog import QUERIES
    from samplesmith.session import get_spark
    spark = get_spark("plans", master="local[8]", shuffle_partitions=16)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` at `{sf}` (local[8], AQE on; initial plans before AQE re-planning).")
    print("Columns: shuffles (hash/range/single), hash shuffles with broadcasts off (`hash large`, what inputs above the")
    print("threshold get), broadcasts, joins, partial per-group limits (`wgl`), partial aggregates, global top-k, and the")
    print("columns read per parquet scan.  Queries that go through files show their last step, the read.\n")
    print("| query | hash | hash large | range | single | bcast | joins | wgl partial | agg partial | top-k | scans (columns read) |")
    print("|---|---|---|---|---|---|---|---|---|---|---|")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def plan_of(fn, limit: str) -> dict:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        return summarize(fn(spark, sf)._jdf.queryExecution().executedPlan().toString())

    for name, fn in QUERIES.items():
        r, large = plan_of(fn, threshold), plan_of(fn, "-1")
        c = r["counts"]
        print(f"| {name} | {c['hash']} | {large['counts']['hash']} | {c['range']} | {c['single']} | {c['broadcast']} | "
              f"{', '.join(r['joins']) or '-'} | {c['wgl_partial']} | {c['agg_partial']} | {c['topk']} | "
              f"{'; '.join(r['reads'])} |")


if __name__ == "__main__":
    main()
