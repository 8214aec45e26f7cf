"""Benchmark: run the headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with a ``noop`` sink (every row computed, no
output written) and timed wall-clock.  Prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_class_profile",
    "w1_merge",
    "d1_dedup_wide",
    "d2_dedup_narrow",
    "w2_process_and_merge",
    "w3_tree_samples",
    "w4_thread_samples",
    "c15_transform_v1",
    "c17_transform_with_tools",
    "w7_training_rows",
    "w8_benchmark_scoring",
    "w5_reasoning_v1",
    "w6_reasoning_v2",
    "w9_problem_conversion",
    "p12_problem_difficulty",
    "w10_repo_snippets",
    "a2_prefix_breakdown",
    "c22_extract_code",
    "g1_template_grid",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from samplesmith.catalog import QUERIES
    from samplesmith.session import get_spark

    extra = {"spark.driver.memory": "16g"}
    if os.environ.get("BENCH_EVENT_LOG_DIR"):  # stage/task times for later reading, no UI
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG_DIR"]})
    spark = get_spark("samplesmith-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, extra=extra)
    # Warm-up (JVM, codegen caches): not timed.
    QUERIES["c1_classify_problem"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    reps = int(os.environ.get("BENCH_REPS", "3"))
    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in names:
        runs = []
        spark.sparkContext.setJobDescription(name)  # tags the event log (tools/shuffle_report.py)
        for _ in range(reps):
            t0 = time.perf_counter()  # building the plan counts: eager work would show
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        cold[name] = round(runs[0], 3)          # includes plan code generation and compilation
        times[name] = round(min(runs), 3)       # steady state
        print(f"{name}: cold {cold[name]}s, best {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_jobs_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "mode": f"best_of_{reps}", "cold_total": round(sum(cold.values()), 3),
           "cold_queries": cold, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus),
           "spark": spark.version}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
