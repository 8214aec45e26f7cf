"""Hot-key probe on the given tables: a third of all rows share one key.

Checks that keep-first (D1) and per-group heads (L4) stay exact and reports,
for the hot key, the most rows any first-stage task receives and the rows
the final task receives.  Usage:
    python tools/skew_probe.py [sf_dir] [map_partitions]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    maps = int(sys.argv[2]) if len(sys.argv) > 2 else 256
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from samplesmith import adapters as A
    from samplesmith.operators import dedup as D
    from samplesmith.operators import limits as L
    from samplesmith.session import get_spark

    spark = get_spark("skew-probe", master="local[8]", shuffle_partitions=16)
    buckets = L.SALT_BUCKETS
    spark.conf.set("samplesmith.saltBuckets", str(buckets))  # measured and executed with the same count
    docs = A.read(spark, sf, "documents")
    hot = F.col("doc_id") % 3 == 0
    rows = docs.select(F.col("doc_id").alias("seq"),
                       F.when(hot, F.lit("HOT")).otherwise(F.col("text")).alias("instruction"),
                       F.lit("").alias("input"), F.lit("").alias("output"),
                       F.when(hot, F.lit("hot_repo")).otherwise(F.col("source")).alias("repo"),
                       F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path")).repartition(maps)
    out = {"rows": rows.count(), "hot_rows": rows.where("instruction = 'HOT'").count(), "map_tasks": maps,
           "salt_buckets": buckets}

    t = time.perf_counter()
    hot_survivors = D.dedup_wide(rows).where("instruction = 'HOT'").select("seq").collect()
    out["d1_sec"] = round(time.perf_counter() - t, 2)
    out["d1_hot_survivor_is_first"] = [r.seq for r in hot_survivors] == [0]
    # What the first stage receives for the hot key: one row per map task (partial
    # limit), routed to salt = map task % buckets.
    m = rows.withColumn("__k", D.wide_key()).withColumn("__salt", L.salt(buckets)) \
        .withColumn("__task", F.spark_partition_id())
    part = m.withColumn("__r", F.row_number().over(Window.partitionBy("__task", "__k").orderBy("seq"))) \
        .where("__r = 1 AND __k = 'HOT'")
    per_bucket = part.groupBy("__salt").count()
    out["d1_hot_max_rows_per_first_stage_task"] = per_bucket.agg(F.max("count")).first()[0]
    out["d1_hot_rows_into_final_stage"] = per_bucket.count()

    t = time.perf_counter()
    top = L.head_per_group(rows, ["repo"], ["path"], 10)
    hot_top = [r.path for r in top.where("repo = 'hot_repo'").orderBy("rank_in_group").collect()]
    out["l4_sec"] = round(time.perf_counter() - t, 2)
    want = [r.path for r in rows.where("repo = 'hot_repo'").orderBy("path").limit(10).collect()]
    out["l4_hot_head_exact"] = hot_top == want
    print(json.dumps(out))


if __name__ == "__main__":
    main()
