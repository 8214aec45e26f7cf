"""Spark session settings and lineage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Session settings every job relies on.  AQE re-plans shuffles at runtime
# (coalesces small partitions, splits skewed ones); the broadcast threshold is
# an explicit size check, not a hint: sides above it fall back to a shuffle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # Post-shuffle partitions are coalesced towards this size; the cluster sets
    # spark.sql.shuffle.partitions (or the AQE initial number) high enough that
    # the largest shuffle divided by it stays near this size.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "samplesmith", master: str | None = None, shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session.  ``master`` is only set for local runs; on a
    cluster the launcher provides it."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when it is unset (local tests) is ``fallback`` installed.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no context; the server's setting applies
        sc = None
    if not d:
        current = sc.getCheckpointDir() if sc is not None else None
        if current:
            return current
        if not fallback:
            raise RuntimeError("spark.checkpoint.dir is not set; pass a shared folder")
        # spark.checkpoint.dir is a core setting (not changeable at runtime);
        # the context-level directory is.
        d = fallback
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a local master without that setting (tests) gets a folder of its own;
    on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    own = sc.master.startswith("local") and "cluster" not in sc.master and sc.getCheckpointDir() is None
    return checkpoint_dir(spark, tempfile.mkdtemp(prefix="checkpoint-") if own else None)


def materialize(df: DataFrame, fallback_dir: str | None = None) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder.

    Used where one result feeds several actions (e.g. a sink plus metrics):
    the checkpoint survives lost executors, unlike cached or local copies.
    """
    checkpoint_dir(df.sparkSession, fallback_dir)
    return df.checkpoint(eager=True)


def sf_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")
