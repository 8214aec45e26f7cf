"""The reasoning jobs (W5, W6) on Structured Streaming.

Both transforms are stateless per row (filter + projection), so the same
column expressions run on a ``readStream`` of JSONL samples: new files in the
input folder become new output files, exactly once, with progress kept in a
checkpoint folder in shared storage (taken from ``spark.checkpoint.dir``).
A8 (samples with tools) is tracked as a named observation per micro-batch.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from samplesmith.operators import reasoning as RS
from samplesmith.schema import SAMPLE, SAMPLE_FIELDS
from samplesmith.session import checkpoint_dir
from samplesmith.sources.jsonl import parsed, python_json_line


def sample_stream(spark: SparkSession, src_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Lenient JSONL sample stream (S2 by the batch scan's own rule: what is no single JSON object is dropped)."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    found = r.load(src_dir).select(parsed(F.col("value"), SAMPLE).alias("o"))
    return found.where("o IS NOT NULL").select("o.*")


def transformed(stream: DataFrame, version: str = "v2", tools: bool = False) -> DataFrame:
    """W5 (``version='v1'``) or W6 (``version='v2'``, optionally with tools)."""
    if version == "v1":
        return RS.transform_v1(stream)
    if tools:
        out = RS.transform_v2_tools(stream)
        return out.observe("tool_samples", F.count(F.lit(1)).alias("transformed"),
                           F.count_if("has_tools").alias("with_tools"))
    return RS.transform_v2(stream)


def start_reasoning_stream(spark: SparkSession, src_dir: str, out_dir: str, version: str = "v2",
                           tools: bool = False, checkpoint: str | None = None,
                           available_now: bool = True) -> StreamingQuery:
    """Start the streaming job writing JSONL to ``out_dir``."""
    if checkpoint is None:
        checkpoint = posixpath.join(checkpoint_dir(spark), "reasoning-" + version + ("-tools" if tools else ""))
    out = transformed(sample_stream(spark, src_dir), version, tools).select(
        python_json_line(SAMPLE_FIELDS).alias("value"))  # the batch sinks' exact line layout
    w = out.writeStream.format("text").option("path", out_dir).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
