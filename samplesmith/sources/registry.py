"""Dataset registry, selection, path resolution and inventory (S9, S10, S12,
S13, S15, J1, A1).

The registry is a small constant table (5 groups, 22 names).  Path
resolution is a driver-side listing step before one multi-path read; the
inventory counts lines per file in one distributed job and left-joins the
registry to it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplesmith.sources.jsonl import existing_paths

# The dataset registry, group -> names in registry order.
DATASET_GROUPS = {
    "core": ["apps_train", "codealpaca", "humaneval", "mbpp"],
    "synthetic": ["synthetic", "synthetic2", "synthetic3", "synthetic4"],
    "github": ["github_code", "more_repos", "more_repos2", "flask_samples", "gunicorn_samples", "github_discussions"],
    "extra": ["python", "software_eng", "leetcodesmall", "leetcodesmall2", "mbpp_extra", "ossinstruct"],
    "codesearchnet": ["codesearchnet1", "codesearchnet2"],
}
DEFAULT_GROUPS = ["core", "synthetic", "github"]


def registry(spark: SparkSession, data_dir: str = "data") -> DataFrame:
    """``(group, name, path, reg_ord)`` for every registered dataset."""
    rows, k = [], 0
    for g, names in DATASET_GROUPS.items():
        for n in names:
            rows.append((g, n, f"{data_dir}/{n}.jsonl", k))
            k += 1
    return spark.createDataFrame(rows, "group string, name string, path string, reg_ord int")


def select_keys(all_: bool = False, groups: list[str] | None = None, names: list[str] | None = None) -> list[str]:
    """S12 selection: all / groups / explicit names / default core+synthetic+github."""
    if all_:
        return [n for ns in DATASET_GROUPS.values() for n in ns]
    if groups:
        return [n for g in groups for n in DATASET_GROUPS[g]]
    if names:
        return list(names)
    return [n for g in DEFAULT_GROUPS for n in DATASET_GROUPS[g]]


def resolve_paths(spark: SparkSession, keys: list[str], data_dir: str = "data") -> list[tuple[str, str]]:
    """``data/<key>.jsonl``, else the key as a path, else ``data/<basename>``;
    unresolved keys are skipped.  Returns ``(key, path)`` in request order."""
    out = []
    for key in keys:
        for cand in (f"{data_dir}/{key}.jsonl", key, f"{data_dir}/{os.path.basename(key)}"):
            if existing_paths(spark, [cand]):
                out.append((key, cand))
                break
    return out


def inventory(spark: SparkSession, data_dir: str = "data") -> DataFrame:
    """S15 ``list_available_datasets``: per registry entry its raw line count
    (blank lines included) or MISSING.  A dataset is one file, or a folder of
    parts as the sinks write it."""
    paths = existing_paths(spark, [f"{data_dir}/{n}.jsonl" for ns in DATASET_GROUPS.values() for n in ns])
    if paths:
        name = F.regexp_extract("_metadata.file_path", r"([^/]+)\.jsonl(?:/[^/]*)?$", 1)
        names = spark.read.text(paths).select(name.alias("name"))
    else:
        names = spark.createDataFrame([], "name string")
    return with_counts(registry(spark, data_dir), names, "lines").orderBy("reg_ord")


def with_counts(registry: DataFrame, names: DataFrame, count: str) -> DataFrame:
    """The registry with ``count`` (rows of ``names`` per ``name``; null where there is
    none) and ``status``: a partial and final aggregate, then a left join of two small sides."""
    counts = names.groupBy("name").agg(F.count(F.lit(1)).alias(count))
    status = F.when(F.col(count).isNull(), F.lit("MISSING")).otherwise(F.lit("present"))
    return registry.join(counts, "name", "left").withColumn("status", status)


def read_partitioned_parquet(spark: SparkSession, root: str, langs: list[str] | None = None,
                             splits: list[str] | None = None) -> DataFrame:
    """One read over a ``lang=…/split=…`` layout; absent partitions simply do
    not exist, and filters on ``lang``/``split`` prune directories."""
    df = spark.read.option("basePath", root).parquet(root)
    if langs:
        df = df.where(F.col("lang").isin(langs))
    if splits:
        df = df.where(F.col("split").isin(splits))
    return df


def write_partitioned_parquet(df: DataFrame, root: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Persist raw hub tables as parquet, optionally partitioned."""
    w = df.write.mode(mode)
    if by:
        w = w.partitionBy(*by)
    w.parquet(root)
