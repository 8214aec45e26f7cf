"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samplesmith.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: its lineage ends there.

    The table is compressed, which a checkpoint's rows are not.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_hot(rows: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """``rows`` with ``part``: groups in which every two members of a key meet, of about ``2 * limit`` members at most.

    A key of up to ``limit`` rows is one part.  The members of a larger one are dealt to chunks of about ``limit`` by the
    hash of ``member``, and each pair of chunks is a part: no pair of members is lost, and no task holds the whole key.
    """
    hot = cut(rows.groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
              .select("__hot", F.ceil(F.col("n") / limit).alias("__k")))
    own = F.pmod(F.xxhash64(member), F.col("__k"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1), lambda j: j != own)
    parts = F.when(F.col("__k").isNull(), F.array(key)).otherwise(
        F.transform(others, lambda j: F.xxhash64(key, F.least(own, j), F.greatest(own, j))))
    return rows.join(hot, F.col(key) == F.col("__hot"), "left").select(*rows.columns, F.explode(parts).alias("part"))


def id_and_bytes(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long and the whole text as UTF-8 bytes, other columns dropped."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").cast("binary").alias("text"), *more)


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from (a null id is in no fold)."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))
