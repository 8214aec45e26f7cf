"""Global order without one task that sees all rows: exact heads and positions.

* ``exact_head``: the key of the ``n``-th row is found by range histograms.  The keys
  alone are dealt to ranges and counted (one row per range reaches the driver); the
  range in which the ``n``-th row lies is dealt again, until it is small.  Then each
  row is tested against that one key: no row moves, and the plan is the same
  for every ``n``.
* ``with_positions``: rows are dealt to ranges, sorted there and written; the rows of
  earlier ranges (a prefix sum over one number per range) and the place in its
  own range give each row its position.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplesmith.session import shared_dir

CELL = 10_000  # keys that one task may sort to find the last one of a head
RANGES = 16  # at least
OFFSET = (1 << 33) - 1  # monotonically_increasing_id: partition in the upper bits, place in the lower 33


def literal(value: Any, kind: T.DataType) -> Column:
    """A collected value as a literal of its own type, structs included."""
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*[literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(value).cast(kind)


def _cells(keys: DataFrame) -> list:
    """(count, least, greatest) of ranges of ``k``, in order."""
    parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), RANGES)  # a given number is not coalesced
    ranged = keys.repartitionByRange(parts, "k").groupBy(F.spark_partition_id().alias("part"))
    return ranged.agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo").collect()


def nth_key(df: DataFrame, order: list[str], n: int, cell: int = CELL) -> tuple[Column, int] | None:
    """The key of the ``n``-th row in ``order`` and how many rows of that very key are among the first ``n``.

    None if there are no more than ``n`` rows.
    """
    keys = df.select(F.struct(*order).alias("k"))
    kind, need, size = keys.schema["k"].dataType, n, None
    while True:
        cells = _cells(keys)
        if size is None and sum(c["n"] for c in cells) <= n:
            return None
        for c in cells:
            if c["n"] >= need:
                break
            need -= c["n"]
        lo, hi = literal(c["lo"], kind), literal(c["hi"], kind)
        if c["lo"] == c["hi"]:
            return lo, need
        keys = keys.where((F.col("k") >= lo) & (F.col("k") <= hi))
        if c["n"] == size:  # the ranges did not part it, as one key has nearly all its rows: take its least key off
            least = keys.where(F.col("k") == lo).count()
            if need <= least:
                return lo, need
            need, keys = need - least, keys.where(F.col("k") > lo)
        size = c["n"]
        if c["n"] <= cell:
            last = keys.orderBy("k").limit(need)
            key = last.agg(F.max("k")).first()[0]
            return literal(key, kind), last.where(F.col("k") == literal(key, kind)).count()


def exact_head(df: DataFrame, n: int, order: list[str], cell: int = CELL) -> DataFrame:
    """The first ``n`` rows in ``order`` (nulls first), in no order of their own.

    Where rows share the last key, as many of them as are asked for stay.
    """
    found = nth_key(df, order, n, cell)
    if found is None:
        return df
    key, rest = found
    at = F.struct(*order)
    if df.where(at == key).limit(rest + 1).count() <= rest:
        return df.where(at <= key)
    return df.where(at < key).unionByName(df.where(at == key).limit(rest))


def with_positions(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``df`` with each row's position (from 1) in ``order``; rows of equal keys take places in any order.

    The ranges are written to the shared folder, so the positions do not change when a task runs again.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/ranges-{uuid.uuid4().hex}"
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows.write.parquet(path)
    back = df.sparkSession.read.schema(rows.schema).parquet(path)
    part = F.shiftright("__id", 33)
    before, total = [], 0
    for r in back.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row per range
        before.append((r["part"], total))
        total += r["count"]
    offsets = df.sparkSession.createDataFrame(before, "__part long, __before long")
    placed = back.join(F.broadcast(offsets), part == F.col("__part"))
    return placed.select(*df.columns, (F.col("__before") + F.col("__id").bitwiseAND(F.lit(OFFSET)) + 1).alias(name))
