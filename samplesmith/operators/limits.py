"""Limits, per-group heads, seeded shuffle and split.

* Global heads (L1, L2, L3, L6, L8) find the key of the ``n``-th row by range
  histograms over the keys and test every row against it (``order.exact_head``):
  no task reads more than its share, whatever ``n`` is.
* Per-group heads (L4, L5, L7) are ``row_number() <= n`` in two stages —
  per ``(group, map-task salt)``, then per group — each with a partial
  ``WindowGroupLimit`` before its exchange, so a hot group ships at most ``n``
  rows per map task and its final task ranks at most ``n * buckets`` rows.
* The shuffle (O1) is a total order on ``md5(seed:id)`` — range-partitioned,
  never a single-partition window; prefix sums over the ranges give each row its place; written datasets use a hash partition on
  the key plus a local sort instead (no sampling pass).  The split (O2) is a
  per-row hash bucket: no shuffle at all; its exact-count mode reads two bounded
  hash histograms and then tests each row against one cutoff.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplesmith.functions import text as T
from samplesmith.operators.order import exact_head, with_positions


def no_limit(n: int | None) -> bool:
    """``None`` and 0 both mean "no limit"."""
    return not n


def head_n(df: DataFrame, n: int | None, order: list[str]) -> DataFrame:
    """The first ``n`` rows in ``order`` (all rows when ``n`` is falsy).

    One plan for every ``n``: a filter on the key of the ``n``-th row, which range histograms find first.
    """
    return df if no_limit(n) else exact_head(df, n, order)


SALT_BUCKETS = 64            # the skew probe's reference value
SALT_MIN, SALT_MAX = 16, 1024


def salt_buckets(df: DataFrame, default: int | None = None) -> int:
    """First-stage bucket count: ``samplesmith.saltBuckets`` when set, else a
    quarter of ``spark.sql.shuffle.partitions`` within [16, 1024] — a cluster
    sized for a bigger shuffle spreads a hot key over more tasks.  Results do
    not depend on it."""
    conf = df.sparkSession.conf
    explicit = conf.get("samplesmith.saltBuckets", None)
    if explicit:
        return int(explicit)
    if default:
        return default
    parts = int(conf.get("spark.sql.shuffle.partitions", "200"))
    return max(SALT_MIN, min(SALT_MAX, parts // 4))


def salt(buckets: int = SALT_BUCKETS) -> Column:
    """The first-stage bucket of a row: its *map task* modulo ``buckets``.

    With partial limits, every map task already forwards at most one row (or
    ``n``) per key.  Salting by map task makes each first-stage reducer of a
    hot key hear from only ``1/buckets`` of the map tasks; salting by a row
    hash would not (every task would still reach every bucket).  The salt
    only routes rows: the second stage picks by ``order``, so results do not
    depend on it.
    """
    return F.pmod(F.spark_partition_id(), F.lit(buckets))


def head_per_group(df: DataFrame, group: list[str], order: list[str], n: int,
                   buckets: int | None = None) -> DataFrame:
    """The first ``n`` rows of every group, in ``order``; adds ``rank_in_group``.

    Two stages, each with a partial ``WindowGroupLimit`` before its exchange
    (every map task forwards at most ``n`` rows per group): first per
    ``(group, salt)`` with the salt taken from the map task, then per group.
    For a group holding a third of all rows, each first-stage task hears
    from ``1/buckets`` of the map tasks, and the final task ranks at most
    ``n * buckets`` candidates.
    ``order`` must identify rows within a group (ties would be arbitrary).
    ``buckets=1`` is one stage: for a very small ``n``, where ``n`` rows of each
    map task are little for one task, and the result stays partitioned by group.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    if buckets == 1:
        return df.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= n)
    s1 = Window.partitionBy(*group, "__salt").orderBy(*order)
    first = (df.withColumn("__salt", salt(buckets or salt_buckets(df)))
               .withColumn("__r", F.row_number().over(s1)).where(F.col("__r") <= n).drop("__r", "__salt"))
    return first.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= n)


def shuffle_key(id_col: str | Column, seed: int = 42) -> Column:
    """O1: a repeatable pseudo-random key for ``id`` under ``seed``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), T.col(id_col).cast("string")))


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """O1: rows in a seeded pseudo-random total order (ties broken by id).

    A global sort: Spark's range partitioner samples its input first (an extra
    pass over the upstream plan).  ``seeded_shuffle_files`` avoids that."""
    return df.orderBy(shuffle_key(id_col, seed), F.col(id_col))


def seeded_positions(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """O1 with each row's ``place`` (from 1) in the seeded total order."""
    keyed = df.withColumn("shuffle_key", shuffle_key(id_col, seed))
    return with_positions(keyed, ["shuffle_key", id_col])


def seeded_shuffle_files(df: DataFrame, key_col: str, id_col: str, partitions: int | None = None) -> DataFrame:
    """O1 for written datasets: hash-partition on the (uniform) shuffle key and
    sort within partitions — one shuffle, no sampling pass.  Each output file
    holds a seeded random subset in seeded random order; the key column is
    kept, so the total order stays recoverable."""
    parts = df.repartition(partitions, key_col) if partitions else df.repartition(key_col)
    return parts.sortWithinPartitions(key_col, id_col)


def split_bucket(id_col: str | Column, seed: int = 42) -> Column:
    """A uniform value in [0, 1) per id, from the first 32 bits of an md5."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"split{seed}:"), T.col(id_col).cast("string"))), 1, 8), 16, 10)
    return h.cast("bigint") / F.lit(4294967296.0)


def train_eval_split(df: DataFrame, id_col: str, test_size: float = 0.05, seed: int = 42) -> DataFrame:
    """O2: adds ``split`` = 'eval' for a ``test_size`` share of ids, else 'train'.
    Disjoint and complete by construction; no shuffle."""
    return df.withColumn("split", F.when(split_bucket(id_col, seed) < test_size, F.lit("eval")).otherwise(F.lit("train")))


def split_hash(id_col: str | Column, seed: int = 42) -> Column:
    """The split's 32-bit hash of ``id`` as a non-negative integer."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"split{seed}:"), T.col(id_col).cast("string"))), 1, 8),
                  16, 10).cast("bigint")


def exact_train_eval_split(df: DataFrame, id_col: str, test_size: float = 0.05, seed: int = 42) -> DataFrame:
    """O2, exact-count mode: exactly ``ceil(test_size * n)`` rows are 'eval' —
    those with the smallest ``(hash, id)``, ids being unique.

    Two histograms (the upper 16 bits of the hash, then the lower 16 within the
    boundary bucket; at most 65,536 rows each reach the driver) find the one
    hash value at which the count is reached, and the ids on that value give the
    last id.  Then each row is tested against that cutoff: no window, no join.
    """
    h = F.col("__h")
    tagged = df.withColumn("__h", split_hash(id_col, seed))

    def histogram(rows: DataFrame, bits: Column) -> dict[int, int]:
        return {r["p"]: r["count"] for r in rows.groupBy(bits.alias("p")).count().collect()}

    def boundary(hist: dict[int, int], k: int) -> tuple[int, int]:
        """The bucket in which the ``k``-th row lies, and its place there."""
        for p in sorted(hist):
            if hist[p] >= k:
                return p, k
            k -= hist[p]
        raise ValueError("fewer rows than asked for")

    upper = histogram(tagged, F.shiftright(h, 16))
    k = math.ceil(test_size * sum(upper.values()))
    if not k:
        return tagged.withColumn("split", F.lit("train")).drop("__h")
    high, k = boundary(upper, k)
    low, k = boundary(histogram(tagged.where(F.shiftright(h, 16) == high), h.bitwiseAND(F.lit(0xFFFF))), k)
    cut = (high << 16) + low
    last = tagged.where(h == cut).orderBy(id_col).limit(k).agg(F.max(id_col)).first()[0]  # rows that share one hash value
    is_eval = (h < cut) | ((h == cut) & (T.col(id_col) <= F.lit(last)))
    return tagged.withColumn("split", F.when(is_eval, "eval").otherwise("train")).drop("__h")


def prefix_breakdown(df: DataFrame, order: list[str], first_rows: int = 1000, width: int = 30) -> DataFrame:
    """A2: counts per ``instruction[:30]`` over all rows, for the prefixes seen in
    the first ``first_rows`` rows, sorted by prefix.

    The first rows are a bounded top-k (``first_rows`` rows at most), so their
    distinct prefixes form a side of proven size that is broadcast into a
    semi join; the count itself is a partial+final hash aggregate.
    """
    pfx = T.head(T.s("instruction"), width)
    seen = df.orderBy(*order).limit(first_rows).select(pfx.alias("prefix")).distinct()
    tagged = df.select(pfx.alias("prefix"))
    # Filter map-side against the broadcast prefixes, then aggregate.
    return (tagged.join(F.broadcast(seen), "prefix", "left_semi")
                  .groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
                  .orderBy("prefix"))
