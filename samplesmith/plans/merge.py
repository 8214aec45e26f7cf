"""Composed jobs over samples: merge (W1), process-and-merge (W2), stage
accounting (A9), dataset inventory (J1/A1/S15), training rows (W7) and
benchmark scoring (W8).

Shuffle budget per job:
* W1/W2 — the keep-first dedup (D1/D2): one exchange after a partial limit;
  the head (L1) is a filter on the key of its last row.
  Scan, routing (P1-P4/P11) and filters (F2/F3) fuse into the map stage.
* W7 — one join of rendered samples with token rows on ``seq``, then one hash
  exchange on the shuffle key with a local sort (no range-sampling pass).
* W8 — aggregates keyed by problem (partial + final), the L7 head per
  problem (partial WindowGroupLimit first), and one join with the tests after
  aggregation, so no generation carries its test through a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samplesmith import adapters as A
from samplesmith.functions import text as T
from samplesmith.operators import convert as C
from samplesmith.operators import dedup as D
from samplesmith.operators import limits as L
from samplesmith.operators import prompts as PR
from samplesmith.operators import scoring as SC
from samplesmith.sources import registry as REG

ORDER = ["dataset_ord", "seq"]
PROCESS_ORDER = ["dataset_ord", "seq", "sample_no"]


def merge_inputs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """W1 inputs over the test tables, in request order: raw hub rows, then samples."""
    return [A.v_raw(spark, sf_dir), A.v_samples(spark, sf_dir)]


def normalized_union(parts: list[DataFrame]) -> DataFrame:
    """S1's F2 + P1-P4 per dataset, then U1."""
    return D.union_ordered([C.normalize_routed(p) for p in parts])


def merge(parts: list[DataFrame], limit: int | None = None, dedup: bool = True) -> DataFrame:
    """W1 ``merge_datasets``: U1 -> F3 -> D1 (keep first) -> L1."""
    f = C.keep_nonempty(normalized_union(parts))
    d = D.dedup_wide(f, ORDER) if dedup else f
    return L.head_n(d, limit, ORDER)


def merge_counted(parts: list[DataFrame], dedup: bool = True) -> DataFrame:
    """W1 without a head, each row with the numbers of input rows that it stands for.

    ``__kept`` is false for the one row that stands for all those F3 drops, ``__n0`` … count a row's group by
    dataset.  The numbers travel with the rows, so their sums in the last stage of the
    write are exact however often an earlier stage runs again; nothing is read twice.
    """
    u = normalized_union(parts)
    kept = C.is_nonempty()
    own = {f"__n{i}": (F.col("dataset_ord") == i).cast("long") for i in range(len(parts))}
    if not dedup:
        return u.withColumns({"__kept": kept, **own})
    digest = F.when(kept, F.unhex(F.sha2(D.wide_key().cast("binary"), 256)))
    groups = u.groupBy(digest.alias("__k")).agg(F.min_by(F.struct(*u.columns), F.struct(*ORDER)).alias("r"),
                                                *[F.sum(c).alias(k) for k, c in own.items()])
    return groups.select("r.*", F.col("__k").isNotNull().alias("__kept"), *own)


def count_columns(parts: int) -> dict[str, Column]:
    """The stage counts as aggregates over ``merge_counted`` rows."""
    each = [F.col(f"__n{i}") for i in range(parts)]
    total = reduce(lambda x, y: x + y, each)
    return {**{f"dataset_{i}": F.sum(c) for i, c in enumerate(each)}, "loaded": F.sum(total),
            "after_filter": F.sum(F.when(F.col("__kept"), total)), "after_dedup": F.count_if("__kept")}


def stage_counts(parts: list[DataFrame]) -> DataFrame:
    """A9 as a table ``(stage, rows)``: per-dataset loads, total, after F3, after D1.

    One scan: rows are counted per key digest (those F3 drops under none) and the groups are counted and summed.
    """
    u = normalized_union(parts)
    digest = F.when(C.is_nonempty(), F.unhex(F.sha2(D.wide_key().cast("binary"), 256)))
    keyed = u.select(digest.alias("__k"), *[(F.col("dataset_ord") == i).cast("long").alias(f"__n{i}") for i in range(len(parts))])
    groups = keyed.groupBy("__k").agg(*[F.sum(f"__n{i}").alias(f"__n{i}") for i in range(len(parts))])
    counts = count_columns(len(parts))
    totals = groups.withColumn("__kept", F.col("__k").isNotNull()).agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(k) for k, c in counts.items()])
    stage = {k: k.replace("dataset_", "loaded:") for k in counts}
    return totals.select(F.inline(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(k).alias("rows")) for k, n in stage.items()])))


def inventory(spark: SparkSession, registry: DataFrame, rows: DataFrame, name_col: str = "dataset") -> DataFrame:
    """J1/A1 over a table: per registry entry, its row count or MISSING (S15 is the
    same rule over files, ``registry.inventory``)."""
    return REG.with_counts(registry, rows.select(F.col(name_col).alias("name")), "rows").select("group", "name", "rows", "status")


def process_and_merge(named: DataFrame, limit: int | None = None) -> DataFrame:
    """W2 ``merge_and_process``: P11 routing -> U1 order -> D2 -> L1."""
    routed = C.route_by_file_name(named)
    return L.head_n(D.dedup_narrow(routed, PROCESS_ORDER), limit, PROCESS_ORDER)


def training_rows(samples: DataFrame, token_ids: DataFrame, max_seq: int = PR.DEFAULT_MAX_SEQ,
                  style: str = "inst", seed: int = 42, test_size: float = 0.05) -> DataFrame:
    """W7 ``load_tokenize_dataset``: C19 render -> token rows (joined by id) ->
    C26 fixed-length arrays -> O1 seeded order -> O2 split."""
    r = samples.select("seq", PR.render_prompt(style).alias("prompt"))
    j = r.join(token_ids.withColumnRenamed("id", "seq"), "seq")
    cols = PR.fixed_length("tokens", max_seq=max_seq)
    out = j.select("seq", "prompt", *[v.alias(k) for k, v in cols.items()],
                   L.shuffle_key("seq", seed).alias("shuffle_key"))
    out = L.train_eval_split(out, "seq", test_size, seed)
    return L.seeded_shuffle_files(out, "shuffle_key", "seq")


def score_benchmarks(gens: DataFrame, tests: DataFrame) -> DataFrame:
    """C22 on every generation, A3/L7 per problem, then the problem's test and
    prompt[:50] for the report; problems without a test (J4) drop out.  ``task_id``
    is unique in ``tests``."""
    return SC.per_problem(SC.with_code(gens)).join(tests.select("task_id", T.head("prompt", 50).alias("prompt")), "task_id")
