"""File-to-file jobs: the command-line flows of the source project as Spark
jobs over real inputs (JSONL folders, source trees, issue dumps).

Each job reads, transforms with the operators, and writes once.  Where one
result feeds a sink and metrics, the metrics ride on the write job
(``observe``), so no job scans its input twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplesmith.operators import convert as C
from samplesmith.operators import reasoning as RS
from samplesmith.operators.limits import head_n
from samplesmith.operators import scoring as SC
from samplesmith.operators import snippets as SN
from samplesmith.operators import threads as TH
from samplesmith.plans import merge as M
from samplesmith.sources import jsonl as J
from samplesmith.sources import registry as REG
from samplesmith.schema import GENERATION, SAMPLE_FIELDS
from samplesmith.session import materialize
from samplesmith.sources import trees as TR


ITEMS = "item_id long, title string, body string, pull_request struct<url:string>"
COMMENTS = "parent_key long, ord long, body string"


def _dump(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The objects of a JSONL dump, read as S2 reads samples: what is no single JSON object is dropped."""
    schema = spark.createDataFrame([], schema).schema
    return J.read_jsonl_lenient(spark, path, schema=schema).select(*schema.fieldNames())


def merge_files(spark: SparkSession, keys: list[str], out: str, data_dir: str = "data",
                limit: int | None = None, dedup: bool = True, job_id: str | None = None) -> dict:
    """W1 ``merge_datasets`` CLI: resolve keys (S13), strict scan (S1) in request
    order, route (P1-P4), filter (F3), keep-first dedup (D1), head (L1), write (S4) in
    that order, with stage counts (A9), which are exact: they ride on the write's last
    stage, and with a head, which needs passes of its own, come from one scan."""
    parts = []
    for key, path in REG.resolve_paths(spark, keys, data_dir):
        df = J.read_jsonl_strict(spark, path)
        parts.append(df.withColumn("dataset", F.lit(key)))
    if not parts:
        return {"written": 0}
    # The strict reader's file order is (file_path, block, row): fold it into seq.
    parts = [p.withColumn("seq", F.struct(*J.FILE_ORDER)) for p in parts]
    if limit:
        told = {r["stage"].replace("loaded:", "dataset_"): r["rows"] for r in M.stage_counts(parts).collect()}
        if not dedup:
            told["after_dedup"] = told["after_filter"]
        told["rows"] = J.write_jsonl(M.merge(parts, limit, dedup), out, order=M.ORDER, job_id=job_id)
    else:
        rows = M.merge_counted(parts, dedup)
        lines = rows.select(*SAMPLE_FIELDS, *M.ORDER, *[c for c in rows.columns if c.startswith("__")])
        told = J.write_parts(lines, out, order=M.ORDER, job_id=job_id, counts=M.count_columns(len(parts)), keep=F.col("__kept"),
                             line=J.python_json_line(SAMPLE_FIELDS))
    loaded = {"rows": told["loaded"], **{k: v for k, v in told.items() if k.startswith("dataset_")}}
    return {"written": told["rows"], "loaded": loaded, "after_filter": {"rows": told["after_filter"]},
            "after_dedup": {"rows": told["after_dedup"]}}


def process_files(spark: SparkSession, input_files: list[str], out: str, limit: int | None = None) -> int:
    """W2 ``merge_and_process``: per JSONL file a lenient scan (S2), routing by
    file name (P11), the ordered union (U1), narrow keep-first dedup (D2) and
    head (L1).  Non-JSONL inputs are skipped."""
    from samplesmith.schema import RAW
    parts = []
    for k, path in enumerate(p for p in input_files if p.endswith(".jsonl")):
        df = J.read_jsonl_lenient(spark, path, schema=RAW)
        parts.append(df.select(F.lit(k).alias("dataset_ord"), F.lit(path.rsplit("/", 1)[-1]).alias("dataset"),
                               F.struct(*J.FILE_ORDER).alias("seq"), *RAW.fieldNames()))
    if not parts:
        return J.write_jsonl(spark.createDataFrame([], "instruction string, input string, output string"), out)
    named = parts[0]
    for p in parts[1:]:
        named = named.unionByName(p)
    return J.write_jsonl(M.process_and_merge(named, limit), out, order=M.PROCESS_ORDER)


def reasoning_files(spark: SparkSession, src: str, out: str, version: str = "v2", tools: bool = False,
                    limit: int | None = None, add_cot: bool = True, add_tools: bool = True) -> int:
    """W5/W6 CLIs: lenient scan (S2), optional head in file order, transform, write."""
    df = J.read_jsonl_lenient(spark, src)
    if limit:
        df = head_n(df, limit, J.FILE_ORDER)
    if version == "v1":
        t = RS.transform_v1(df, add_cot=add_cot, add_tools=add_tools)
    elif tools:
        t = RS.transform_v2_tools(df)
    else:
        t = RS.transform_v2(df)
    return J.write_jsonl(t, out, order=J.FILE_ORDER)


def tree_to_samples(spark: SparkSession, root: str, out: str, repo: str | None = None,
                    discussion_items: str | None = None, discussion_comments: str | None = None,
                    max_items: int | None = 50) -> int:
    """W3 ``repo2dataset --local``: S6 scan with F5/F7, F9, P28a chunks, P27 fan-out;
    with discussion dumps, the W4 samples (first ``max_items`` items) follow."""
    files = TR.scan_tree(spark, root, exts=SN.TREE_EXTS, repo=repo)
    files = files.where(SN.name_has_no_skip_word(SN.TREE_SKIP_WORDS))
    samples = SN.task_fanout(SN.tree_chunks(files).select("path", "chunk_no", "chunk")).select(
        "instruction", "input", "output")
    if discussion_items and discussion_comments:
        items, comments = _dump(spark, discussion_items, ITEMS), _dump(spark, discussion_comments, COMMENTS)
        samples = samples.unionByName(
            TH.thread_samples(items, comments, max_items).select("instruction", "input", "output"))
    return J.write_jsonl(samples, out)


def repo_snippets(spark: SparkSession, root: str, out: str, variant: str = "a", mode: str = "overwrite") -> int:
    """W10 snippet ingestion: S7 scan with the byte bound pushed down, F6, L4, P26."""
    src = SN.SNIPPET_SOURCES[variant]
    files = TR.scan_tree(spark, root, exts=list(src.exts), min_bytes=src.min_bytes, max_bytes=src.max_bytes, pruned=src.pruned_dirs)
    return J.write_jsonl(SN.snippet_samples(files, src), out, mode=mode)


CONVERTERS = {  # --kind -> (converter, cap applies to rows scanned (L2) or kept (L3))
    "alpaca": (C.alpaca_hub, "kept"),
    "humaneval": (C.humaneval_hub, "kept"),
    "mbpp": (C.mbpp_hub, "kept"),
    "python-instruct": (C.python_instruct_hub, "kept"),
    "first-nonempty-a": (C.first_nonempty_a, "scanned"),
    "first-nonempty-b": (C.first_nonempty_b, "scanned"),
    "code-docstring": (C.code_docstring, "scanned"),
    "function-doc-short": (C.function_doc_short, "scanned"),
    "function-doc-multilang": (C.function_doc_multilang, "scanned"),
    "problems": (C.apps_with_difficulty, "scanned"),
    "discussions": (C.discussion_samples, "scanned"),
}


def convert_dump(spark: SparkSession, kind: str, src: str, out: str, fmt: str = "jsonl",
                 limit: int | None = None) -> int:
    """The hub converters (P13-P21, P12, P25) over local dumps: a JSONL (lenient
    scan, file order) or parquet input, the converter, and the source's cap —
    on rows scanned (L2) or on rows kept (L3) depending on the converter."""
    from samplesmith.schema import RAW
    fn, cap = CONVERTERS[kind]
    if fmt == "parquet":  # file order = (file, row index within the file)
        df = spark.read.parquet(src).select("*", F.col("_metadata.file_path").alias("__file"),
                                            F.col("_metadata.row_index").alias("__row"))
        order = ["__file", "__row"]
    else:
        df = J.read_jsonl_lenient(spark, src, schema=RAW)
        order = J.FILE_ORDER
    if kind == "function-doc-multilang" and "lang" not in df.columns:
        df = df.withColumn("lang", F.lit("python"))
    if cap == "scanned":
        df = head_n(df, limit, order)
        out_df = fn(df)
    else:
        out_df = head_n(fn(df), limit, order)
    return J.write_jsonl(out_df, out, order=order)


def python_tree_chunks(spark: SparkSession, root: str, name: str, out: str) -> int:
    """S8 + P29 (``download_extra``): ``.py`` files outside dot and virtualenv
    directories, 20-line windows over the first 80 lines with path and line
    range in the instruction."""
    files = TR.scan_tree(spark, root, exts=[".py"], repo=name, pruned=SN.PY_TREE_PRUNED, hidden=False)
    return J.write_jsonl(SN.line_provenance_chunks(files, name), out)


def code_search_samples(spark: SparkSession, root: str, out: str, langs: list[str] | None = None,
                        splits: list[str] | None = None) -> int:
    """S9 + P21 (``download_codesearchnet``): one read over a ``lang=/split=``
    parquet layout (absent partitions simply missing; filters prune folders)."""
    df = REG.read_partitioned_parquet(spark, root, langs, splits)
    return J.write_jsonl(C.function_doc_multilang(df), out)


def threads_to_samples(spark: SparkSession, items_path: str, comments_path: str, out: str,
                       max_items: int | None = None) -> int:
    """W4 over issue/PR and comment dumps (JSONL)."""
    items, comments = _dump(spark, items_path, ITEMS), _dump(spark, comments_path, COMMENTS)
    return J.write_jsonl(TH.thread_samples(items, comments, max_items), out)


def problems_to_samples(spark: SparkSession, train_path: str, test_path: str, out_dir: str,
                        limit: int | None = None, job_id: str | None = None) -> dict:
    """W9 ``convert_apps``: per split, a lenient scan (S2) capped on parseable
    lines (L2), P12, appended to the split's file (S5); then both splits
    concatenated (S11), train first.  A ``job_id`` makes a retry append nothing twice."""
    schema = "question string, solutions string, difficulty string"
    counts = {}
    outs = []
    for name, path in (("apps_train", train_path), ("apps_test", test_path)):
        df = J.read_jsonl_lenient(spark, path, schema=spark.createDataFrame([], schema).schema)
        if limit:
            df = head_n(df, limit, J.FILE_ORDER)
        out = f"{out_dir}/{name}"
        counts[name] = J.write_jsonl(C.apps_with_difficulty(df), out, mode="append", order=J.FILE_ORDER,
                                     job_id=job_id and f"{job_id}.{name}")
        outs.append(out)
    counts["combined"] = J.concat_files(spark, outs, f"{out_dir}/combined", job_id=job_id and f"{job_id}.combined")
    return counts


def training_set(spark: SparkSession, samples_path: str, tokens_path: str, out_dir: str, max_seq: int = 2048,
                 style: str = "inst", seed: int = 42, test_size: float = 0.05, batch: int = 4, accum: int = 4) -> dict:
    """W7 ``load_tokenize_dataset``: S2 -> C19 -> C26 (token rows from any tokenizer's
    output, joined by ``id`` = the sample's position key) -> O1 -> O2, written once as
    parquet with a folder per split; A11 steps per epoch from the written train count.

    Samples carry an ``id`` (the key of the tokenizer's ``(id, tokens)`` table)."""
    schema = spark.createDataFrame([], "id long, instruction string, input string, output string").schema
    s = J.read_jsonl_lenient(spark, samples_path, schema=schema).withColumnRenamed("id", "seq")
    tokens = spark.read.parquet(tokens_path)
    rows = M.training_rows(s, tokens, max_seq=max_seq, style=style, seed=seed, test_size=test_size)
    obs = Observation("written")
    counts = [F.count_if(F.col("split") == split).alias(split) for split in ("train", "eval")]
    rows.observe(obs, *counts).write.mode("overwrite").partitionBy("split").parquet(out_dir)
    out = {split: int(obs.get.get(split, 0)) for split in ("train", "eval")}
    out["steps_per_epoch"] = out["train"] // (batch * accum)
    out["dataset_kind"] = spark.range(1).select(C.dataset_kind(F.lit(samples_path))).first()[0]
    return out


def score(spark: SparkSession, generations_path: str, tests_path: str, out_dir: str, fallback_ckpt: str | None = None) -> dict:
    """W8 over generation outcomes: per-problem results (A3, L7, J4, C22) are
    checkpointed once into the shared checkpoint folder, then feed the results
    sink (S14), the summary table (A6) and the base-vs-tuned comparison (A7)."""
    gens = _dump(spark, generations_path, GENERATION)
    tests = _dump(spark, tests_path, "task_id long, prompt string, test string")
    problems = materialize(M.score_benchmarks(gens, tests), fallback_ckpt)
    SC.result_records(problems).write.mode("overwrite").json(f"{out_dir}/results")
    summary = SC.summary_table(problems).orderBy("results_key")
    summary.write.mode("overwrite").json(f"{out_dir}/summary")
    comparison = SC.improvement(problems)
    comparison.write.mode("overwrite").json(f"{out_dir}/comparison")
    return {"summary": [r.asDict() for r in summary.collect()],          # one row per results key
            "comparison": [r.asDict() for r in comparison.collect()]}   # one row per benchmark
