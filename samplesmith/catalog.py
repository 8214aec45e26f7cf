"""Registered queries: one per operator row of the inventory, each taking
``(spark, sf_dir)`` and returning a DataFrame over the driver's tables.

Keys follow the inventory ids.  Every query reads whole tables (through the
adapters in ``samplesmith.adapters``); limits appear only where the limit is
the operator itself (heads, caps, top-k).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samplesmith import adapters as A
from samplesmith.functions import rules as R
from samplesmith.functions import text as T
from samplesmith.functions import tools as TL
from samplesmith.operators import convert as C
from samplesmith.operators import dedup as D
from samplesmith.operators import generate as G
from samplesmith.operators import limits as L
from samplesmith.operators import prompts as PR
from samplesmith.operators import reasoning as RS
from samplesmith.operators import scoring as SC
from samplesmith.operators import snippets as SN
from samplesmith.operators import threads as TH
from samplesmith.plans import jobs as JB
from samplesmith.plans import merge as W
from samplesmith.schema import SAMPLE_FIELDS
from samplesmith.session import shared_dir
from samplesmith.sources import jsonl as J
from samplesmith.sources import registry as REG
from samplesmith.sources import trees as TR

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}


def query(name: str):
    def deco(fn: Q) -> Q:
        QUERIES[name] = fn
        return fn
    return deco


def _samples(spark, sf):
    return A.v_samples(spark, sf)


def _r4(c):
    return F.round(c, 6)


# --- flagship ---------------------------------------------------------------

@query("flagship_class_profile")
def flagship(spark, sf):
    """V_samples -> F2 -> P4 -> D1 -> C1 -> per-class count and mean output length."""
    s = C.keep_nonempty(C.normalize_routed(_samples(spark, sf)))
    d = D.dedup_wide(s)
    return (d.groupBy(R.classify_problem("instruction").alias("problem_class"))
             .agg(F.count(F.lit(1)).alias("samples"),
                  _r4(F.avg(F.length("output"))).alias("avg_output_chars")))


# --- projections ---------------------------------------------------------------

@query("p1_p4_routed_normalize")
def p1_p4(spark, sf):
    return C.normalize_routed(A.v_raw(spark, sf))


@query("p5_problem_samples")
def p5(spark, sf):
    return C.apps_samples(A.v_problems(spark, sf).select("item_id", "question", "solutions", "starter_code"))


@query("p6_code_doc_explain")
def p6(spark, sf):
    return C.code_doc_explain(A.v_code_doc(spark, sf).select("seq", "code", "english_documentation",
                                                             "func_documentation_string"))


@query("p7_p8_instruction_passthrough")
def p7(spark, sf):
    return C.instruction_passthrough(A.v_raw(spark, sf).select("seq", "instruction", "input", "output"))


@query("p9_function_completion")
def p9(spark, sf):
    return C.function_completion(A.v_functions(spark, sf).select("task_id", "prompt", "canonical_solution"))


@query("p10_function_writing")
def p10(spark, sf):
    return C.function_writing(A.v_raw(spark, sf).select("seq", "text", "code"))


@query("p11_route_by_file_name")
def p11(spark, sf):
    return C.route_by_file_name(A.v_named_sources(spark, sf))


@query("p12_problem_difficulty")
def p12(spark, sf):
    return C.apps_with_difficulty(A.v_problems(spark, sf).select("item_id", "question", "solutions", "difficulty"))


@query("p13_alpaca_hub")
def p13(spark, sf):
    return C.alpaca_hub(A.v_raw(spark, sf).select("seq", "prompt", "completion"))


@query("p14_humaneval_hub")
def p14(spark, sf):
    return C.humaneval_hub(A.v_functions(spark, sf).select("task_id", "prompt", "canonical_solution"))


@query("p15_mbpp_hub")
def p15(spark, sf):
    return C.mbpp_hub(A.v_raw(spark, sf).select("seq", "text", "code"))


@query("p16_python_instruct_hub")
def p16(spark, sf):
    return C.python_instruct_hub(A.v_raw(spark, sf).select("seq", "instruction", "input", "output"))


@query("p17_first_nonempty_a")
def p17(spark, sf):
    return C.first_nonempty_a(A.v_raw(spark, sf))


@query("p18_first_nonempty_b")
def p18(spark, sf):
    return C.first_nonempty_b(A.v_raw(spark, sf))


@query("p19_code_docstring")
def p19(spark, sf):
    return C.code_docstring(A.v_code_doc(spark, sf).select("seq", "code", "docstring", "english_documentation"))


@query("p20_function_doc_short")
def p20(spark, sf):
    return C.function_doc_short(A.v_code_doc(spark, sf).select("seq", "func_code_string", "func_documentation_string"))


@query("p21_function_doc_multilang")
def p21(spark, sf):
    return C.function_doc_multilang(A.v_code_doc(spark, sf).select(
        "seq", "lang", "split", "func_code_string", "func_documentation_string", "repository_name"))


@query("p22_issue_samples")
def p22(spark, sf):
    items = A.v_thread_items(spark, sf)
    return C.issue_samples(items.where(TH.is_issue(items)))


@query("p23_pr_samples")
def p23(spark, sf):
    items = A.v_thread_items(spark, sf)
    return C.pr_samples(items.where(~TH.is_issue(items)))


@query("p24_comment_samples")
def p24(spark, sf):
    return C.comment_samples(A.v_thread_comments(spark, sf))


@query("p25_discussion_samples")
def p25(spark, sf):
    return C.discussion_samples(A.v_thread_items(spark, sf).select("item_id", "title", "body"))


for _k in "abcd":
    def _mk(k):
        def fn(spark, sf):
            return SN.snippet_samples(A.v_files(spark, sf), SN.SNIPPET_SOURCES[k])
        return fn
    query(f"p26{_k}_repo_snippets")(_mk(_k))


@query("p27_task_fanout")
def p27(spark, sf):
    return SN.task_fanout(SN.tree_chunks(A.v_files(spark, sf)).select("path", "chunk_no", "chunk"))


@query("p28a_tree_chunks")
def p28a(spark, sf):
    return SN.tree_chunks(A.v_files(spark, sf)).select("path", "chunk_no", "chunk")


@query("p28b_min_chunks")
def p28b(spark, sf):
    return SN.min_chunks(A.v_files(spark, sf), window=30).select("path", "chunk_no", "chunk")


@query("p29_line_provenance_chunks")
def p29(spark, sf):
    return SN.line_provenance_chunks(A.v_files(spark, sf), "corpus")


@query("p30_report_truncation")
def p30(spark, sf):
    g = SC.with_code(A.v_generations(spark, sf))
    g = g.withColumns({"instruction": F.concat(F.lit("Solve task "), F.col("task_id").cast("string")),
                       "generated": F.col("text")})
    return SC.report_record(g.where(F.col("benchmark") == "custom"))


@query("p31_dataset_kind")
def p31(spark, sf):
    files = A.v_files(spark, sf)
    path = F.concat(F.col("repo"), F.lit("/"), F.when(F.col("length") % 3 == 0, F.lit("cot_"))
                    .when(F.col("length") % 3 == 1, F.lit("reasoning_")).otherwise(F.lit("")), F.lit("data.jsonl"))
    return files.select("path", C.dataset_kind(path).alias("kind"))


# --- filters ---------------------------------------------------------------------

@query("f2_validate_raw")
def f2(spark, sf):
    r = A.v_raw(spark, sf)
    return r.where(C.validate_raw(r)).select("seq")


@query("f3_nonempty_samples")
def f3(spark, sf):
    return C.keep_nonempty(C.normalize_routed(A.v_raw(spark, sf))).select("seq")


@query("f4_output_length")
def f4(spark, sf):
    return _samples(spark, sf).where(RS.keep_output("output")).select("seq")


@query("f5_f7_tree_file_filters")
def f5(spark, sf):
    f = A.v_files(spark, sf)
    return f.where(SN.has_extension(SN.TREE_EXTS) & SN.name_has_no_skip_word(SN.TREE_SKIP_WORDS)).select("path")


@query("f6_pruned_dirs")
def f6(spark, sf):
    f = A.v_files(spark, sf)
    return f.where(SN.not_in_pruned_dir(SN.SNIPPET_SOURCES["a"].pruned_dirs)).select("path")


@query("f8_byte_bound")
def f8(spark, sf):
    return A.v_files(spark, sf).where(SN.byte_bound(50, 50000)).select("path", "length")


@query("f9_char_bound")
def f9(spark, sf):
    return A.v_files(spark, sf).where(SN.char_bound()).select("path")


@query("f11_issues_not_prs")
def f11(spark, sf):
    items = A.v_thread_items(spark, sf)
    return items.where(TH.is_issue(items)).select("item_id")


# --- joins ---------------------------------------------------------------------------

@query("j1_dataset_inventory")
def j1(spark, sf):
    return W.inventory(spark, A.v_registry(spark), A.v_raw(spark, sf))


@query("j2_l5_thread_comments")
def j2(spark, sf):
    items = A.v_thread_items(spark, sf).select("item_id")
    c = TH.first_comments(A.v_thread_comments(spark, sf)).withColumnRenamed("parent_key", "item_id")
    return c.join(items, "item_id").select("item_id", "ord", "body")


@query("j3_a7_base_vs_tuned")
def j3(spark, sf):
    r = SC.improvement(SC.problem_outcomes(A.v_generations(spark, sf)))
    return r.withColumns({c: _r4(F.col(c)) for c in ("base_rate", "ft_rate", "improvement")})


@query("j4_generation_tests")
def j4(spark, sf):
    g = SC.with_code(A.v_generations(spark, sf))
    return SC.attach_tests(g, A.v_tests(spark, sf)).select("task_id", "gen", "full_code")


# --- aggregations ----------------------------------------------------------------------

@query("a1_rows_per_dataset")
def a1(spark, sf):
    return A.v_raw(spark, sf).groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"))


@query("a2_prefix_breakdown")
def a2(spark, sf):
    return L.prefix_breakdown(_samples(spark, sf), ["seq"])


@query("a3_l7_per_problem")
def a3(spark, sf):
    return SC.per_problem(SC.with_code(A.v_generations(spark, sf)))


@query("a4_solved_fraction")
def a4(spark, sf):
    p = SC.problem_outcomes(A.v_generations(spark, sf))
    return SC.solved_fraction(p).withColumn("solved_fraction", _r4(F.col("solved_fraction")))


@query("a4b_unbiased_pass_at_k")
def a4b(spark, sf):
    p = SC.problem_outcomes(A.v_generations(spark, sf))
    return SC.unbiased_pass_at_k(p, 10).withColumn("pass_at_10", _r4(F.col("pass_at_10")))


@query("a5_custom_pass_rate")
def a5(spark, sf):
    g = A.v_generations(spark, sf).where(F.col("benchmark") == "custom")
    return g.groupBy("model").agg(_r4(100 * F.avg(F.col("passed").cast("double"))).alias("pass_rate"))


@query("a6_summary_table")
def a6(spark, sf):
    s = SC.summary_table(SC.problem_outcomes(A.v_generations(spark, sf)))
    return s.withColumn("rate", _r4(F.col("rate")))


@query("a8_tool_sample_count")
def a8(spark, sf):
    t = RS.transform_v2_tools(_samples(spark, sf))
    return t.agg(F.count(F.lit(1)).alias("transformed"), F.count_if("has_tools").cast("bigint").alias("with_tools"))


@query("a9_stage_counts")
def a9(spark, sf):
    return W.stage_counts(W.merge_inputs(spark, sf))


@query("a10_loss_perplexity")
def a10(spark, sf):
    r = PR.loss_and_perplexity(A.v_token_loss(spark, sf))
    return r.select(_r4(F.col("eval_loss")).alias("eval_loss"), "tokens",
                    _r4(F.col("eval_perplexity")).alias("eval_perplexity"))


@query("a11_steps_per_epoch")
def a11(spark, sf):
    t = L.train_eval_split(_samples(spark, sf), "seq").where(F.col("split") == "train")
    return t.agg(F.count(F.lit(1)).alias("train_rows")).withColumn(
        "steps_per_epoch", PR.steps_per_epoch(F.col("train_rows"), 4, 4))


# --- distinct, union, limits, order -------------------------------------------------------

@query("d1_dedup_wide")
def d1(spark, sf):
    return D.dedup_wide(C.normalize_routed(A.v_raw(spark, sf)))


@query("d2_dedup_narrow")
def d2(spark, sf):
    return D.dedup_narrow(C.normalize_routed(A.v_raw(spark, sf)))


@query("u1_union_ordered")
def u1(spark, sf):
    parts = [C.normalize_routed(A.v_raw(spark, sf)), C.normalize_routed(_samples(spark, sf))]
    return D.union_ordered(parts).select("dataset_ord", "seq", "instruction")


@query("l1_head_after_dedup")
def l1(spark, sf):
    return W.merge(W.merge_inputs(spark, sf), limit=500)


@query("l2_scan_cap")
def l2(spark, sf):
    raw = L.head_n(A.v_raw(spark, sf), 300, ["seq"])
    return C.first_nonempty_a(raw)


@query("l3_keep_cap")
def l3(spark, sf):
    return L.head_n(C.python_instruct_hub(A.v_raw(spark, sf).select("seq", "instruction", "input", "output")), 300, ["seq"])


@query("l4_files_per_repo")
def l4(spark, sf):
    return L.head_per_group(A.v_files(spark, sf), ["repo"], ["path"], 10).select("repo", "path", "rank_in_group")


@query("l6_item_caps")
def l6(spark, sf):
    return TH.thread_samples(A.v_thread_items(spark, sf), A.v_thread_comments(spark, sf), max_items=50)


@query("l8_benchmark_head")
def l8(spark, sf):
    return L.head_n(A.v_tests(spark, sf), 164, ["task_id"]).select("task_id", "test")


@query("o1_seeded_shuffle")
def o1(spark, sf):
    """O1: every sample's key and its place in the seeded order."""
    return L.seeded_positions(_samples(spark, sf).select("seq"), "seq", 42)


@query("o2_train_eval_split")
def o2(spark, sf):
    return L.train_eval_split(_samples(spark, sf), "seq").select("seq", "split")


# --- scalar text functions ---------------------------------------------------------

def _scalar(name, fn):
    def q(spark, sf):
        s = _samples(spark, sf)
        return s.select("seq", fn().alias(name))
    return q


QUERIES["c1_classify_problem"] = _scalar("problem_class", lambda: R.classify_problem("instruction"))
QUERIES["c2_determine_action"] = _scalar("action", lambda: R.determine_action("instruction"))
QUERIES["c3_generate_strategy"] = _scalar("strategy", lambda: R.generate_strategy("instruction"))
QUERIES["c4_generate_consideration"] = _scalar("consideration", lambda: R.generate_consideration("instruction"))
QUERIES["c5_should_use_tools"] = _scalar("use_tools", lambda: R.should_use_tools("instruction"))
QUERIES["c6_tool_call"] = _scalar("tool_call", lambda: TL.tool_call_json("instruction", "input", "output"))
QUERIES["c7_extract_file_path"] = _scalar("file_path", lambda: TL.extract_file_path("input"))
QUERIES["c8_extract_pattern"] = _scalar("pattern", lambda: TL.extract_pattern("instruction"))
QUERIES["c9_extract_github_url"] = _scalar("github_url", lambda: TL.extract_github_url("input"))
QUERIES["c10_summarize_problem"] = _scalar("problem", lambda: R.summarize_problem("input"))
QUERIES["c11_summarize_input"] = _scalar("input_summary", lambda: R.summarize_input("input"))
QUERIES["c12_reasoning_steps"] = _scalar(
    "steps", lambda: RS.reasoning_steps(R.classify_problem("instruction"), "instruction"))
QUERIES["c13_reasoning_output"] = _scalar("reasoning", lambda: RS.reasoning_output("instruction", "output"))
QUERIES["c14_chain_of_thought"] = _scalar("cot", lambda: RS.chain_of_thought("output", "instruction", "input"))


@query("c15_transform_v1")
def c15(spark, sf):
    return RS.transform_v1(_samples(spark, sf))


@query("c16_transform_v2")
def c16(spark, sf):
    return RS.transform_v2(_samples(spark, sf))


@query("c17_transform_with_tools")
def c17(spark, sf):
    return RS.transform_v2_tools(_samples(spark, sf))


@query("c19_prompt_render")
def c19(spark, sf):
    s = _samples(spark, sf)
    style = A.pick(["inst", "chat", "cot", "other"], F.col("seq") % 4)
    return s.select("seq", style.alias("style"), "instruction", "input", "output") \
        .select("seq", "style", PR.render_prompt_by_column("style").alias("prompt"))


@query("c20_chat_request")
def c20(spark, sf):
    s = _samples(spark, sf)
    i = F.when(F.col("seq") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("instruction"))
    return s.select("seq", PR.render_chat_request(i, "input").alias("request_prompt"),
                    SC.render_default_prompt(T.s("instruction"), T.s("input")).alias("eval_prompt"))


@query("c21_request_compose")
def c21(spark, sf):
    s = _samples(spark, sf)
    return s.select("seq", PR.compose_request(A.pick(A.PHRASES, F.col("seq") % 16), "input")
                    .alias("request_instruction"))


@query("c22_extract_code")
def c22(spark, sf):
    g = A.v_generations(spark, sf)
    return g.select("gen", SC.extract_code("text", "python").alias("code_python"),
                    SC.extract_code("text", "kotlin").alias("code_kotlin"))


@query("c23_prompt_echo_removal")
def c23(spark, sf):
    s = _samples(spark, sf)
    prompt = SC.render_default_prompt(T.s("instruction"), T.s("input"))
    generated = F.concat(prompt, T.s("output"))
    return s.select("seq", SC.remove_prompt_echo(generated, prompt).alias("generated_text"))


@query("c24_parse_repo_url")
def c24(spark, sf):
    u = A.v_urls(spark, sf)
    p = PR.parse_repo_url("url")
    return u.select("url_id", p["owner"].alias("owner"), p["repo"].alias("repo"))


@query("c25_resolve_repo")
def c25(spark, sf):
    u = A.v_urls(spark, sf)
    return u.select("url_id", PR.resolve_repo("url", "my-model").alias("repo_id"))


@query("c26_fixed_length_rows")
def c26(spark, sf):
    t = A.v_token_ids(spark, sf)
    cols = PR.fixed_length("tokens", max_seq=2048, pad_id=0)
    return t.select("id", *[v.alias(k) for k, v in cols.items()])


@query("c27_identifier_rewrite")
def c27(spark, sf):
    s = _samples(spark, sf)
    return s.select("seq", PR.rewrite_identifiers("output").alias("rewritten"))


# --- generators ---------------------------------------------------------------------

@query("g1_template_grid")
def g1(spark, sf):
    return G.template_grid(A.read(spark, sf, "events").select("event_id"), "event_id")


@query("g2_example_bank")
def g2(spark, sf):
    return G.example_bank(A.read(spark, sf, "events").select("event_id"), "event_id")


# --- composed jobs -----------------------------------------------------------------

@query("w1_merge")
def w1(spark, sf):
    return W.merge(W.merge_inputs(spark, sf))


@query("w2_process_and_merge")
def w2(spark, sf):
    return W.process_and_merge(A.v_named_sources(spark, sf))


@query("w3_tree_samples")
def w3(spark, sf):
    files = A.v_files(spark, sf).where(SN.has_extension(SN.TREE_EXTS) & SN.name_has_no_skip_word(SN.TREE_SKIP_WORDS))
    return SN.task_fanout(SN.tree_chunks(files).select("path", "chunk_no", "chunk"))


@query("w4_thread_samples")
def w4(spark, sf):
    return TH.thread_samples(A.v_thread_items(spark, sf), A.v_thread_comments(spark, sf))


@query("w5_reasoning_v1")
def w5(spark, sf):
    """W5 as a job: lenient scan of a written dataset, transform, sink, read back."""
    src, out = _sample_file(spark, sf), _scratch(spark, "reasoning_v1", sf)
    JB.reasoning_files(spark, src, out, version="v1")
    return _placed(spark, out)


@query("w6_reasoning_v2")
def w6(spark, sf):
    """W6 as a job, with tool prompts."""
    src, out = _sample_file(spark, sf), _scratch(spark, "reasoning_v2", sf)
    JB.reasoning_files(spark, src, out, version="v2", tools=True)
    return _placed(spark, out)


@query("w6b_reasoning_v2_head")
def w6b(spark, sf):
    """W6 with its ``--limit``: the first 100 parseable lines in file order, then the transform."""
    src, out = _sample_file(spark, sf), _scratch(spark, "reasoning_head", sf)
    JB.reasoning_files(spark, src, out, version="v2", limit=100)
    return _placed(spark, out)


@query("w7_training_rows")
def w7(spark, sf):
    return W.training_rows(_samples(spark, sf), A.v_token_ids(spark, sf), max_seq=2048)


@query("w8_benchmark_scoring")
def w8(spark, sf):
    return W.score_benchmarks(A.v_generations(spark, sf), A.v_tests(spark, sf))


@query("w9_problem_conversion")
def w9(spark, sf):
    """W9 as a job: a train and a test dump, P12 on each, appended to two sinks, then concatenated."""
    problems = A.v_problems(spark, sf).select("item_id", "question", "solutions", "difficulty")
    train, test, out = (_scratch(spark, n, sf) for n in ("problems_train", "problems_test", "problems_out"))
    problems.where("item_id % 2 = 0").orderBy("item_id").write.json(train)
    problems.where("item_id % 2 = 1").orderBy("item_id").write.json(test)
    JB.problems_to_samples(spark, train, test, out, job_id="problems")
    JB.problems_to_samples(spark, train, test, out, job_id="problems")  # a retry of a finished job adds nothing
    return _placed(spark, f"{out}/combined")


@query("w10_repo_snippets")
def w10(spark, sf):
    return SN.snippet_samples_multi(A.v_files(spark, sf), SN.SNIPPET_SOURCES)


# --- remaining inventory rows ---------------------------------------------------------

@query("f10_snippet_and_chunk_length")
def f10(spark, sf):
    """snippet longer than 100 chars / chunk whose stripped text is longer than 20."""
    f = A.v_files(spark, sf).select("path", "content", T.head_lines("content", 40).alias("snippet"))
    return f.select("path", (F.length("snippet") > 100).alias("snippet_ok"),
                    (F.length(T.py_strip("content")) > SN.CHUNK_MIN_STRIPPED).alias("chunk_ok"))


@query("f12_discussion_body_length")
def f12(spark, sf):
    """discussions whose body is longer than 50 characters."""
    items = A.v_thread_items(spark, sf)
    return items.where(F.length(T.s("body")) > 50).select("item_id")


@query("j5_chunk_task_fanout")
def j5(spark, sf):
    """Every chunk x the four-task list (a literal array, exploded per row)."""
    return SN.task_fanout(SN.min_chunks(A.v_files(spark, sf), window=40).select("path", "chunk_no", "chunk"))


@query("o2b_exact_split")
def o2b(spark, sf):
    """O2 exact-count mode: exactly ceil(5% of n) eval rows, smallest (hash, id) first."""
    return L.exact_train_eval_split(_samples(spark, sf).select("seq"), "seq")


# --- sources through real files ---------------------------------------------------
# Files are derived by Spark from the given tables into a scratch folder under
# spark.checkpoint.dir, a new one for every call,
# then read back through the sources.  A job's input files are gzip JSONL, its output plain.

def _scratch(spark: SparkSession, name: str, sf: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}/{name}"


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The samples of a written dataset with their places (from 1) in its file order; the parts are read as they lie, not sorted again."""
    return J.read_placed(spark, path).select("place", *SAMPLE_FIELDS)


def _sample_file(spark: SparkSession, sf: str, path: str | None = None) -> str:
    """The samples as a JSONL dataset whose file order is the order of ``seq``."""
    path = path or _scratch(spark, "samples", sf)
    J.write_jsonl(_samples(spark, sf), path, order=["seq"], compression="gzip")
    return path


_RAW_WITH_SEQ = "seq long, " + ", ".join(f"{f} string" for f in
                                         ["instruction", "input", "output", "prompt", "completion", "text", "code",
                                          "question", "solutions"])


@query("s1_s4_jsonl_strict_roundtrip")
def s1(spark, sf):
    """S4 sink then S1 strict scan: null fields are written as missing keys; rows
    with neither instruction nor prompt are dropped on the way back (F2)."""
    path = _scratch(spark, "s1_jsonl", sf)
    raw = A.v_raw(spark, sf).drop("dataset")
    J.write_jsonl(raw, path, fields=raw.columns, layout="spark")
    back = J.read_jsonl_strict(spark, path, spark.createDataFrame([], _RAW_WITH_SEQ).schema)
    return back.drop(*J.ORDER_COLUMNS)


def _lines_with_rejects(spark, sf) -> str:
    """JSONL text with a blank line every 23rd row, a truncated one every 17th, and of 19 rows one each with
    trailing text, a second object, a surrounding array, a comment, single quotes, and a repeated key (which is valid)."""
    path = _scratch(spark, "s2_jsonl_lines", sf)
    raw = A.v_raw(spark, sf).drop("dataset")
    js = F.to_json(F.struct(*raw.columns))
    line = (F.when(F.col("seq") % 23 == 7, F.lit(""))
            .when(F.col("seq") % 17 == 5, F.expr("substring(__j, 1, length(__j) - 1)"))
            .when(F.col("seq") % 19 == 3, F.concat("__j", F.lit(" junk")))
            .when(F.col("seq") % 19 == 8, F.concat("__j", F.lit(" "), "__j"))
            .when(F.col("seq") % 19 == 11, F.concat(F.lit("["), "__j", F.lit("]")))
            .when(F.col("seq") % 19 == 14, F.concat("__j", F.lit(" // note")))
            .when(F.col("seq") % 19 == 5, F.concat("__j", F.lit("],["), "__j"))
            .when(F.col("seq") % 19 == 6, F.concat("__j", F.lit("] x }")))
            .when(F.col("seq") % 19 == 16, F.expr("""substring(__j, 1, length(__j) - 1) || ',"prompt":"first","prompt":"again"}'"""))
            .when(F.col("seq") % 19 == 17, F.replace("__j", F.lit('"'), F.lit("'")))
            .otherwise(F.col("__j")))
    raw.withColumn("__j", js).orderBy("seq").select(line.alias("value")).write.mode("overwrite").text(path)
    return path


@query("s2_jsonl_lenient_scan")
def s2(spark, sf):
    """Malformed and blank lines silently dropped, no field filter."""
    path = _lines_with_rejects(spark, sf)
    back = J.read_jsonl_lenient(spark, path, spark.createDataFrame([], _RAW_WITH_SEQ).schema)
    return back.select("seq", "instruction", "prompt")


@query("s3_rejected_lines")
def s3(spark, sf):
    """S3: the malformed lines, identified by the seq they carry."""
    bad = J.rejected_lines(spark, _lines_with_rejects(spark, sf))
    seq = F.regexp_extract("_corrupt", r"""["']seq["']:([0-9]+)""", 1).cast("bigint")
    # the lines lie in the order of seq over several files: a line's number in its file, and the file's least line
    first = F.min(F.col("seq") - F.col("line_no")).over(Window.partitionBy("file_path"))
    found = bad.select(seq.alias("seq"), "line_no", "file_path")
    return found.withColumn("in_order", F.col("seq") - F.col("line_no") == first).select("seq", "in_order")


@query("s6_s7_tree_scan")
def s6(spark, sf):
    """A tree with a folder per source, scanned whole and with three folders never descended into."""
    root, pruned = _scratch(spark, "tree", sf), ["source=src1", "source=src4", "source=src9"]
    A.read(spark, sf, "documents").select("text", "source").write.partitionBy("source").text(root)
    scans = [TR.scan_tree(spark, root, exts=[".txt"], pruned=p).withColumn("scan", F.lit(n)) for n, p in (("whole", None), ("pruned", pruned))]
    both = scans[0].unionByName(scans[1])
    return both.groupBy("scan", "repo").agg(F.sum("length").alias("bytes"), F.sum(F.length("content")).cast("bigint").alias("chars"))


@query("s9_s10_parquet_grid")
def s9(spark, sf):
    """S10 partitioned parquet sink, then S9 one read over the lang x split grid
    with partition pruning, feeding P21."""
    path = _scratch(spark, "s9_grid", sf)
    REG.write_partitioned_parquet(A.v_code_doc(spark, sf).select(
        "seq", "lang", "split", "func_code_string", "func_documentation_string", "repository_name"), path, by=["lang", "split"])
    grid = REG.read_partitioned_parquet(spark, path, langs=["python", "go", "ruby"], splits=["train", "test"])
    return C.function_doc_multilang(grid)


@query("s5_append_sink")
def s5(spark, sf):
    """Two writes to one sink, the second one appended."""
    path = _scratch(spark, "s5_samples", sf)
    for odd, mode in ((0, "overwrite"), (1, "append")):
        J.write_jsonl(_samples(spark, sf).where(F.col("seq") % 2 == odd), path, mode=mode, order=["seq"])
    return _placed(spark, path)


@query("s11_concat_files")
def s11(spark, sf):
    """The lines of two datasets, one after the other, in a third."""
    parts, out = [_sample_file(spark, sf), _scratch(spark, "s11_raw", sf)], _scratch(spark, "s11_out", sf)
    J.write_jsonl(C.keep_nonempty(C.normalize_routed(A.v_raw(spark, sf))), parts[1], order=["seq"], compression="gzip")
    J.concat_files(spark, parts, out)
    return _placed(spark, out)


@query("s12_s15_file_inventory")
def s12(spark, sf):
    """The registry's datasets and their lines; three of them are written first."""
    data = _scratch(spark, "data", sf)
    for k, name in enumerate(["apps_train", "github_code", "mbpp_extra"]):
        J.write_jsonl(_samples(spark, sf).where(F.col("seq") % 3 == k), f"{data}/{name}.jsonl")
    return REG.inventory(spark, data).select("group", "name", "lines", "status", "reg_ord")


@query("s13_merge_files")
def s13(spark, sf):
    """S13 and W1 as a job: a registered key, a path and an absent key are resolved; the files
    found go through strict scan, routing, filter, keep-first dedup and sink."""
    data, out = _scratch(spark, "data", sf), _scratch(spark, "merged", sf)
    raw = A.v_raw(spark, sf).drop("dataset")
    J.write_jsonl(raw, f"{data}/codealpaca.jsonl", fields=raw.columns, layout="spark", order=["seq"], compression="gzip")
    JB.merge_files(spark, ["codealpaca", "absent", _sample_file(spark, sf)], out, data_dir=data)
    return _placed(spark, out)


@query("s4_ordered_sink")
def s4(spark, sf):
    """Rows that lie in hash order are written in the order of ``seq``; each line's place in the files."""
    path = _scratch(spark, "s4_ordered", sf)
    J.write_jsonl(_samples(spark, sf).repartition("instruction"), path, order=["seq"])
    return _placed(spark, path)


@query("w1b_merge_counts")
def w1b(spark, sf):
    """W1 as a job with its A9 counts as the write itself collects them."""
    data, out = _scratch(spark, "data", sf), _scratch(spark, "merged", sf)
    raw = A.v_raw(spark, sf).drop("dataset")
    J.write_jsonl(raw, f"{data}/mbpp.jsonl", fields=raw.columns, layout="spark", order=["seq"], compression="gzip")
    told = JB.merge_files(spark, ["mbpp", _sample_file(spark, sf)], out, data_dir=data, job_id="merge")
    again = JB.merge_files(spark, ["mbpp", _sample_file(spark, sf)], out, data_dir=data, job_id="merge")
    rows = [(k, v) for k, v in {"written": told["written"], "retried": again["written"], "loaded": told["loaded"]["rows"],
                                "loaded:0": told["loaded"]["dataset_0"], "loaded:1": told["loaded"]["dataset_1"],
                                "after_filter": told["after_filter"]["rows"], "after_dedup": told["after_dedup"]["rows"]}.items()]
    return spark.createDataFrame(rows, "stage string, rows long")


def _line(columns: list, fields: list[str]):
    """The JSON line of the ``fields`` among ``columns``, null where all of them are."""
    row = F.struct(*columns)
    values = [row[f] for f in fields]
    return F.when(F.coalesce(*[v.cast("string") for v in values]).isNotNull(), F.to_json(F.struct(*[v.alias(f) for f, v in zip(fields, values)])))


def _named_files(spark: SparkSession, sf: str) -> list[str]:
    """The named sources as JSONL datasets in the order of ``seq``; those that ``documents`` gives come from one sort of it."""
    data, named = _scratch(spark, "named", sf), A.v_named_sources(spark, sf)
    lines = {f"{k}-{A.NAMED_SOURCES[k]}": _line(columns(), ["seq", *fields]) for k, (columns, fields) in A.DOCUMENT_SOURCES.items()}
    found = list(J.write_jsonl_files(A.read(spark, sf, "documents"), f"{data}/documents", lines, ["doc_id"], compression="gzip").values())
    paths = dict(zip(A.DOCUMENT_SOURCES, found))
    for k, name in enumerate(A.NAMED_SOURCES):
        if k not in paths:
            # the folder gives a file its name; equal names stand in folders of their own
            paths[k] = f"{data}/{k}/{name}"
            rows = named.where(F.col("dataset_ord") == k)
            fields = [c for c in rows.columns if c not in ("dataset_ord", "dataset")]
            J.write_jsonl(rows, paths[k], fields=fields, layout="spark", order=["seq"], compression="gzip")
    return [paths[k] for k in sorted(paths)]


@query("w2b_process_file_order")
def w2b(spark, sf):
    """W2 as a job over five written files: each kept sample's place in the output's files."""
    out = _scratch(spark, "processed", sf)
    JB.process_files(spark, _named_files(spark, sf), out)
    return _placed(spark, out)


@query("s14_results_sink")
def s14(spark, sf):
    """S14 and W8 as a job: generation and test dumps are scored; the results sink is read back."""
    gens, tests, out = (_scratch(spark, n, sf) for n in ("generations", "tests", "scores"))
    A.v_generations(spark, sf).write.json(gens)
    A.v_tests(spark, sf).write.json(tests)
    JB.score(spark, gens, tests, out, fallback_ckpt=shared_dir(spark))
    found = spark.read.schema("benchmark string, model string, task_id long, prompt string, num_passed long, total long, "
                              "passed boolean, problem_results array<struct<code:string,passed:boolean>>").json(f"{out}/results")
    return found.select("benchmark", "model", "task_id", "prompt", "num_passed", "total", "passed",
                        F.col("problem_results.code").alias("first_codes"), F.col("problem_results.passed").alias("first_passed"))
