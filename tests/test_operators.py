"""Literal-row tests of converters, dedup, limits, reasoning, chunks, threads
and scoring (the edge rows of FIXTURES.md)."""

import math

from pyspark.sql import functions as F

from samplesmith.operators import convert as C
from samplesmith.operators import dedup as D
from samplesmith.operators import limits as L
from samplesmith.operators import prompts as PR
from samplesmith.operators import reasoning as RS
from samplesmith.operators import scoring as SC
from samplesmith.operators import snippets as SN
from samplesmith.operators import threads as TH
from samplesmith.plans import merge as M

SAMPLE = "seq long, instruction string, input string, output string"


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("seq").collect()]


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([(2, "i", "x", "second"), (1, "i", "x", "first"), (3, "j", "x", "o")], SAMPLE)
    assert rows(D.dedup_wide(df), "seq", "output") == [(1, "first"), (3, "o")]


def test_dedup_counts(spark):
    same = spark.createDataFrame([(k, "i", "x", "o") for k in range(5)], SAMPLE)
    distinct = spark.createDataFrame([(k, f"i{k}", "x", "o") for k in range(5)], SAMPLE)
    empty = spark.createDataFrame([], SAMPLE)
    assert [D.dedup_wide(d).count() for d in (same, distinct, empty)] == [1, 5, 0]


def test_dedup_key_prefix_and_no_separator(spark):
    long_a, long_b = "a" * 200 + "X", "a" * 200 + "Y"
    df = spark.createDataFrame([(1, "i", long_a, ""), (2, "i", long_b, ""), (3, "ab", "c", ""), (4, "a", "bc", "")], SAMPLE)
    assert [r.seq for r in D.dedup_wide(df).orderBy("seq").collect()] == [1, 3]


def test_dedup_independent_of_partitioning(spark):
    data = [(k, f"i{k % 7}", f"x{k % 5}", str(k)) for k in range(200)]
    a = D.dedup_wide(spark.createDataFrame(data, SAMPLE).repartition(1))
    b = D.dedup_wide(spark.createDataFrame(data, SAMPLE).repartition(13))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_routing_shapes(spark):
    schema = "seq long, instruction string, prompt string, completion string, text string, code string"
    df = spark.createDataFrame([
        (1, None, "Title line\n  body  ", "done", None, None),
        (2, None, "one line prompt", "c", None, None),
        (3, "Do it", None, None, "t", "c"),
        (4, None, None, None, "t", "c"),          # neither instruction nor prompt: dropped (F2)
        (5, "", None, None, None, None),           # dropped (F2)
    ], schema)
    got = rows(C.normalize_routed(df), "seq", "instruction", "input", "output")
    assert got == [(1, "Title line", "body", "done"), (2, "one line prompt", "one line prompt", "c"), (3, "Do it", "t", "c")]


def test_merge_idempotent(spark):
    df = spark.createDataFrame([(k, f"i{k % 3}", "x", "o") for k in range(10)], SAMPLE)
    once = M.merge([df])
    twice = M.merge([once.select("seq", "instruction", "input", "output")])
    assert sorted(map(tuple, once.select("seq", "instruction").collect())) == \
        sorted(map(tuple, twice.select("seq", "instruction").collect()))


def test_problem_samples(spark):
    df = spark.createDataFrame([(1, "Q", '["sol"]', "def f(): pass"), (2, "Q", "[]", ""), (3, "Q", "bad json", "")],
                               "seq long, question string, solutions string, starter_code string")
    got = rows(C.apps_samples(df).withColumn("seq", F.col("seq") * 10 + F.col("sample_no")), "seq", "output")
    assert got == [(10, "sol"), (11, ""), (30, "bad json")]


def test_empty_inputs_give_no_samples(spark):
    cd = spark.createDataFrame([(1, "", "code", None), (2, "doc", "", ""), (3, "doc", "x = 1", None)],
                               "seq long, english_documentation string, code string, func_documentation_string string")
    got = rows(C.code_doc_explain(cd), "seq", "input")
    assert got == [(3, "Documentation:\ndoc\n\nCode:\nx = 1")]  # null doc string falls back to code
    fn = spark.createDataFrame([(1, "", "x"), (2, "p", "c")], "seq long, prompt string, canonical_solution string")
    assert [r.seq for r in C.function_completion(fn).collect()] == [2]
    tw = spark.createDataFrame([(1, "", "c"), (2, "t", "c")], "seq long, text string, code string")
    assert [r.seq for r in C.function_writing(tw).collect()] == [2]


def test_output_filter_and_trace(spark):
    df = spark.createDataFrame([(1, "Write x", "", ""), (2, "Write x", "", "ab"), (3, "Write x", "", "def f(): return 1"),
                                (4, "Explain", "", "plain prose here")], SAMPLE)
    out = rows(RS.transform_v2(df), "seq", "output")
    assert [s for s, _ in out] == [3, 4]
    assert "## Execution Trace" in out[0][1] and "## Execution Trace" not in out[1][1]
    assert out[0][1].startswith("## Problem Analysis\nLet me analyze this step by step:\n1. Problem: Write x\n")


def test_tools_flag(spark):
    df = spark.createDataFrame([(1, "Explain what this does", "", "x" * 20), (2, "Read a file", "in", "y" * 20)], SAMPLE)
    out = rows(RS.transform_v2_tools(df), "seq", "has_tools", "input")
    assert out == [(1, False, ""), (2, True, "in\n\nUse appropriate tools to complete this task.")]


def test_cot_v1(spark):
    df = spark.createDataFrame([(1, "Sort this list", "data\nmore", "import os\nprint(1)")], SAMPLE)
    r = RS.transform_v1(df).first()
    assert r.instruction == "Use Chain-of-Thought reasoning and available tools to complete this task."
    assert "Step 1: Understand what needs to be done - data more" in r.output
    assert "\nExecution trace:\n" in r.output
    assert r.output.endswith('{"tool": "python_executor", "args": {"code": "import os\\nprint(1)"}}\n```')
    assert r.input.startswith("data\nmore\n\n## Available Tools\n```json\n[\n  {")


def test_chunkers(spark):
    files = spark.createDataFrame([("r", "a.py", 0, "\n".join(f"line {i} here" for i in range(50))),
                                   ("r", "b.py", 0, "short")], "repo string, path string, length long, content string")
    c = SN.min_chunks(files, window=40)
    assert sorted((r.path, r.chunk.count("\n") + 1) for r in c.collect()) == [("a.py", 10), ("a.py", 40)]
    f = SN.task_fanout(SN.tree_chunks(files).select("path", "chunk_no", "chunk"))
    first = f.where("task_no = 0").select("instruction").first()[0]
    assert first == "Explain what this code does (py code)" and f.count() == 8


def test_file_filters(spark):
    df = spark.createDataFrame([("r", "src/a.py", 10), ("r", "build/b.py", 100), ("r", "src/build_c.py", 100),
                                ("r", "src/d.md", 100)], "repo string, path string, length long")
    ext = df.where(SN.has_extension(SN.TREE_EXTS) & SN.name_has_no_skip_word(SN.TREE_SKIP_WORDS))
    assert sorted(r.path for r in ext.collect()) == ["build/b.py", "src/a.py"]  # directories are not tested
    pruned = df.where(SN.not_in_pruned_dir(["build"]))
    assert "build/b.py" not in [r.path for r in pruned.collect()]
    assert df.where(SN.byte_bound(50, 50000)).count() == 3  # a 10-byte file is rejected


def test_threads(spark):
    items = spark.createDataFrame([(1, "Bug", None, None), (2, "PR", "b", ("u",))],
                                  "item_id long, title string, body string, pull_request struct<url:string>")
    comments = spark.createDataFrame([(1, k, "" if k == 0 else f"c{k}") for k in range(7)],
                                     "parent_key long, ord long, body string")
    out = TH.thread_samples(items, comments).orderBy("kind", "item_id", "ord").collect()
    assert out[0].input == "Title: Bug\n\n" and out[1].input == "" and len(out) == 1 + 5 + 1
    assert out[-1].instruction.startswith("Summarize, review")


def test_extract_code(spark):
    df = spark.createDataFrame([
        (1, "```python\ndef f():\n    return 1\n```"),
        (2, "```kotlin\nfun f() = 1\n```"),
        (3, "def f():\n    # comment\n    return 1"),
        (4, 'x = 1\n"""doc\nstill doc\n"""\ny = 2\n// c'),
        (5, 'a = 1\n  """one line"""\nhidden = 2\n\'\'\'\nb = 3\n"""unterminated\nc = 4'),
    ], "gen long, text string")
    py = {r.gen: r.c for r in df.select("gen", SC.extract_code("text").alias("c")).collect()}
    kt = {r.gen: r.c for r in df.select("gen", SC.extract_code("text", "kotlin").alias("c")).collect()}
    assert py[1] == "def f():\n    return 1"
    assert kt[2] == "fun f() = 1" and "fun f() = 1" in py[2]
    assert py[3] == "def f():\n    return 1"
    assert py[4] == "x = 1\ny = 2"
    assert py[5] == "a = 1\nb = 3"  # a one-line docstring still toggles; unterminated drops the rest


def test_unbiased_pass_at_k_matches_formula(spark):
    probs = [(n, c) for n in (5, 12, 20) for c in range(n + 1)]
    df = spark.createDataFrame([("b", "m", n, c) for n, c in probs], "benchmark string, model string, total long, num_passed long")
    got = SC.unbiased_pass_at_k(df, 3).first()["pass_at_3"]

    def est(n, c, k):
        return 1.0 if n - c < k else 1.0 - math.comb(n - c, k) / math.comb(n, k)
    want = sum(est(n, c, 3) for n, c in probs) / len(probs)
    assert abs(got - want) < 1e-9


def test_split_disjoint_and_complete(spark):
    df = spark.range(5000).withColumnRenamed("id", "seq")
    s = L.train_eval_split(df, "seq")
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts["train"] + counts["eval"] == 5000 and 150 < counts["eval"] < 350


def test_fixed_length(spark):
    df = spark.createDataFrame([(1, [5, 6, 7])], "id long, tokens array<int>")
    r = df.select(*[v.alias(k) for k, v in PR.fixed_length("tokens", 5).items()]).first()
    assert r.input_ids == [5, 6, 7, 0, 0] and r.attention_mask == [1, 1, 1, 0, 0] and r.labels == r.input_ids
    r2 = df.select(PR.fixed_length("tokens", 2)["input_ids"].alias("x")).first()
    assert r2.x == [5, 6]


def test_repo_urls(spark):
    df = spark.createDataFrame([("https://github.com/o/r.git",), ("https://github.com/o/r/",)], "u string")
    got = [(r.o, r.r) for r in df.select(PR.parse_repo_url("u")["owner"].alias("o"), PR.parse_repo_url("u")["repo"].alias("r")).collect()]
    assert got == [("o", "r"), ("o", "r")]
    rr = spark.createDataFrame([("https://hub.example/ns/model/tree",), ("ns",), ("",)], "u string")
    assert [r.x for r in rr.select(PR.resolve_repo("u", "m").alias("x")).collect()] == ["ns/model", "ns/m", ""]


def test_prompt_styles(spark):
    df = spark.createDataFrame([("i", "x", "o")], "instruction string, input string, output string")
    assert df.select(PR.render_prompt("inst")).first()[0] == "[INST] i\nx [/INST]\no"
    assert df.select(PR.render_prompt("nope")).first()[0] == "[INST] i\nx [/INST]\no"
    assert df.select(PR.render_prompt("cot")).first()[0].startswith("## Task\ni\n\n## Input\nx\n\n## Reasoning\n")


def test_seeded_shuffle_is_a_repeatable_permutation(spark):
    df = spark.range(300).withColumnRenamed("id", "seq")
    a = [r.seq for r in L.seeded_shuffle(df, "seq", 42).collect()]
    b = [r.seq for r in L.seeded_shuffle(df.repartition(7), "seq", 42).collect()]
    c = [r.seq for r in L.seeded_shuffle(df, "seq", 7).collect()]
    assert a == b and sorted(a) == list(range(300)) and a != list(range(300)) and a != c


def test_head_is_one_plan_for_any_count(spark):
    df = spark.range(20_000).select(F.col("id"), (F.col("id") * 7919 % 20_000).alias("k"))
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    for n in (1, 999, 10_000, 10_001, 30_000):
        assert sorted(r.k for r in L.head_n(df, n, ["k"]).collect()) == list(range(min(n, 20_000)))
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_exact_split_counts(spark):
    import math
    for n, size in [(1000, 0.05), (37, 0.05), (5000, 0.2), (3, 0.5), (3, 1.0), (3, 0.0), (0, 0.5)]:
        df = spark.range(n).withColumnRenamed("id", "seq")
        rows = L.exact_train_eval_split(df, "seq", size).withColumn("h", L.split_hash("seq")).collect()
        k = math.ceil(size * n)
        assert len(rows) == n and sum(r.split == "eval" for r in rows) == k
        assert {r.seq for r in rows if r.split == "eval"} == {r.seq for r in sorted(rows, key=lambda r: (r.h, r.seq))[:k]}


def test_exact_split_of_equal_hashes(spark, monkeypatch):
    monkeypatch.setattr(L, "split_hash", lambda c, seed=42: F.lit(70_000).cast("bigint"))
    rows = L.exact_train_eval_split(spark.range(50).withColumnRenamed("id", "seq"), "seq", 0.3).collect()
    assert {r.seq for r in rows if r.split == "eval"} == set(range(15))  # ties go by id


def test_missing_solutions_give_no_solve_sample(spark):
    rows = spark.createDataFrame([(1, "q", None, "x"), (2, "q", "", ""), (3, "q", '["a"]', ""), (4, "q", "[]", "")],
                                 "item_id long, question string, solutions string, starter_code string")
    got = sorted((r.item_id, r.sample_no, r.output) for r in C.apps_samples(rows).collect())
    assert got == [(1, 0, ""), (3, 0, "a")]


def test_extension_and_repository_and_unknown_class(spark):
    from samplesmith.operators import reasoning as RS
    from samplesmith.operators import snippets as SN
    names = spark.createDataFrame([("x/a..py",), ("x/.bashrc",), ("x/a",), ("x/..a.py",), ("a.tar.gz",)], "path string")
    assert [r[0] for r in names.select(SN.extension("path")).collect()] == ["py", "", "", "py", "gz"]
    code = "def f(): pass" + "x" * 60
    repos = spark.createDataFrame([("go", code, "", ""), ("go", code, "", None)],
                                  "lang string, func_code_string string, func_documentation_string string, repository_name string")
    assert [r.output for r in C.function_doc_multilang(repos).collect()] == ["Function from ", "Function from codebase"]
    steps = spark.range(1).select(RS.reasoning_steps(F.lit("no such class"), F.lit("i")).alias("a"),
                                  RS.reasoning_steps(F.lit("general"), F.lit("i")).alias("b")).first()
    assert steps.a == steps.b is not None


def test_json_lines_are_judged_as_json_loads_does(spark, tmp_path):
    import json
    from samplesmith.sources import jsonl as J
    lines = ['{"instruction": "a"}', "{'instruction': 'b'}", '{"instruction": "c"} junk', '{"instruction": "d"} {"instruction": "e"}',
             '{"instruction": "f"} // c', '{"instruction": "g", "instruction": "h"}', '{"instruction": "i"', "  ", "[1]", "nonsense",
             ' {"instruction": "j"} ', '{}', '{"instruction": "k",}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")

    def loads(s):
        try:
            return isinstance(json.loads(s), dict)
        except ValueError:
            return False
    path = str(tmp_path / "x.jsonl")
    schema = spark.createDataFrame([], "instruction string").schema
    good = [s for s in lines if loads(s)]
    assert J.read_jsonl_lenient(spark, path, schema).count() == len(good)
    bad = sorted(r._corrupt for r in J.rejected_lines(spark, path, schema).collect())
    assert bad == sorted(s for s in lines if s.strip() and not loads(s))


def test_scratch_is_new_for_every_call(spark):
    import __spark_entry__ as E
    from tests.conftest import SF
    a = E.queries()["s2_jsonl_lenient_scan"](spark, SF)
    E.queries()["s3_rejected_lines"](spark, SF).count()
    assert a.count() > 0
