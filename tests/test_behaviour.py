"""Behaviour checks covering the same ground as the source project's unit
suite (rules, tools, templates, converters, chunking), on our operators."""

import json

import pytest
from pyspark.sql import functions as F

from samplesmith.functions import rules as R
from samplesmith.functions import tools as TL
from samplesmith.operators import convert as C
from samplesmith.operators import prompts as PR
from samplesmith.operators import reasoning as RS
from samplesmith.operators import scoring as SC
from samplesmith.operators import snippets as SN
from samplesmith.sources import registry as REG

S = "seq long, instruction string, input string, output string"


def val(spark, col, *row, schema="i string"):
    return spark.createDataFrame([row], schema).select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("inst,action", [
    ("Write a parser", "create new code"), ("Implement it", "create new code"), ("Fix the crash", "debug existing code"),
    ("There is a bug", "debug existing code"), ("Describe the flow", "explain code"), ("Improve speed", "optimize code"),
    ("Search for uses", "find/search code"), ("Hello there", "process the request")])
def test_determine_action(spark, inst, action):
    assert val(spark, R.determine_action("i"), inst) == action


@pytest.mark.parametrize("inst,strategy", [
    ("create a class", "write the code from scratch following best practices"),
    ("bug in loop", "identify and fix the issue"), ("explain this", "explain the code clearly with examples"),
    ("optimize query", "improve performance and readability"), ("describe", "generate appropriate solution")])
def test_generate_strategy(spark, inst, strategy):
    assert val(spark, R.generate_strategy("i"), inst) == strategy


@pytest.mark.parametrize("inst,cons", [
    ("search the list", "element not found, empty input"), ("reverse words", "empty strings, single characters"),
    ("validate input", "invalid input, edge cases, error handling")])
def test_generate_consideration(spark, inst, cons):
    assert val(spark, R.generate_consideration("i"), inst) == cons


def test_summaries_long_text(spark):
    text = "line one\n" + "x" * 200
    got = val(spark, R.summarize_problem("i"), text)
    assert len(got) <= 100 and "\n" not in got and got.startswith("line one x")


def test_tool_definitions_schema():
    tools = {t["name"]: t for t in json.loads(TL.TOOL_CATALOGUE_JSON)}
    assert len(tools) == 6
    for t in tools.values():
        assert t["description"] and t["input_schema"]["type"] == "object"
    assert tools["python_executor"]["input_schema"]["required"] == ["code"]
    assert tools["file_reader"]["input_schema"]["required"] == ["path"]
    assert tools["web_search"]["input_schema"]["required"] == ["query"]
    assert tools["file_writer"]["input_schema"]["required"] == ["path", "content"]


@pytest.mark.parametrize("inst,inp,tool,args", [
    ("Fetch data from the API", "https://x.io/api", "web_search", {"query": "https://x.io/api"}),
    ("Read config file", "edit 'cfg/settings.py' now", "file_reader", {"path": "cfg/settings.py", "lines": 50}),
    ("Find the handler", "", "code_search", {"pattern": "def Find", "path": "."}),
    ("Clone the repository", "see github.com/octo/hello-world", "git_clone", {"repo_url": "https://github.com/octo/hello-world"}),
])
def test_tool_call_branches(spark, inst, inp, tool, args):
    row = spark.createDataFrame([(inst, inp, "out")], "i string, x string, o string")
    call = json.loads(row.select(TL.tool_call_json("i", "x", "o")).first()[0])
    assert call == {"tool": tool, "args": args}


@pytest.mark.parametrize("inst,cls,approach", [
    ("Write a sorter", "code_generation", "Write clean, efficient code following best practices"),
    ("Fix this bug", "bug_fix", "Identify the bug and understand the root cause"),
    ("Explain the module", "explanation", "Explain the code clearly with examples"),
    ("Optimize the loop", "optimization", "Identify performance bottlenecks")])
def test_reasoning_step_formats(spark, inst, cls, approach):
    steps = val(spark, RS.reasoning_steps(R.classify_problem("i"), "i"), inst)
    assert steps.startswith("Let me analyze this step by step:\n1. Problem: " + inst)
    assert f"2. Approach: {approach}" in steps
    assert all(f"{k}. " in steps for k in range(1, 5))


def test_reasoning_output_preserves_original(spark):
    out = val(spark, RS.reasoning_output("i", "o"), "Write a function", "def f(): return 1", schema="i string, o string")
    assert out.startswith("## Problem Analysis\n") and "\n\ndef f(): return 1\n\n" in out
    assert out.endswith("## Execution Trace\n```\n-> Initializing...\n-> Processing input...\n-> Generating output...\n-> Complete!\n```\n")
    prose = val(spark, RS.reasoning_output("i", "o"), "Explain", "It adds two numbers.", schema="i string, o string")
    assert prose.endswith("It adds two numbers.\n\n")


def test_transform_many_samples(spark):
    rows = [(k, ["Write x", "Fix y", "Explain z", "Search q"][k % 4], f"in{k}", "o" * (5 + k)) for k in range(20)]
    out = RS.transform_v2(spark.createDataFrame(rows, S)).orderBy("seq").collect()
    assert [r.seq for r in out] == list(range(5, 20))  # outputs shorter than 10 are dropped
    assert all(r.instruction == rows[r.seq][1] and r.input == rows[r.seq][2] for r in out)


def test_system_prompt_sections():
    assert "## Available Tools" in RS.SYSTEM_PROMPT_V2 and "## Chain-of-Thought Reasoning" in RS.SYSTEM_PROMPT_V2
    for name in ("python_executor", "file_reader", "file_writer", "web_search"):
        assert name in RS.SYSTEM_PROMPT_V2


def test_cot_v1_structure(spark):
    df = spark.createDataFrame([(1, "Write a sort", "", "result = sorted(xs)")], S)
    out = RS.transform_v1(df, add_tools=False).first()
    assert out.instruction == "Write a sort" and out.input == ""
    assert out.output.startswith("Let me analyze this problem step by step:\nStep 1: Understand what needs to be done - "
                                 "process the given instruction\nStep 2: Determine the approach - write the code")
    assert "Execution trace" not in out.output  # no def/class/import marker
    assert out.output.endswith("\nBased on this reasoning:\n\nresult = sorted(xs)")


def test_default_prompt_and_templates(spark):
    row = spark.createDataFrame([("Do", "data", "ans")], "instruction string, input string, output string")
    assert row.select(SC.render_default_prompt(F.col("instruction"), F.col("input"))).first()[0] == "[INST] Do\ndata [/INST]\n"
    chat = row.select(PR.render_prompt("chat")).first()[0]
    assert chat.startswith("<|system|>\n") and "<|user|>\nDo\ndata<|end|>\n<|assistant|>\nans" in chat
    empty = spark.createDataFrame([("", None, "ans")], "instruction string, input string, output string")
    assert empty.select(PR.render_prompt("inst")).first()[0] == "[INST] \n [/INST]\nans"
    for t in PR.PROMPT_TEMPLATES.values():
        assert all(k in t for k in ("{instruction}", "{input}", "{output}"))


def test_chat_request_defaults(spark):
    df = spark.createDataFrame([(None, None)], "instruction string, input string")
    got = df.select(PR.render_chat_request()).first()[0]
    assert got == PR.SERVICE_SYSTEM_PROMPT + "[INST] Answer this coding question.\n [/INST]\n"
    assert val(spark, PR.compose_request("i", "c"), "Explain", "Kotlin", schema="i string, c string") == "Explain Kotlin"


def test_repo_url_deep(spark):
    p = PR.parse_repo_url("i")
    assert val(spark, p["owner"], "https://github.com/a/b/tree/main") == "tree"
    assert val(spark, p["repo"], "git@host:org/repo.git") == "repo"


def test_thread_samples_empty_body(spark):
    items = spark.createDataFrame([(1, "T", None)], "item_id long, title string, body string")
    assert C.issue_samples(items).first().input == "Title: T\n\n"
    cm = spark.createDataFrame([(1, 0, None)], "parent_key long, ord long, body string")
    assert C.comment_samples(cm).first().input == ""


@pytest.mark.parametrize("row,ok", [
    ({"instruction": "x"}, True), ({"prompt": "p"}, True), ({}, False), ({"instruction": "", "prompt": ""}, False),
    ({"instruction": "", "prompt": "p"}, True)])
def test_validate_sample(spark, row, ok):
    df = spark.createDataFrame([(row.get("instruction"), row.get("prompt"))], "instruction string, prompt string")
    assert (df.where(C.validate_raw(df)).count() == 1) == ok


def test_dataset_groups():
    assert set(REG.DATASET_GROUPS) == {"core", "synthetic", "github", "extra", "codesearchnet"}
    assert sum(len(v) for v in REG.DATASET_GROUPS.values()) == 22
    assert REG.select_keys(all_=True)[-1] == "codesearchnet2"


def test_chunk_empty_and_large(spark):
    files = spark.createDataFrame([("r", "e.py", 0, ""), ("r", "big.py", 0, "\n".join(["code_line = 1"] * 1000))],
                                  "repo string, path string, length long, content string")
    chunks = SN.min_chunks(files, window=40).collect()
    assert all(c.path == "big.py" for c in chunks) and len(chunks) == 25


def test_process_file_size_bounds(spark):
    files = spark.createDataFrame([("r", "s.py", 0, "x = 1"), ("r", "l.py", 0, "y" * 50001), ("r", "ok.py", 0, "z = 2\n" * 20)],
                                  "repo string, path string, length long, content string")
    assert [r.path for r in files.where(SN.char_bound()).collect()] == ["ok.py"]
