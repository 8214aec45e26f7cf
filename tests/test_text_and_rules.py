"""Python string semantics (M1-M10) and keyword rules."""

from pyspark.sql import functions as F

from samplesmith.functions import rules as R
from samplesmith.functions import text as T
from samplesmith.functions import tools as TL


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_strip_matches_python(spark):
    for v in ["\n a \t", "\x1c　x y\t", "  ", "", "a "]:
        assert one(spark, T.py_strip("x"), v) == v.strip()


def test_code_point_slicing(spark):
    assert one(spark, T.head("x", 2), "a😀bc") == "a😀"
    assert one(spark, F.length("x"), "a😀bc") == 4


def test_split_keeps_trailing_part(spark):
    assert one(spark, T.lines("x"), "a\nb\n") == "a\nb\n".split("\n")
    assert one(spark, T.lines("x"), "") == [""]


def test_after_first_newline_and_first_line(spark):
    assert one(spark, T.first_line("x"), "ab\ncd\nef") == "ab"
    assert one(spark, T.after_first_newline("x"), "ab\ncd\nef") == "cd\nef"
    assert one(spark, T.first_line("x"), "abc") == "abc"


def test_first_nonempty(spark):
    df = spark.createDataFrame([(None, "", "z"), ("", None, None)], "a string, b string, c string")
    r = df.select(T.first_nonempty("a", "b", "c").alias("r")).collect()
    assert [x.r for x in r] == ["z", ""]


def test_normalize_newlines(spark):
    assert one(spark, T.normalize_newlines("x"), "a\r\nb\rc") == "a\nb\nc"


def test_line_chunks(spark):
    text = "\n".join(f"l{i}" for i in range(50))
    chunks = one(spark, T.line_chunks("x", 40), text)
    assert [c.count("\n") + 1 for c in chunks] == [40, 10]
    assert one(spark, T.line_chunks("x", 2), "line1\nline2\nline3\n") == ["line1\nline2", "line3\n"]
    assert len(one(spark, T.line_chunks("x", 30), "\n".join("x" * 100))) == 4


def test_classes_cover_all_six(spark):
    rows = [("Write a sort",), ("Fix this",), ("Explain this code",), ("Optimize loop",), ("Find the key",), ("Hello",)]
    got = [r.c for r in spark.createDataFrame(rows, "i string").select(R.classify_problem("i").alias("c")).collect()]
    assert got == ["code_generation", "bug_fix", "explanation", "optimization", "search", "general"]


def test_substring_keywords(spark):
    # "api" hits "rapid", "read" hits "thread" (substring, not word-bounded)
    assert one(spark, R.should_use_tools("x"), "a rapid change") is True
    assert one(spark, R.should_use_tools("x"), "the thread") is True
    assert one(spark, R.should_use_tools("x"), "Explain what this does") is False


def test_actions_strategy_consideration(spark):
    assert one(spark, R.determine_action("x"), "Please debug") == "debug existing code"
    assert one(spark, R.generate_strategy("x"), "create it") == "write the code from scratch following best practices"
    assert one(spark, R.generate_consideration("x"), "sort and find") == "empty lists, single elements, duplicate values"
    assert one(spark, R.generate_consideration("x"), "zzz") == "basic functionality, edge cases, error handling"


def test_summaries(spark):
    assert one(spark, R.summarize_problem("x"), None) == "process the given instruction"
    assert one(spark, R.summarize_problem("x"), " a\nb ") == "a b"
    assert one(spark, R.summarize_input("x"), "") == "no additional input provided"
    assert one(spark, R.summarize_input("x"), "y" * 90) == "y" * 80


def test_extractors(spark):
    assert one(spark, TL.extract_file_path("x"), 'open "src/app.py" and lib/b.py') == "src/app.py"
    assert one(spark, TL.extract_file_path("x"), "see lib/b.py") == "lib/b.py"
    assert one(spark, TL.extract_file_path("x"), "nothing") is None
    assert one(spark, TL.extract_pattern("x"), "  find foo") == "def find"
    assert one(spark, TL.extract_pattern("x"), "") == "def .*"
    assert one(spark, TL.extract_github_url("x"), "at github.com/a-b/c_d now") == "https://github.com/a-b/c_d"
    assert one(spark, TL.extract_github_url("x"), "https://GitHub.io/x") == "https://GitHub.io/x"
    assert one(spark, TL.extract_github_url("x"), "https://example.com/x") is None


def test_tool_call_parses(spark):
    import json
    df = spark.createDataFrame([("Fetch the api", "", "out"), ("Read the file", 'open "a/b.py"', "o"),
                                ("Save it", "", "x" * 300), ("Search code", "", ""), ("Clone repo", "", ""),
                                ("Do it", "", "")], "i string, x string, o string")
    calls = [json.loads(r.c) for r in df.select(TL.tool_call_json("i", "x", "o").alias("c")).collect()]
    assert calls[0] == {"tool": "web_search", "args": {"query": "Fetch the api"}}
    assert calls[1] == {"tool": "file_reader", "args": {"path": "a/b.py", "lines": 50}}
    assert calls[2]["args"] == {"path": "output.py", "content": "x" * 200}
    assert calls[3] == {"tool": "code_search", "args": {"pattern": "def Search", "path": "."}}
    assert calls[4] == {"tool": "git_clone", "args": {"repo_url": "https://github.com/example/repo"}}
    assert calls[5] == {"tool": "python_executor", "args": {"code": "pass"}}


def test_parse_tool_call(spark):
    df = spark.createDataFrame([("Read the file", 'see "a/b.py"', "o")], "i string, x string, o string")
    r = df.select(TL.parse_tool_call(TL.tool_call_json("i", "x", "o")).alias("c")).first().c
    assert r.tool == "file_reader" and r.args == {"path": "a/b.py", "lines": "50"}


def test_tool_catalogue_has_six_tools():
    import json
    assert [t["name"] for t in json.loads(TL.TOOL_CATALOGUE_JSON)] == [
        "python_executor", "file_reader", "file_writer", "web_search", "git_clone", "code_search"]
