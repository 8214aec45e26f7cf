"""Real file I/O: JSONL scans and sinks, tree scans, registry, streaming."""

import json
import os

from samplesmith.plans import jobs
from samplesmith.sources import jsonl as J
from samplesmith.sources import registry as REG
from samplesmith.sources import trees as TR
from samplesmith.streaming import reasoning as ST


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_blank_lines_and_missing_file(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    write(p, [json.dumps({"instruction": "i1", "input": "", "output": "o"}), "",
              json.dumps({"prompt": "p", "completion": "c"}), "{bad json", json.dumps({"input": "x"})])
    strict = J.read_jsonl_strict(spark, p)
    assert strict.count() == 2
    rej = J.rejected_lines(spark, p).collect()
    assert [(r.line_no, r._corrupt) for r in rej] == [(4, "{bad json")]
    assert J.read_jsonl_strict(spark, str(tmp_path / "missing.jsonl")).count() == 0
    assert J.read_jsonl_lenient(spark, p).count() == 3


def test_sink_lines_match_python_layout(spark, tmp_path):
    rows = [("Écris une fonction", "entrée\t\"x\"\\", "def f():\n    return 'ü' \x01"), ("a", "", "b")]
    df = spark.createDataFrame(rows, "instruction string, input string, output string")
    out = str(tmp_path / "sink")
    assert J.write_jsonl(df, out) == 2
    got = sorted(r.value for r in spark.read.text(out).collect())
    want = sorted(json.dumps({"instruction": a, "input": b, "output": c}, ensure_ascii=False) for a, b, c in rows)
    assert got == want
    assert J.read_jsonl_lenient(spark, out).count() == 2


def test_rejected_line_numbers_across_splits(spark, tmp_path):
    p = str(tmp_path / "big.jsonl")
    lines = [json.dumps({"instruction": f"row {k}", "input": "x" * 40, "output": ""}) for k in range(600)]
    for k in (3, 250, 599):
        lines[k] = "{broken " + str(k)
    lines[100] = ""
    write(p, lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits per file
    try:
        got = sorted((r.line_no, r._corrupt) for r in J.rejected_lines(spark, p).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(4, "{broken 3"), (251, "{broken 250"), (600, "{broken 599")]


def test_file_order_key(spark, tmp_path):
    p = str(tmp_path / "ordered.jsonl")
    write(p, [json.dumps({"instruction": f"i{k}", "input": "", "output": ""}) for k in range(500)])
    df = J.read_jsonl_strict(spark, p).orderBy(*J.FILE_ORDER)
    assert [r.instruction for r in df.collect()] == [f"i{k}" for k in range(500)]


def test_merge_files_end_to_end(spark, tmp_path):
    d = str(tmp_path / "data")
    write(f"{d}/one.jsonl", [json.dumps({"instruction": "same", "input": "x", "output": "first"}),
                             json.dumps({"instruction": "same", "input": "x", "output": "second"})])
    write(f"{d}/two.jsonl", [json.dumps({"prompt": "Title\nbody", "completion": "c"})])
    out = str(tmp_path / "out")
    res = jobs.merge_files(spark, ["one", "two", "absent"], out, data_dir=d)
    got = spark.read.json(out).collect()
    assert res["written"] == 2 and sorted(r.output for r in got) == ["c", "first"]
    assert res["loaded"]["rows"] == 3 and res["after_dedup"]["rows"] == 2


def test_merge_large_limit_uses_range_head(spark, tmp_path):
    d = str(tmp_path / "data")
    write(f"{d}/big.jsonl", [json.dumps({"instruction": f"i{k % 11000}", "input": "x", "output": str(k)})
                             for k in range(12_500)])
    out = str(tmp_path / "big_out")
    res = jobs.merge_files(spark, ["big"], out, data_dir=d, limit=10_500)   # above the top-k threshold
    got = sorted(int(r.output) for r in spark.read.json(out).collect())
    assert res["written"] == 10_500 and got == list(range(10_500))           # first occurrences, file order


def test_tree_scan(spark, tmp_path):
    root = tmp_path / "repos"
    write(str(root / "r1" / "src" / "a.py"), [f"print({k})  # line" for k in range(60)])
    write(str(root / "r1" / "build" / "b.py"), ["x = 1"] * 30)
    write(str(root / "r1" / "src" / "tiny.py"), ["x"])
    (root / "r1" / "src" / "c.js").write_bytes(b"var a = 1;\r\n\xff\xfevar b = 2;\r\n" * 10)
    files = TR.scan_tree(spark, str(root), exts=[".py", ".js"], max_bytes=50000)
    got = {r.path: r for r in files.collect()}
    assert set(got) == {"r1/src/a.py", "r1/build/b.py", "r1/src/tiny.py", "r1/src/c.js"}
    assert got["r1/src/c.js"].content.startswith("var a = 1;\nvar b = 2;\n")
    assert got["r1/src/a.py"].repo == "r1"
    plan = files.where("length < 100")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "length" in plan
    out = str(tmp_path / "tree_out")
    n = jobs.tree_to_samples(spark, str(root), out)
    assert n == 4 * (2 + 1 + 1)  # a.py: 2 chunks; b.py: 1; c.js: 1 -> four tasks each; tiny.py < 50 chars


def test_registry_inventory(spark, tmp_path):
    d = str(tmp_path / "data")
    write(f"{d}/mbpp.jsonl", ["{}", "", "{}"])
    inv = {r.name: (r.lines, r.status) for r in REG.inventory(spark, d).collect()}
    assert inv["mbpp"] == (3, "present") and inv["humaneval"] == (None, "MISSING") and len(inv) == 22
    spark.range(5).selectExpr("cast(id as string) as value").repartition(3).write.text(f"{d}/codealpaca.jsonl")
    assert {r.name: r.lines for r in REG.inventory(spark, d).collect()}["codealpaca"] == 5  # a folder of parts, as the sinks write it
    assert REG.select_keys()[:4] == ["apps_train", "codealpaca", "humaneval", "mbpp"]
    assert REG.select_keys(groups=["codesearchnet"]) == ["codesearchnet1", "codesearchnet2"]


def test_tree_stream_incremental(spark, tmp_path):
    from samplesmith.streaming import trees as STT
    root, out, ck = tmp_path / "incoming", str(tmp_path / "tree_out"), str(tmp_path / "tree_ck")
    write(str(root / "r" / "a.py"), [f"result_{k} = process({k})" for k in range(10)])
    STT.start_tree_stream(spark, str(root), out, checkpoint=ck).awaitTermination(120)
    assert spark.read.json(out).count() == 4
    write(str(root / "r" / "b.js"), [f"const value{k} = compute({k});" for k in range(10)])
    STT.start_tree_stream(spark, str(root), out, checkpoint=ck).awaitTermination(120)
    rows = spark.read.json(out).collect()
    hints = sorted(r.instruction for r in rows if r.instruction.startswith("Explain"))
    assert len(rows) == 8 and hints == ["Explain what this code does (js code)",
                                        "Explain what this code does (py code)"]  # a.py is not processed twice


def test_reasoning_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    write(f"{src}/part1.jsonl", [json.dumps({"instruction": "Write code", "input": "", "output": "def f(): pass"}),
                                 json.dumps({"instruction": "Hi", "input": "", "output": "no"})])
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = ST.start_reasoning_stream(spark, src, out, version="v2", tools=True, checkpoint=ck)
    q.awaitTermination(120)
    got = spark.read.json(out).collect()
    assert len(got) == 1 and got[0].output.startswith("## Problem Analysis")
    assert got[0].input.endswith("Use appropriate tools to complete this task.")
