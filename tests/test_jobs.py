"""File-to-file jobs W4, W5/W6, W7, W8, W9, W10 on small written inputs."""

import json
import os

from samplesmith.plans import jobs


def write(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        for r in rows:
            f.write((r if isinstance(r, str) else json.dumps(r)) + "\n")


def test_problem_conversion(spark, tmp_path):
    tr, te = str(tmp_path / "in/train.jsonl"), str(tmp_path / "in/test.jsonl")
    write(tr, [{"question": "Q1", "solutions": json.dumps(["s1", "s2"]), "difficulty": "easy"},
               {"question": "Q2", "solutions": "[]", "difficulty": "hard"}, "not json",
               {"question": "", "solutions": json.dumps(["x"])}])
    write(te, [{"question": "Q3", "solutions": "print(3)", "difficulty": "interview"}])
    out = str(tmp_path / "out")
    counts = jobs.problems_to_samples(spark, tr, te, out)
    assert counts == {"apps_train": 1, "apps_test": 1, "combined": 2}
    rows = {r.input: r for r in spark.read.json(f"{out}/combined").collect()}
    assert rows["Q1"].output == "s1" and rows["Q1"].instruction == "Solve this coding problem (Difficulty: easy)."
    assert rows["Q3"].output == "print(3)"  # not JSON: one-element fallback
    jobs.problems_to_samples(spark, tr, te, out)  # S5: append mode
    assert spark.read.json(f"{out}/apps_train").count() == 2


def test_reasoning_files(spark, tmp_path):
    src = str(tmp_path / "s.jsonl")
    write(src, [{"instruction": "Fetch the api", "input": "", "output": "import os\nx = 1"},
                {"instruction": "a", "input": "", "output": "short"}, "", "{bad"])
    n1 = jobs.reasoning_files(spark, src, str(tmp_path / "v1"), version="v1")
    n2 = jobs.reasoning_files(spark, src, str(tmp_path / "v2"), version="v2", tools=True)
    assert n1 == 1 and n2 == 1
    v1 = spark.read.json(str(tmp_path / "v1")).first()
    assert json.loads(v1.output.split("```json\n")[-1].rstrip("`\n")) == {"tool": "web_search", "args": {"query": "Fetch the api"}}


def test_training_set(spark, tmp_path):
    src = str(tmp_path / "cot_samples.jsonl")
    write(src, [{"id": k, "instruction": f"i{k}", "input": "x", "output": "o"} for k in range(400)])
    tok = str(tmp_path / "tokens")
    spark.createDataFrame([(k, list(range(k % 9 + 1))) for k in range(400)], "id long, tokens array<int>") \
        .write.parquet(tok)
    res = jobs.training_set(spark, src, tok, str(tmp_path / "train_out"), max_seq=8)
    assert res["train"] + res["eval"] == 400 and res["dataset_kind"] == "cot"
    assert res["steps_per_epoch"] == res["train"] // 16
    r = spark.read.parquet(str(tmp_path / "train_out/split=train")).first()
    assert len(r.input_ids) == 8 and r.prompt.startswith("[INST] i")


def test_scoring(spark, tmp_path):
    gens, tests = str(tmp_path / "g.jsonl"), str(tmp_path / "t.jsonl")
    rows = []
    for task in range(4):
        for gen in range(5):
            for model in ("base", "fine_tuned"):
                passed = (gen == 4) if model == "base" else (gen >= 2 and task != 0)
                rows.append({"benchmark": "humaneval", "model": model, "task_id": task, "gen": gen,
                             "text": f"```python\nx = {gen}\n```", "passed": passed, "error": None})
    write(gens, rows)
    write(tests, [{"task_id": t, "prompt": f"prompt {t}", "test": "assert True"} for t in range(4)])
    res = jobs.score(spark, gens, tests, str(tmp_path / "scores"), fallback_ckpt=str(tmp_path / "ck"))
    comp = res["comparison"][0]
    assert comp["base_passed"] == 4 and comp["ft_passed"] == 3 and comp["improvement"] == -25.0
    results = spark.read.json(str(tmp_path / "scores/results")).collect()
    assert len(results) == 8
    assert all([p.code for p in r.problem_results] == ["x = 0", "x = 1", "x = 2"] for r in results)
    assert {r.prompt for r in results} == {f"prompt {t}" for t in range(4)}


def test_threads_and_snippets(spark, tmp_path):
    items, comments = str(tmp_path / "items.jsonl"), str(tmp_path / "comments.jsonl")
    write(items, [{"item_id": 1, "title": "Bug", "body": "It breaks"},
                  {"item_id": 2, "title": "PR", "body": None, "pull_request": {"url": "u"}}])
    write(comments, [{"parent_key": 1, "ord": k, "body": f"c{k}"} for k in range(8)])
    assert jobs.threads_to_samples(spark, items, comments, str(tmp_path / "th")) == 1 + 5 + 1
    root = tmp_path / "repos"
    for k in range(3):
        write(str(root / "r1" / "src" / f"m{k}.py"), [f"value_{j} = compute({j})  # step" for j in range(45)])
    write(str(root / "r1" / "tests" / "t.py"), ["assert compute(1) == 1  # a long enough test line"] * 10)
    n = jobs.repo_snippets(spark, str(root), str(tmp_path / "snip"), variant="a")
    assert n == 3  # tests/ is pruned for variant a
    first = spark.read.json(str(tmp_path / "snip")).first()
    assert first.instruction == "Explain this py code snippet." and len(first.input) == 600


def test_python_tree_and_code_search(spark, tmp_path):
    from samplesmith.sources import registry as REG
    root = tmp_path / "flask"
    write(str(root / "src" / "app.py"), [f"def handler_{k}(request):  # route number {k}" for k in range(90)])
    write(str(root / ".hidden" / "x.py"), ["secret = 1  # padding padding padding padding padding"] * 30)
    write(str(root / "venv" / "lib.py"), ["vendored = 1  # padding padding padding padding padding"] * 30)
    n = jobs.python_tree_chunks(spark, str(root), "flask", str(tmp_path / "extra"))
    rows = sorted(spark.read.json(str(tmp_path / "extra")).collect(), key=lambda r: r.instruction)
    assert n == 4 and rows[0].instruction == "Explain this code from flask (src/app.py, lines 1-20):"
    assert rows[-1].instruction.endswith("lines 61-80):") and rows[0].output == "The code implements flask functionality."
    grid = spark.createDataFrame(
        [("python", "train", "def long_function_name(argument_one, argument_two):\n    return argument_one",
          "Adds.", "org/repo"),
         ("go", "test", "func f() {}", "short", "org/go"),
         ("java", "validation", "public static int add(int a, int b) { return a + b; } // and more", None, None)],
        "lang string, split string, func_code_string string, func_documentation_string string, repository_name string")
    REG.write_partitioned_parquet(grid, str(tmp_path / "csn"), by=["lang", "split"])
    m = jobs.code_search_samples(spark, str(tmp_path / "csn"), str(tmp_path / "csn_out"))
    out = {r.instruction: r.output for r in spark.read.json(str(tmp_path / "csn_out")).collect()}
    assert m == 2 and out == {"Explain this python code:": "Adds.", "Explain this java code:": "Function from codebase"}
    assert jobs.code_search_samples(spark, str(tmp_path / "csn"), str(tmp_path / "csn_py"), langs=["python"]) == 1


def test_cli_convert_dumps(spark, tmp_path):
    from samplesmith.__main__ import main
    src = str(tmp_path / "alpaca.jsonl")
    write(src, [{"prompt": f"Task {k}\n  details {k}  ", "completion": "c" * 600} for k in range(5)])
    res = main(["convert", "--kind", "alpaca", "--input", src, "--output", str(tmp_path / "a"), "--limit", "3"])
    rows = sorted(spark.read.json(str(tmp_path / "a")).collect(), key=lambda r: r.instruction)
    assert res["written"] == 3 and [r.instruction for r in rows] == ["Task 0", "Task 1", "Task 2"]
    assert rows[0].input == "details 0" and len(rows[0].output) == 500
    pq = str(tmp_path / "csn.parquet")
    spark.createDataFrame([("java", "x" * 60, None, "org/r"), ("go", "short", "d", None)],
                          "lang string, func_code_string string, func_documentation_string string, "
                          "repository_name string").write.parquet(pq)
    res = main(["convert", "--kind", "function-doc-multilang", "--format", "parquet", "--input", pq,
                "--output", str(tmp_path / "b")])
    got = spark.read.json(str(tmp_path / "b")).first()
    assert res["written"] == 1 and got.instruction == "Explain this java code:" and got.output == "Function from org/r"


def test_every_converter_kind_runs(spark, tmp_path):
    src = str(tmp_path / "wide.jsonl")
    row = {"instruction": "Do it", "input": "in", "output": "out", "prompt": "P\nq", "completion": "c",
           "question": "Q", "solutions": '["s"]', "difficulty": "easy", "text": "t", "code": "x = 1\n" * 20,
           "canonical_solution": "pass", "docstring": "doc", "english_documentation": "ed",
           "func_code_string": "def f():\n" + "    y = 1\n" * 10, "func_documentation_string": "fd",
           "repository_name": "o/r", "title": "T", "body": "b" * 60}
    write(src, [row, row])
    for kind in sorted(jobs.CONVERTERS):
        n = jobs.convert_dump(spark, kind, src, str(tmp_path / f"out_{kind}"), limit=1)
        assert n == 1, kind


def test_cli_repo_with_discussions(spark, tmp_path):
    from samplesmith.__main__ import main
    write(str(tmp_path / "repo" / "m.py"), [f"value_{k} = compute({k})" for k in range(10)])
    items, comments = str(tmp_path / "i.jsonl"), str(tmp_path / "c.jsonl")
    write(items, [{"item_id": 1, "title": "Crash", "body": "Stack trace"}])
    write(comments, [{"parent_key": 1, "ord": 0, "body": "Fixed in main"}])
    res = main(["repo", "--repo", str(tmp_path / "repo"), "--output", str(tmp_path / "o"),
                "--discussion-items", items, "--discussion-comments", comments])
    assert res["written"] == 4 + 2


def test_cli_process_merge_generate(spark, tmp_path):
    from samplesmith.__main__ import main
    d = tmp_path / "data"
    write(str(d / "apps_train.jsonl"), [{"question": "Q", "solutions": json.dumps(["s"]), "starter_code": "def f():"}])
    write(str(d / "codealpaca.jsonl"), [{"instruction": "Do x", "input": "in", "output": "o"},
                                        {"instruction": "Do x", "input": "in", "output": "dup"}, {"instruction": ""}])
    write(str(d / "codesearchnet.jsonl"), [{"code": "c", "english_documentation": "d"}])
    res = main(["process", "--inputs", str(d / "apps_train.jsonl"), str(d / "codealpaca.jsonl"),
                str(d / "codesearchnet.jsonl"), "--output", str(tmp_path / "proc")])
    got = sorted(r.output for r in spark.read.json(str(tmp_path / "proc")).collect())
    assert res["written"] == 4 and got == ["", "", "o", "s"]
    listed = main(["merge", "--list", "--data-dir", str(d)])
    assert {r["name"]: r["status"] for r in listed["datasets"]}["apps_train"] == "present"
    gen = main(["generate", "--kind", "bank", "--count", "50", "--output", str(tmp_path / "gen")])
    assert gen["written"] == 50
