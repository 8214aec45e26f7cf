"""Exact heads, positions, order-preserving sinks, repeated jobs, and the rule for a JSON line."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from samplesmith import catalog as CAT
from samplesmith.operators import limits as L
from samplesmith.operators import order as O
from samplesmith.operators import prompts as PR
from samplesmith.operators import scoring as SC
from samplesmith.plans import jobs
from samplesmith.schema import RAW, SAMPLE
from samplesmith.sources import jsonl as J
from samplesmith.sources import trees as TR
from samplesmith.streaming import reasoning as SR

WORDS = "seq long, instruction string, input string, output string"


def samples(spark, n, first=0):
    rows = [(k, f"i{k}", "", f"o{k}") for k in range(first, first + n)]
    random.Random(n).shuffle(rows)
    return spark.createDataFrame(rows, WORDS).repartition(6, "instruction")


def lines(path):
    """The lines of a sink's parts in name order."""
    out = []
    for part in sorted(glob.glob(f"{path}/part-*")):
        with open(part, encoding="utf-8") as f:
            out += f.read().splitlines()
    return out


@pytest.mark.parametrize("cell", [3, O.CELL])
def test_exact_head(spark, cell):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 1, 2, 2, 2, 2, 2, 3]), rnd.choice(["a", None, "b"]), k) for k in range(700)]
    df = spark.createDataFrame(rows, "g int, s string, k long").repartition(5)
    key = {"g": lambda v: (v is not None, v or 0), "s": lambda v: (v is not None, v or ""), "k": lambda v: v}
    for order in (["k"], ["g", "k"], ["s", "g", "k"]):
        want = sorted(rows, key=lambda r: [key[c](r["gsk".index(c)]) for c in order])
        for n in (1, 2, 350, 699, 700, 900):
            assert {r.k for r in O.exact_head(df, n, order, cell).collect()} == {r[2] for r in want[:n]}, (order, n)
    for n in (1, 100, 650):  # ties of the last key: as many rows as are asked for
        assert O.exact_head(df, n, ["g"], cell).count() == n
    assert O.exact_head(df.limit(0), 5, ["k"], cell).count() == 0
    nested = df.select(F.struct("g", F.struct("k").alias("in")).alias("o"), "k")
    assert O.exact_head(nested, 200, ["o"], cell).count() == 200


def test_head_reads_no_rows_into_one_task(spark):
    """The same plan for a small and a large ``n``: a filter, no exchange, no limit."""
    df = spark.range(5000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    for n in (3, 2500):
        plan = L.head_n(df, n, ["k"])._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "Limit" not in plan and "Exchange" not in plan and "Filter" in plan


def test_positions(spark):
    df = spark.createDataFrame([(k * 7919 % 1000, "x" * (k % 5)) for k in range(1000)], "k long, v string").repartition(7)
    found = O.with_positions(df, ["v", "k"]).collect()
    want = {(v, k): n for n, (v, k) in enumerate(sorted((r.v, r.k) for r in found), 1)}
    assert {(r.v, r.k): r.place for r in found} == want
    assert O.with_positions(df.limit(0), ["k"]).count() == 0
    places = L.seeded_positions(df.select("k"), "k").orderBy("place").collect()
    assert [r.place for r in places] == list(range(1, 1001))
    assert [r.k for r in places] == [r.k for r in L.seeded_shuffle(df.select("k"), "k").collect()]


def test_sink_keeps_order_and_appends_behind(spark, tmp_path):
    path = str(tmp_path / "out")
    for first, mode in ((0, "overwrite"), (500, "append"), (1000, "append")):
        assert J.write_jsonl(samples(spark, 500, first), path, mode=mode, order=["seq"]) == 500
    assert [json.loads(x)["instruction"] for x in lines(path)] == [f"i{k}" for k in range(1500)]
    back = O.with_positions(J.read_jsonl_lenient(spark, path), J.FILE_ORDER)
    assert back.where(F.col("instruction") != F.concat(F.lit("i"), (F.col("place") - 1).cast("string"))).count() == 0


def test_append_behind_parts_of_other_names(spark, tmp_path):
    path = str(tmp_path / "out")
    samples(spark, 40).select("instruction").coalesce(1).orderBy("instruction").write.json(path)
    J.write_jsonl(samples(spark, 3, 900), path, mode="append", order=["seq"])
    back = O.with_positions(J.read_jsonl_lenient(spark, path), J.FILE_ORDER).orderBy("place").collect()
    assert len(back) == 43 and [r.instruction for r in back[-3:]] == ["i900", "i901", "i902"]


def test_file_order_compares_numbers(spark):
    names = ["part-00000000.a-99999-u-c000.txt", "part-00000000.a-100000-u-c000.txt", "part-00000001.b-00000-u-c000.txt",
             "part-00000010.c-00000-u-c000.txt"]
    rows = spark.createDataFrame([(f"file:/d/{n}",) for n in reversed(names)], "p string").orderBy(J.file_order(F.col("p"))).collect()
    assert [r.p.rsplit("/", 1)[1] for r in rows] == names
    plain = ["part-99999-u.json", "part-100000-u.json", "part-00000001.x-00000-u.txt"]
    rows = spark.createDataFrame([(f"file:/d/{n}",) for n in reversed(plain)], "p string").orderBy(J.file_order(F.col("p"))).collect()
    assert [r.p.rsplit("/", 1)[1] for r in rows] == plain


def test_retried_job_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    J.write_jsonl(samples(spark, 10), path, order=["seq"])
    assert [J.write_jsonl(samples(spark, 5, 10), path, mode="append", order=["seq"], job_id="b") for _ in range(3)] == [5, 5, 5]
    # a try that broke off left a part and no marker
    broken = [p for p in glob.glob(f"{path}/part-00000001.b-*")]
    os.remove(f"{path}/_job-b.json")
    assert broken and J.write_jsonl(samples(spark, 5, 10), path, mode="append", order=["seq"], job_id="b") == 5
    assert [json.loads(x)["instruction"] for x in lines(path)] == [f"i{k}" for k in range(15)]
    with pytest.raises(ValueError):
        J.write_jsonl(samples(spark, 1), path, mode="append", job_id="a-b")


def stages_moved(plan):
    """The (kind, expressions) of a plan's shuffles."""
    return [x for x in plan.splitlines() if "Exchange " in x and "BroadcastExchange" not in x]


def test_places_without_moving_rows(spark, tmp_path):
    """Places in file order over many parts and cut files, blank and broken lines not counted; only the counts per split are exchanged."""
    path = tmp_path / "in"
    path.mkdir()
    want, k = [], 0
    for part, n in enumerate([300, 1, 0, 700, 40]):
        with open(path / f"part-{part:08d}.x-{0:05d}-u-c000.txt", "w", encoding="utf-8") as f:
            for _ in range(n):
                f.write("\n" if k % 7 == 3 else "{broken\n" if k % 11 == 5 else json.dumps({"instruction": f"i{k}", "output": "z" * (k % 90)}) + "\n")
                if k % 7 != 3 and k % 11 != 5:
                    want.append(f"i{k}")
                k += 1
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size, cost in (("4k", "1k"), ("4k", "1"), *[tuple(before.values())]):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            found = J.read_placed(spark, str(path))
            assert [(r.place, r.instruction) for r in found.orderBy("place").collect()] == list(enumerate(want, 1))
            moved = stages_moved(found._jdf.queryExecution().executedPlan().toString())
            assert not any("instruction" in x or "rangepartitioning" in x for x in moved), moved
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert J.read_placed(spark, str(tmp_path / "none")).count() == 0


def test_placed_result_writes_no_copy(spark, tmp_path):
    """The samples of a sink are read in place: no sorted copy of them goes to the shared folder."""
    path = str(tmp_path / "out")
    J.write_jsonl(samples(spark, 300), path, order=["seq"])
    shared = CAT.shared_dir(spark).removeprefix("file:")
    had = set(os.listdir(shared))
    found = CAT._placed(spark, path).orderBy("place").collect()
    assert [(r.place, r.instruction) for r in found] == [(k + 1, f"i{k}") for k in range(300)]
    assert not [x for x in set(os.listdir(shared)) - had if x.startswith("ranges-")]


def test_packed_sink_reads_back(spark, tmp_path):
    """gzip parts keep order and places, and stand beside plain ones."""
    path = str(tmp_path / "out")
    assert J.write_jsonl(samples(spark, 500), path, order=["seq"], compression="gzip") == 500
    assert J.write_jsonl(samples(spark, 200, 500), path, mode="append", order=["seq"]) == 200
    assert {x.endswith(".gz") for x in glob.glob(f"{path}/part-*")} == {True, False}
    assert [r.instruction for r in J.read_placed(spark, path).orderBy("place").collect()] == [f"i{k}" for k in range(700)]


def test_files_from_one_sort(spark, tmp_path):
    """Each dataset has its lines, in order, from one exchange of the table; null lines are left out."""
    rows = [(k if k else None, f"t{k}") for k in range(400)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, text string").repartition(5, "text")
    lines = {"a.jsonl": F.to_json(F.struct("text")), "b.jsonl": F.when(F.col("id") % 3 == 0, F.to_json(F.struct(F.concat("text", F.lit("!")).alias("text"))))}
    for compression in (None, "gzip"):
        found = J.write_jsonl_files(df, str(tmp_path / f"files-{compression}"), lines, ["id"], compression)
        assert list(found) == list(lines) and all(p.endswith(n) for n, p in found.items())
        back = [[r.text for r in J.read_placed(spark, p, J.T.StructType([J.T.StructField("text", J.T.StringType())])).orderBy("place").collect()]
                for p in found.values()]
        assert back == [[f"t{k}" for k in range(400)], [f"t{k}!" for k in range(3, 400, 3)]]


def test_named_files_hold_the_named_rows(spark, tmp_path):
    """The five files of W2 have the lines of the named sources, byte for byte, in the order of ``seq``."""
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    text = lambda k: None if k % 13 == 4 else "" if k % 13 == 7 else f"Line \"{k}\" é\nsecond\\{k}"
    write("documents", [(None if k == 90 else k, text(k), f"src{k % 4}", k) for k in range(180)], "doc_id long, text string, source string, n_chars long")
    write("benchmark", [(k, f"Q{k}") for k in range(30)], "item_id long, text string")
    write("labels", [(k, k % 3) for k in range(30)], "doc_id long, quality int")
    write("conversations", [(c, t, "assistant" if t % 2 else "user", f"c{c} t{t}") for c in range(12) for t in range(4)],
          "conv_id long, turn int, role string, text string")
    found = CAT._named_files(spark, str(tmp_path))
    named = CAT.A.v_named_sources(spark, str(tmp_path))
    fields = [c for c in named.columns if c not in ("dataset_ord", "dataset")]
    for k, path in enumerate(found):
        want = named.where(F.col("dataset_ord") == k).where(F.coalesce(*[F.col(c).cast("string") for c in fields]).isNotNull())
        rows = want.orderBy("seq").select(F.to_json(F.struct(*fields)).alias("value")).collect()
        assert path.endswith(CAT.A.NAMED_SOURCES[k]) and all(x.endswith(".gz") for x in glob.glob(f"{path.removeprefix('file:')}/part-*"))
        back = spark.read.text(path).withColumn("o", J.file_order(F.col("_metadata.file_path"))).withColumn("n", F.monotonically_increasing_id())
        assert [r.value for r in back.orderBy("o", "n").collect()] == [r.value for r in rows], k


def test_lines_are_built_behind_the_sort(spark, tmp_path, monkeypatch):
    """What is dealt to ranges has the fields, not the built line."""
    sorted_columns, cls = [], type(spark.range(1))
    order_by = cls.orderBy

    def seen(self, *cols, **more):
        sorted_columns.append(self.columns)
        return order_by(self, *cols, **more)

    monkeypatch.setattr(cls, "orderBy", seen)
    J.write_jsonl(samples(spark, 20), str(tmp_path / "out"), order=["seq"])
    assert sorted_columns == [["instruction", "input", "output", "__o0"]]


def test_concat_is_line_by_line(spark, tmp_path):
    paths = []
    for name, n in (("short", 3), ("long", 2000), ("gone", 0), ("mid", 40)):
        paths.append(str(tmp_path / f"{name}.jsonl"))
        if n:
            with open(paths[-1], "w", encoding="utf-8") as f:
                f.write("".join(f'{{"{name}": {k}}}  \n' for k in range(n)))
    out = str(tmp_path / "out")
    assert J.concat_files(spark, paths, out) == 2043
    want = [f'{{"{name}": {k}}}  ' for name, n in (("short", 3), ("long", 2000), ("mid", 40)) for k in range(n)]
    assert lines(out) == want
    assert J.concat_files(spark, [str(tmp_path / "none")], str(tmp_path / "empty")) == 0


def test_merge_files_in_request_order(spark, tmp_path):
    """First rows first, with exact counts, also when the job runs again."""
    data = tmp_path / "data"
    data.mkdir()
    for name, rows in (("codealpaca", [("first0", "x"), ("dup", "x"), ("", "")]), ("mbpp", [(f"second{k}", "y") for k in range(300)] + [("dup", "x")])):
        with open(data / f"{name}.jsonl", "w", encoding="utf-8") as f:
            f.write("".join(json.dumps({"instruction": i, "input": "", "output": o}) + "\n" for i, o in rows))
    out = str(tmp_path / "out")
    for _ in range(2):
        told = jobs.merge_files(spark, ["codealpaca", "mbpp"], out, data_dir=str(data), job_id="m")
        assert told["written"] == 302 and told["after_dedup"]["rows"] == 302
        assert told["loaded"]["dataset_1"] == 301 and told["after_filter"]["rows"] == 303
    assert [json.loads(x)["instruction"] for x in lines(out)] == ["first0", "dup"] + [f"second{k}" for k in range(300)]
    told = jobs.merge_files(spark, ["codealpaca", "mbpp"], str(tmp_path / "head"), data_dir=str(data), limit=5)
    assert told["written"] == 5 and told["after_dedup"]["rows"] == 302
    assert [json.loads(x)["instruction"] for x in lines(tmp_path / "head")] == ["first0", "dup", "second0", "second1", "second2"]


LINES = ['{"instruction":"a"}', '{"instruction":"a"}],[{"instruction":"b"}', '{"instruction":"a"}] x }', '{"instruction":"a"} {"x":1}',
         '{"instruction":"a"},{"x":1}', '{"a":1} // c', "{'a':1}", '{"instruction":"a"}]}', '{"instruction":null}', '{}', '[{"a":1}]',
         '{"instruction":"a","x":[1,{"y":"}]"}]}', '{"instruction":"a"}}', '{"instruction":"a",}', '{"a":1},{"__end":"x"}', '{"a":"\\u00e9 ],["}',
         '  {"instruction":"a"}\t', '"x"', '5', 'null', '{"a":1}]', '[{"a":1}', '{"instruction":"a"', '{"a":1},', ',{"a":1}']


def is_object(line):
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def test_one_object_a_line(spark, tmp_path):
    found = spark.createDataFrame([(x,) for x in LINES], "value string").select("value", J.parsed(F.col("value"), RAW).isNotNull().alias("ok"))
    assert {r.value: r.ok for r in found.collect()} == {x: is_object(x) for x in LINES}
    path = str(tmp_path / "in/lines.jsonl")
    os.makedirs(os.path.dirname(path))
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(LINES) + "\n")
    assert J.read_jsonl_lenient(spark, path).count() == sum(map(is_object, LINES))
    bad = {(r.line_no, r._corrupt) for r in J.rejected_lines(spark, path).collect()}
    assert bad == {(n, x) for n, x in enumerate(LINES, 1) if not is_object(x)}
    out = str(tmp_path / "streamed")
    stream = SR.sample_stream(spark, os.path.dirname(path))
    assert stream.schema.fieldNames() == SAMPLE.fieldNames()
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck"))
             .trigger(availableNow=True).start())
    assert query.awaitTermination(120)
    assert spark.read.parquet(out).count() == sum(map(is_object, LINES))


def test_dumps_drop_broken_lines(spark, tmp_path):
    items, comments, out = str(tmp_path / "items.jsonl"), str(tmp_path / "comments.jsonl"), str(tmp_path / "out")
    with open(items, "w", encoding="utf-8") as f:
        f.write('{"item_id": 1, "title": "T", "body": "B"}\nbroken\n{"item_id": 2} x\n')
    open(comments, "w").close()
    n = jobs.threads_to_samples(spark, items, comments, out)
    assert n and all("T" in x for x in lines(out))


def test_pruned_folders_are_never_listed(spark, tmp_path, monkeypatch):
    """A pruned folder without read permission does no harm; names with glob characters and equal signs are plain names."""
    root = tmp_path / "tree"
    for rel in ("a/x.py", "a/[id]/y.py", "a/source=b/z.py", "a/{q}/w.py", "node_modules/n.py", "a/node_modules/deep/m.py", ".git/g.py", "venv/v.py",
                "a/k.md", "p.py/inner.py", "r.py"):
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text("print(1)\n" * 30)
    listed = TR.listing(spark, str(root), [".py"], ["node_modules", "venv"], hidden=False)[0]
    assert not any("node_modules" in f or ".git" in f or "venv" in f for f in listed)
    closed = root / "node_modules"
    closed.chmod(0)
    try:
        found = {r.path for r in TR.scan_tree(spark, str(root), exts=[".py"], pruned=["node_modules", "venv"], hidden=False).collect()}
    finally:
        closed.chmod(0o755)
    assert found == {"a/x.py", "a/[id]/y.py", "a/source=b/z.py", "a/{q}/w.py", "p.py/inner.py", "r.py"}
    bounded = TR.scan_tree(spark, str(root), exts=[".py"], pruned=["node_modules"], hidden=False, max_bytes=10)
    assert bounded.count() == 0
    assert TR.scan_tree(spark, str(root / "a/node_modules"), exts=[".py"], pruned=["deep"]).count() == 0


def test_names_that_spark_hides_are_read(spark, tmp_path):
    """``__init__.py`` and whatever lies in ``_private`` or ``.github`` is part of a tree, within the size bounds."""
    root = tmp_path / "tree"
    texts = {"a/__init__.py": "x = 1\n", "a/m.py": "y = 2\n", "_private/z.py": "z = 3\n", ".github/w.py": "w = 4\n", "a/.conf.py": "c = 5\n",
             "b c/__main__.py": "é = 6\r\nf = 7\n", "b c/_100%.py": "", "b c/_big.py": "g = 8\n" * 100, "_skip.md": "no"}
    for rel, text in texts.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_bytes(text.encode())
    whole = {r.path: (r.repo, r.length, r.content) for r in TR.scan_tree(spark, str(root), exts=[".py"]).collect()}
    assert whole == {k: (k.split("/")[0], len(v.encode()), v.replace("\r\n", "\n")) for k, v in texts.items() if k.endswith(".py")}
    cut = TR.scan_tree(spark, str(root), exts=[".py"], min_bytes=0, max_bytes=100, pruned=["a"], hidden=False)
    assert {r.path for r in cut.collect()} == {"_private/z.py", "b c/__main__.py"}
    only = TR.scan_tree(spark, str(root / "a"), exts=["__init__.py"], repo="r")
    assert [(r.repo, r.path, r.content) for r in only.collect()] == [("r", "__init__.py", "x = 1\n")]


def test_hot_task_is_dealt_to_salts(spark):
    """Every generation meets its test, with half of them on one task and broadcasts off."""
    rows = [(1 if k % 2 else k % 50, k, f"c{k}") for k in range(2000)] + [(None, 9999, "x")]
    gens = spark.createDataFrame(rows, "task_id long, gen long, code string")
    tests = spark.createDataFrame([(k, f"t{k}") for k in range(0, 50, 3)] + [(1, "t1")], "task_id long, test string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {(r.task_id, r.gen, r.full_code) for r in SC.attach_tests(gens, tests).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    has = {k for k in range(0, 50, 3)} | {1}
    assert found == {(t, g, f"{c}\nt{t}") for t, g, c in rows if t in has}


def test_mean_is_the_same_for_any_partitioning(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([1e-12, 0.1, 3.7, 1e7]) * rnd.random(), 1) for _ in range(5000)]
    df = spark.createDataFrame(rows, "nll double, label int")
    means = {repr(PR.loss_and_perplexity(df.repartition(n)).first()["eval_loss"]) for n in (1, 7, 200)}
    assert len(means) == 1 and abs(float(means.pop()) - sum(r[0] for r in rows) / 5000) < 1e-6
    odd = spark.createDataFrame([(float("nan"), 1), (1.0, 1)], "nll double, label int")
    assert PR.loss_and_perplexity(odd).first()["eval_loss"] != 0 and PR.loss_and_perplexity(df.limit(0)).first()["eval_loss"] is None
