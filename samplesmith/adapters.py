"""Adapters: the driver's tables -> the operator input shapes.

The test tables hold invented prose, so code-like text, URLs, paths and JSON
are composed deterministically from ids.  Every rule here is mirrored in
``oracle/views.py`` (DuckDB SQL) so each query can be checked against SQL.

All adapters are narrow projections of one table, except ``v_samples`` (an
equi-join of a conversation turn with the next turn on ``(conv_id, turn)``:
a two-column key, so one long conversation cannot skew it) and
``v_problems`` (a left join with ``labels`` on the document id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samplesmith.functions import text as T
from samplesmith.session import sf_path

# Fixed adapter vocabulary (ours, not the reference's): instruction phrases
# chosen to reach every rule branch of C1-C6.
PHRASES = [
    "Write a function to",
    "Fix the bug in",
    "Explain what this code does",
    "Optimize the sort in",
    "Search the repo for",
    "Fetch the api data and",
    "Read the file config.py and",
    "Clone the github repo and",
    "Describe how to parse",
    "Improve and validate",
    "Debug the thread reader",
    "Implement reverse for",
    "Find the rapid path",
    "Run the tests for",
    "Summarize",
    "Create and save a report on",
]
FILE_DIRS = ["src", "lib", "node_modules", "build", "tests", "app", ".venv", "vendor", "dist"]
FILE_EXTS = [".py", ".js", ".ts", ".java", ".kt", ".cpp", ".go", ".rs", ".rb", ".php", ".xml", ".md"]
TURNS = 1_000_003  # more than any conversation has turns, and prime to the rule moduli
TASKS = 40  # benchmark items present at every scale; each generation belongs to one of them
BENCHMARKS = ["humaneval", "mbpp", "custom"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(sf_path(sf_dir, table))


def pick(values: list[str], idx: Column) -> Column:
    """``values[idx]`` for a 0-based index column (a literal array lookup)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def json_text(t: Column) -> Column:
    """Text that stands as it is inside a JSON string."""
    return F.replace(F.replace(F.replace(t, F.lit("\\"), F.lit("")), F.lit('"'), F.lit("")), F.lit("\n"), F.lit(" "))


def v_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples ``(seq, dataset, instruction, input, output)`` from user turns and
    the assistant turn that follows them."""
    c = read(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("u_text"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a_text"))
    j = u.join(a, ["conv_id", "turn"]).withColumn("seq", F.col("conv_id") * TURNS + F.col("turn"))
    seq, ut, at = F.col("seq"), F.col("u_text"), F.col("a_text")
    seq_s = seq.cast("string")
    instruction = F.concat(pick(PHRASES, seq % 16), F.lit(" "), ut)
    inp = (F.when(seq % 5 == 0, F.concat(F.lit('See "src/app_'), seq_s, F.lit('.py" for details. '), ut))
           .when(seq % 5 == 1, F.concat(F.lit("Source: https://github.com/org"), F.col("conv_id").cast("string"),
                                        F.lit("/repo-"), F.col("turn").cast("string"), F.lit(".git "), ut))
           .when(seq % 5 == 2, F.concat(F.lit("path lib/mod.py "), ut))
           .when(seq % 5 == 3, F.lit(""))
           .otherwise(ut))
    out = (F.when(seq % 9 == 0, F.concat(F.lit("import os\n"), at))
           .when(seq % 9 == 3, F.concat(F.lit("```python\ndef answer_"), seq_s, F.lit("(x):\n    return x\n```\n"), at))
           .when(seq % 9 == 6, F.concat(F.lit("class Answer"), seq_s, F.lit(":\n    pass\n"), at))
           .when(seq % 3 == 1, at)
           .when(seq % 15 == 2, F.lit(""))
           .when(seq % 15 == 5, F.lit("Yes."))
           .when(seq % 15 == 8, F.lit("Yes, done."))
           .otherwise(at))
    return j.select(seq, F.lit("conversations").alias("dataset"), instruction.alias("instruction"),
                    inp.alias("input"), out.alias("output"))


def raw_columns() -> list[Column]:
    """Raw hub rows, as columns of ``documents``."""
    i, t = F.col("doc_id"), F.col("text")
    shape = i % 5
    nul = F.lit(None).cast("string")
    instruction = (F.when(shape == 0, F.when(i % 10 == 0, nul).otherwise(F.lit("")))
                   .when(shape == 1, F.when(i % 10 == 1, nul).otherwise(F.concat(F.lit("Implement: "), T.first_line(t))))
                   .when(shape == 2, F.when(i % 10 == 2, nul).otherwise(F.lit("Solve the puzzle.")))
                   .when(shape == 3, T.first_line(t))
                   .otherwise(F.lit("Summarize this text.")))
    return [
        i.alias("seq"),
        F.col("source").alias("dataset"),
        instruction.alias("instruction"),
        F.when(shape.isin(3, 4), t).alias("input"),
        F.when(shape == 3, t).when(shape == 4, T.first_line(t)).alias("output"),
        F.when(shape == 0, F.when(i % 3 == 0, t).otherwise(T.first_line(t))).alias("prompt"),
        F.when(shape == 0, t).alias("completion"),
        F.when(shape == 1, t).alias("text"),
        F.when(shape == 1, F.concat(F.lit("def f"), i.cast("string"), F.lit("():\n    return "),
                                    F.col("n_chars").cast("string"))).alias("code"),
        F.when(shape == 2, t).alias("question"),
        F.when(shape == 2, F.concat(F.lit('["'), json_text(t), F.lit('"]'))).alias("solutions"),
    ]


def v_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw hub rows in four shapes (prompt/completion, text/code,
    question/solutions, standard) with null and ``''`` fields; null = key absent."""
    return read(spark, sf_dir, "documents").select(*raw_columns())


def v_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems ``(item_id, question, solutions JSON text, difficulty, starter_code)``."""
    b = read(spark, sf_dir, "benchmark")
    lab = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), "quality")
    i, t = F.col("item_id"), F.col("text")
    return b.join(lab, "item_id", "left").select(
        i,
        F.when(i % 7 == 6, F.lit("")).otherwise(t).alias("question"),
        (F.when(i % 11 == 5, F.lit("")).when(i % 11 == 7, F.lit(None).cast("string"))
         .when(i % 3 == 0, F.concat(F.lit('["'), json_text(t), F.lit('", "print(1)"]')))
         .when(i % 3 == 1, F.concat(F.lit("def broken("), i.cast("string"), F.lit("): return [")))
         .otherwise(F.lit("[]"))).alias("solutions"),
        (F.when(F.col("quality") == 1, F.lit("interview")).when(F.col("quality") == 0, F.lit("introductory"))
         .otherwise(F.lit("competition"))).alias("difficulty"),
        F.when(i % 4 == 0, F.lit("def solve():\n    pass")).otherwise(F.lit("")).alias("starter_code"),
    )


def v_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files ``(repo, path, length, content)`` like a ``binaryFile`` scan
    (content already decoded)."""
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    ext = pick(FILE_EXTS, i % len(FILE_EXTS))
    name = F.when(i % 17 == 0, F.concat(F.lit("f"), i.cast("string"), F.lit("."), ext)) \
        .when(i % 13 == 0, F.concat(F.lit("build_"), i.cast("string"), ext)) \
        .otherwise(F.concat(F.lit("f"), i.cast("string"), ext))
    return d.select(
        F.col("source").alias("repo"),
        F.concat_ws("/", F.col("source"), pick(FILE_DIRS, i % len(FILE_DIRS)), name).alias("path"),
        F.octet_length("text").cast("bigint").alias("length"),
        F.col("text").alias("content"),
    )


def v_thread_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue/PR dump rows: the opening turn of each conversation.  Every third
    conversation is a PR (``pull_request`` set); some bodies are null."""
    c = read(spark, sf_dir, "conversations").where(F.col("turn") == 0)
    k = F.col("conv_id")
    return c.select(
        k.alias("item_id"),
        T.first_line("text").alias("title"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("body"),
        F.when(k % 3 == 0, F.struct(F.concat(F.lit("pr/"), k.cast("string")).alias("url")))
         .alias("pull_request"),
    )


def v_thread_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments ``(parent_key, ord, body)``: the later turns of each conversation."""
    c = read(spark, sf_dir, "conversations").where(F.col("turn") > 0)
    return c.select(
        F.col("conv_id").alias("parent_key"),
        F.col("turn").alias("ord"),
        F.when(F.col("turn") % 11 == 5, F.lit("")).otherwise(F.col("text")).alias("body"),
    )


def v_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model generations ``(benchmark, model, task_id, gen, text, passed, error)``."""
    e = read(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    i_s = i.cast("string")
    txt = (F.when(i % 5 == 0, F.concat(F.lit("```python\ndef t"), u.cast("string"), F.lit("(x):\n    return x + "),
                                       i_s, F.lit("\n```\nDone.")))
           .when(i % 5 == 1, F.concat(F.lit("Here:\n```py\nprint("), i_s, F.lit(")\n```")))
           .when(i % 5 == 2, F.concat(F.lit('def g(x):\n    """doc\n    more"""\n    # comment\n    return '),
                                      i_s, F.lit("\n\n// tail")))
           .when(i % 5 == 3, F.concat(F.lit("```kotlin\nfun k() = "), i_s, F.lit("\n```")))
           .otherwise(F.concat(F.lit("Sure! "), F.col("props"))))
    passed = F.col("value") > 250
    return e.select(
        pick(BENCHMARKS, u % 3).alias("benchmark"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), F.lit("fine_tuned"))
         .otherwise(F.lit("base")).alias("model"),
        (u % TASKS).alias("task_id"),
        i.alias("gen"),
        txt.alias("text"),
        passed.alias("passed"),
        F.when(passed, F.lit(None).cast("string")).otherwise(F.concat(F.lit("AssertionError: "), F.col("event_type")))
         .alias("error"),
    )


def v_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark test cases ``(task_id, prompt, test)``."""
    b = read(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    return b.select(
        i.alias("task_id"),
        F.col("text").alias("prompt"),
        F.concat(F.lit("assert t"), i.cast("string"), F.lit("(1) == 2  # "), T.one_line("text")).alias("test"),
    )


def v_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs ``(url_id, url)``: each page URL as is, with ``.git`` and with a trailing slash."""
    p = read(spark, sf_dir, "pages")
    u = F.col("url")
    variants = F.array(u, F.concat(u, F.lit(".git")), F.concat(u, F.lit("/")))
    return p.select(F.col("page_id"), F.posexplode(variants).alias("variant", "url")) \
        .select((F.col("page_id") * 3 + F.col("variant")).alias("url_id"), "url")


def v_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id rows ``(id, tokens ARRAY<INT>)``: word lengths of a conversation turn."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("id"),
        F.transform(F.split("text", " ", -1), lambda w: F.length(w) + 100).alias("tokens"),
    )


def v_token_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-token losses ``(id, pos, label, nll)`` from the embedding vectors;
    every eighth position is the ignore label -100."""
    e = read(spark, sf_dir, "embeddings")
    x = e.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("pos", "v"))
    return x.select(
        "id", F.col("pos").cast("int").alias("pos"),
        F.when(F.col("pos") % 8 == 7, F.lit(-100)).otherwise(F.col("pos")).cast("int").alias("label"),
        F.abs(F.col("v").cast("double")).alias("nll"),
    )


CODE_LANGS = ["python", "java", "go", "javascript", "ruby", "php"]
SPLITS = ["train", "test", "validation"]


def code_doc_columns() -> list[Column]:
    """Code + documentation rows, as columns of ``documents``."""
    i, t = F.col("doc_id"), F.col("text")
    i_s = i.cast("string")
    nul = F.lit(None).cast("string")
    return [
        i.alias("seq"),
        F.concat(F.lit("def f"), i_s, F.lit("(x):\n    return x * "), F.col("n_chars").cast("string")).alias("code"),
        F.when(i % 6 == 0, nul).when(i % 6 == 1, F.lit("")).otherwise(T.first_line(t)).alias("docstring"),
        F.when(i % 4 == 3, F.lit("")).otherwise(t).alias("english_documentation"),
        F.when(i % 3 == 0, nul).when(i % 3 == 1, F.lit("")).otherwise(t).alias("func_documentation_string"),
        F.concat(F.lit("def f"), i_s, F.lit("(x):\n    # "), F.when(i % 5 == 0, F.lit("")).otherwise(t)).alias("func_code_string"),
        F.when(i % 9 == 0, nul).when(i % 9 == 1, F.lit("")).otherwise(F.col("source")).alias("repository_name"),
        pick(CODE_LANGS, i % len(CODE_LANGS)).alias("lang"),
        pick(SPLITS, i % len(SPLITS)).alias("split"),
    ]


def v_code_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code + documentation rows (code-search shapes), with null and ``''`` docs,
    and the ``lang`` x ``split`` grid of a partitioned parquet layout."""
    return read(spark, sf_dir, "documents").select(*code_doc_columns())


def v_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function-completion rows ``(task_id, prompt, canonical_solution)``."""
    b = read(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    return b.select(
        i.alias("task_id"),
        F.when(i % 5 == 4, F.lit("")).otherwise(
            F.concat(F.lit("def t"), i.cast("string"), F.lit('(x):\n    """'), T.one_line("text"),
                     F.lit('"""\n'))).alias("prompt"),
        F.when(i % 6 == 5, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("    return x + "), i.cast("string"))).alias("canonical_solution"),
    )


NAMED_SOURCES = ["apps_train.jsonl", "codesearchnet1.jsonl", "codealpaca.jsonl", "oss_instruct.jsonl", "notes.jsonl"]
CODE_DOC_FIELDS = ["code", "english_documentation", "func_documentation_string"]
INSTRUCT_FIELDS = ["instruction", "input", "output"]
# The named sources that are projections of ``documents``, by their place in NAMED_SOURCES.
DOCUMENT_SOURCES = {1: (code_doc_columns, CODE_DOC_FIELDS), 2: (raw_columns, INSTRUCT_FIELDS), 4: (raw_columns, INSTRUCT_FIELDS)}


def v_named_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows from five named files (the file name drives routing, P11),
    with ``dataset_ord`` in request order and ``seq`` within each file."""
    from samplesmith.schema import RAW_FIELDS, with_fields
    p = v_problems(spark, sf_dir).select(F.col("item_id").alias("seq"), "question", "solutions", "starter_code")
    c = v_code_doc(spark, sf_dir).select("seq", *CODE_DOC_FIELDS)
    r = v_raw(spark, sf_dir).select("seq", *INSTRUCT_FIELDS)
    s = v_samples(spark, sf_dir).select("seq", *INSTRUCT_FIELDS)
    parts = [p, c, r, s, r]
    out = None
    for k, (name, part) in enumerate(zip(NAMED_SOURCES, parts)):
        part = with_fields(part, RAW_FIELDS).select(
            F.lit(k).alias("dataset_ord"), F.lit(name).alias("dataset"), "seq", *RAW_FIELDS)
        out = part if out is None else out.unionByName(part)
    return out


def v_registry(spark: SparkSession) -> DataFrame:
    """A dataset registry ``(group, name)``: 25 names, 20 of which exist in
    ``documents.source`` at every scale (a small constant table)."""
    rows = [(f"g{i % 5}", f"src{i}") for i in range(25)]
    return spark.createDataFrame(rows, "group string, name string")
