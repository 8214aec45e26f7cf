"""Converters from raw source shapes to ``(instruction, input, output)`` samples
(P1-P25, P30, P31).

Each converter is a projection (plus a filter, or an ``explode`` of a short
literal array where one row yields up to two samples); none shuffles.
Inputs are wide raw DataFrames (``schema.RAW``); a missing key is a null
column (presence rule M1: a key is present when it is not null).
Bookkeeping columns (``seq``, ``dataset``, ...) pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplesmith.functions import text as T
from samplesmith.schema import RAW_FIELDS, with_fields

# ---------------------------------------------------------------------------
# Instructions and default texts, as published.
# ---------------------------------------------------------------------------
DEFAULT_TEXT_CODE_INSTRUCTION = "Write the Python function."
DEFAULT_QUESTION_INSTRUCTION = "Solve this coding problem."
APPS_SOLVE = "Solve this coding problem. Write the complete Python solution."
APPS_STARTER = "Complete this coding problem using the starter code provided."
EXPLAIN_WITH_DOC = "Explain this code based on the documentation."
HUMANEVAL_COMPLETE = "Complete the function. Write the complete Python code."
MBPP_WRITE = "Write the Python function to solve this problem."
ALPACA_DEFAULT = "Complete this coding task."
HUMANEVAL_SHORT = "Complete the function."
MBPP_SHORT = "Write the Python function."
CODESEA_SHORT = "Explain this code with its documentation."
ISSUE_INSTRUCTION = "Analyze and suggest fixes for this bug report or feature request."
PR_INSTRUCTION = "Summarize, review, and suggest improvements for this pull request."
COMMENT_INSTRUCTION = "Respond to this code review comment or developer discussion."
DISCUSSION_INSTRUCTION = "Analyze this developer discussion and provide reasoning."
DISCUSSION_OUTPUT = "Technical analysis and solution reasoning."
# ---------------------------------------------------------------------------


def _raw(df: DataFrame) -> DataFrame:
    return with_fields(df, RAW_FIELDS)


def _sample(instruction: Column, inp: Column, output: Column) -> Column:
    return F.struct(instruction.alias("instruction"), inp.alias("input"), output.alias("output"))


def _emit(df: DataFrame, keep: list[str], instruction: Column, inp: Column, output: Column,
          where: Column | None = None) -> DataFrame:
    if where is not None:
        df = df.where(where)
    return df.select(*keep, instruction.alias("instruction"), inp.alias("input"), output.alias("output"))


def _passthrough(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in RAW_FIELDS]


# --- W1 routing: P1-P4, F2, F3 ----------------------------------------------

def validate_raw(df: DataFrame) -> Column:
    """F2 ``validate_sample``: a truthy ``instruction`` or ``prompt``."""
    return T.truthy("instruction") | T.truthy("prompt")


def normalize_routed(df: DataFrame) -> DataFrame:
    """The first matching shape wins (prompt/completion, text/code,
    question/solutions, standard).  Applies F2 first, as the loader does."""
    df = _raw(df)
    keep = _passthrough(df)
    is_pc = F.col("prompt").isNotNull() & F.col("completion").isNotNull()
    is_tc = F.col("text").isNotNull() & F.col("code").isNotNull()
    is_qs = F.col("question").isNotNull() & F.col("solutions").isNotNull()
    p = T.s("prompt")
    instruction = (F.when(is_pc, F.coalesce(T.nonempty("instruction"), T.head(T.first_line(p), 200)))
                   .when(is_tc, F.coalesce(F.col("instruction"), F.lit(DEFAULT_TEXT_CODE_INSTRUCTION)))
                   .when(is_qs, F.coalesce(F.col("instruction"), F.lit(DEFAULT_QUESTION_INSTRUCTION)))
                   .otherwise(T.s("instruction")))
    inp = (F.when(is_pc, F.when(p.contains(T.NL), T.py_strip(T.after_first_newline(p))).otherwise(p))
           .when(is_tc, T.s("text"))
           .when(is_qs, T.s("question"))
           .otherwise(T.s("input")))
    out = (F.when(is_pc, T.s("completion"))
           .when(is_tc, T.s("code"))
           .when(is_qs, T.s("solutions"))
           .otherwise(T.s("output")))
    return _emit(df, keep, instruction, inp, out, where=validate_raw(df))


def is_nonempty() -> Column:
    """instruction or output non-empty after normalising."""
    return T.truthy("instruction") | T.truthy("output")


def keep_nonempty(df: DataFrame) -> DataFrame:
    return df.where(is_nonempty())


# --- problem sets: P5, P12 ---------------------------------------------------

def parsed_solutions(c: str | Column = "solutions") -> Column:
    """``json.loads(solutions)``, falling back to ``[solutions]`` when it is not JSON;
    null when it is missing or empty."""
    c = T.col(c)
    return F.when(T.truthy(c), F.coalesce(F.from_json(c, "array<string>"), F.array(c)))


def apps_samples(df: DataFrame) -> DataFrame:
    """P5: one solve-sample from the first solution, plus a completion-sample when
    ``starter_code`` is non-empty.  ``sample_no`` keeps their order."""
    df = _raw(df)
    keep = _passthrough(df)
    q = T.s("question")
    sols = parsed_solutions("solutions")
    solve = F.when(F.size(sols) > 0, _sample(F.lit(APPS_SOLVE), q, T.s(F.get(sols, 0))))
    starter = F.when(T.truthy("starter_code"),
                     _sample(F.lit(APPS_STARTER),
                             F.concat(F.lit("Problem:\n"), q, F.lit("\n\nStarter code:\n"), F.col("starter_code")),
                             F.lit("")))
    arr = F.filter(F.array(solve, starter), lambda x: x.isNotNull())
    return (df.select(*keep, F.posexplode(arr).alias("sample_no", "s"))
              .select(*keep, "sample_no", "s.instruction", "s.input", "s.output"))


def apps_with_difficulty(df: DataFrame) -> DataFrame:
    """P12 ``convert_apps_sample``: difficulty in the instruction, 800-char caps."""
    df = _raw(df)
    first = T.s(F.get(parsed_solutions("solutions"), 0))
    q = T.s("question")
    return _emit(df, _passthrough(df),
                 F.concat(F.lit("Solve this coding problem (Difficulty: "), T.s("difficulty"), F.lit(").")),
                 T.head(q, 800), T.head(first, 800),
                 where=T.truthy(q) & T.truthy(first))


# --- single-shape converters: P6-P10 ----------------------------------------

def code_doc_explain(df: DataFrame) -> DataFrame:
    """``func_documentation_string or code`` (sic) with the English doc."""
    df = _raw(df)
    code = T.first_nonempty("func_documentation_string", "code")
    doc = T.s("english_documentation")
    return _emit(df, _passthrough(df), F.lit(EXPLAIN_WITH_DOC),
                 F.concat(F.lit("Documentation:\n"), doc, F.lit("\n\nCode:\n"), code), F.lit(""),
                 where=T.truthy(code) & T.truthy(doc))


def instruction_passthrough(df: DataFrame) -> DataFrame:
    """Alpaca and OSS-instruct rows; empty instruction dropped."""
    df = _raw(df)
    return _emit(df, _passthrough(df), T.s("instruction"), T.s("input"), T.s("output"),
                 where=T.truthy("instruction"))


def function_completion(df: DataFrame) -> DataFrame:
    """Needs ``prompt`` and ``canonical_solution``."""
    df = _raw(df)
    return _emit(df, _passthrough(df), F.lit(HUMANEVAL_COMPLETE), T.s("prompt"), T.s("canonical_solution"),
                 where=T.truthy("prompt") & T.truthy("canonical_solution"))


def function_writing(df: DataFrame) -> DataFrame:
    """P10: needs ``text`` and ``code``."""
    df = _raw(df)
    return _emit(df, _passthrough(df), F.lit(MBPP_WRITE), T.s("text"), T.s("code"),
                 where=T.truthy("text") & T.truthy("code"))


def route_by_file_name(df: DataFrame, name_col: str = "dataset") -> DataFrame:
    """Route on the lower-cased file name: apps -> P5, codesearchnet -> P6,
    alpaca/oss -> P7, otherwise a generic row that needs an instruction.

    One pass: each branch yields an array of 0-2 samples, exploded once.
    """
    df = _raw(df)
    keep = _passthrough(df)
    name = F.lower(F.col(name_col))
    q = T.s("question")
    sols = parsed_solutions("solutions")
    apps = F.filter(F.array(
        F.when(F.size(sols) > 0, _sample(F.lit(APPS_SOLVE), q, T.s(F.get(sols, 0)))),
        F.when(T.truthy("starter_code"), _sample(
            F.lit(APPS_STARTER), F.concat(F.lit("Problem:\n"), q, F.lit("\n\nStarter code:\n"), F.col("starter_code")),
            F.lit("")))), lambda x: x.isNotNull())
    code = T.first_nonempty("func_documentation_string", "code")
    doc = T.s("english_documentation")
    csn = F.when(T.truthy(code) & T.truthy(doc), F.array(_sample(
        F.lit(EXPLAIN_WITH_DOC), F.concat(F.lit("Documentation:\n"), doc, F.lit("\n\nCode:\n"), code), F.lit(""))))
    plain = F.when(T.truthy("instruction"), F.array(_sample(T.s("instruction"), T.s("input"), T.s("output"))))
    routed = (F.when(name.contains("apps"), apps)
              .when(name.contains("codesearchnet"), csn)
              .when(name.contains("alpaca") | name.contains("oss"), plain)
              .otherwise(plain))
    return (df.select(*keep, F.posexplode(routed).alias("sample_no", "s"))
              .select(*keep, "sample_no", "s.instruction", "s.input", "s.output"))


# --- hub converters with caps: P13-P21 ---------------------------------------

def alpaca_hub(df: DataFrame) -> DataFrame:
    """Alpaca hub row with [:200]/[:500] caps; kept when the instruction is truthy (L3)."""
    df = _raw(df)
    p = T.s("prompt")
    instruction = F.when(T.truthy(p), T.head(T.first_line(p), 200)).otherwise(F.lit(ALPACA_DEFAULT))
    inp = F.when(p.contains(T.NL), T.head(T.py_strip(T.after_first_newline(p)), 500)).otherwise(T.head(p, 500))
    out = _emit(df, _passthrough(df), instruction, inp, T.head(T.s("completion"), 500))
    return out.where(T.truthy("instruction"))


def humaneval_hub(df: DataFrame) -> DataFrame:
    """Function completion with 500-char caps."""
    df = _raw(df)
    return _emit(df, _passthrough(df), F.lit(HUMANEVAL_SHORT), T.head(T.s("prompt"), 500),
                 T.head(T.s("canonical_solution"), 500))


def mbpp_hub(df: DataFrame) -> DataFrame:
    """Function writing with 500-char caps."""
    df = _raw(df)
    return _emit(df, _passthrough(df), F.lit(MBPP_SHORT), T.head(T.s("text"), 500), T.head(T.s("code"), 500))


def python_instruct_hub(df: DataFrame) -> DataFrame:
    """[:200]/[:500]/[:500]; kept when the instruction is truthy (L3)."""
    df = _raw(df)
    out = _emit(df, _passthrough(df), T.head(T.s("instruction"), 200), T.head(T.s("input"), 500),
                T.head(T.s("output"), 500))
    return out.where(T.truthy("instruction"))


def first_nonempty_a(df: DataFrame) -> DataFrame:
    """instruction|prompt|question; input|text|code; output|solution|completion|answer."""
    df = _raw(df)
    i = T.first_nonempty("instruction", "prompt", "question")
    x = T.first_nonempty("input", "text", "code")
    o = T.first_nonempty("output", "solution", "completion", "answer")
    return _emit(df, _passthrough(df), T.head(i, 200), T.head(x, 500), T.head(o, 500),
                 where=T.truthy(i) & T.truthy(o))


def first_nonempty_b(df: DataFrame) -> DataFrame:
    """instruction|prompt|question; input|text; output|completion|solution."""
    df = _raw(df)
    i = T.first_nonempty("instruction", "prompt", "question")
    x = T.first_nonempty("input", "text")
    o = T.first_nonempty("output", "completion", "solution")
    return _emit(df, _passthrough(df), T.head(i, 200), T.head(x, 500), T.head(o, 500),
                 where=T.truthy(i) & T.truthy(o))


def code_docstring(df: DataFrame, language: str = "python") -> DataFrame:
    """Code + docstring (or English documentation), [:600]/[:400]."""
    df = _raw(df)
    doc = T.first_nonempty("docstring", "english_documentation")
    return _emit(df, _passthrough(df), F.lit(f"Explain this {language} code with its documentation."),
                 T.head(T.s("code"), 600), T.head(doc, 400),
                 where=T.truthy("code") & T.truthy(doc))


def function_doc_short(df: DataFrame) -> DataFrame:
    """P20: code [:500] longer than 50 chars and a doc [:300]."""
    df = _raw(df)
    code = T.head(T.s("func_code_string"), 500)
    doc = T.head(T.s("func_documentation_string"), 300)
    return _emit(df, _passthrough(df), F.lit(CODESEA_SHORT), code, doc,
                 where=T.truthy(code) & T.truthy(doc) & (F.length(code) > 50))


def function_doc_multilang(df: DataFrame, lang_col: str = "lang") -> DataFrame:
    """Code longer than 50 chars, [:2000]; doc [:500] or "Function from <repo>"."""
    df = _raw(df)
    code = T.s("func_code_string")
    doc = T.col("func_documentation_string")
    repo = F.coalesce("repository_name", F.lit("codebase"))
    out = F.when(T.truthy(doc), T.head(doc, 500)).otherwise(F.concat(F.lit("Function from "), repo))
    return _emit(df, _passthrough(df), F.concat(F.lit("Explain this "), F.col(lang_col), F.lit(" code:")),
                 T.head(code, 2000), out, where=T.truthy(code) & (F.length(code) > 50))


# --- threads: P22-P25 ----------------------------------------------------------

# Columns the thread converters consume or replace (not passed through).
_THREAD_FIELDS = ("title", "body", "pull_request", "instruction", "input", "output")


def _title_body(title: str, body: str) -> Column:
    # M8 deviation: a null body renders as '' (the source prints "None").
    return F.concat(F.lit("Title: "), T.s(title), F.lit("\n\n"), T.s(body))


def issue_samples(df: DataFrame) -> DataFrame:
    """``Title: t\\n\\nbody``."""
    return df.select(*[c for c in df.columns if c not in _THREAD_FIELDS],
                     F.lit(ISSUE_INSTRUCTION).alias("instruction"),
                     _title_body("title", "body").alias("input"), F.lit("").alias("output"))


def pr_samples(df: DataFrame) -> DataFrame:
    """Same shape, PR instruction."""
    return df.select(*[c for c in df.columns if c not in _THREAD_FIELDS],
                     F.lit(PR_INSTRUCTION).alias("instruction"),
                     _title_body("title", "body").alias("input"), F.lit("").alias("output"))


def comment_samples(df: DataFrame) -> DataFrame:
    """The comment body as input."""
    return df.select(*[c for c in df.columns if c not in _THREAD_FIELDS],
                     F.lit(COMMENT_INSTRUCTION).alias("instruction"),
                     T.s("body").alias("input"), F.lit("").alias("output"))


def discussion_samples(df: DataFrame) -> DataFrame:
    """P25: body longer than 50 chars (F12), body [:500]."""
    body = T.s("body")
    return df.where(F.length(body) > 50).select(
        *[c for c in df.columns if c not in _THREAD_FIELDS],
        F.lit(DISCUSSION_INSTRUCTION).alias("instruction"),
        F.concat(F.lit("Title: "), T.s("title"), F.lit("\n\nDiscussion: "), T.head(body, 500)).alias("input"),
        F.lit(DISCUSSION_OUTPUT).alias("output"))


# --- reports and tags: P30, P31 -----------------------------------------------

def dataset_kind(path: str | Column) -> Column:
    """``cot`` / ``reasoning`` / ``standard`` from the file name."""
    name = F.element_at(F.split(T.col(path), "/"), -1)
    return (F.when(name.contains("cot"), F.lit("cot"))
            .when(name.contains("reasoning"), F.lit("reasoning"))
            .otherwise(F.lit("standard")))
