"""Prompt rendering and training-row assembly.

The subword tokenizer is not rebuilt: C26 takes token-id arrays (any
tokenizer's output table) and assembles fixed-length rows with array
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplesmith.functions import text as T

# ---------------------------------------------------------------------------
# Prompt templates and service prompts, as published.
# ---------------------------------------------------------------------------
PROMPT_TEMPLATES = {
    "inst": "[INST] {instruction}\n{input} [/INST]\n{output}",
    "chat": "<|system|>\nYou are an expert coding assistant with reasoning and tool-use capabilities.<|end|>\n"
            "<|user|>\n{instruction}\n{input}<|end|>\n<|assistant|>\n{output}",
    "cot": "## Task\n{instruction}\n\n## Input\n{input}\n\n## Reasoning\nLet me analyze this step by step:\n\n{output}",
}
SERVICE_SYSTEM_PROMPT = (
    "[INST] You are an expert coding assistant. Provide accurate, well-commented code with explanations. "
    "Specialize in Python, Kotlin, Java, and Android/Jetpack Compose. [/INST]\n")
SERVICE_DEFAULT_INSTRUCTION = "Answer this coding question."
SERVICE_DEFAULT_INPUT = ""
IGNORE_LABEL = -100
DEFAULT_MAX_SEQ = 2048
# ---------------------------------------------------------------------------


def fill_template(template: str, **cols: Column) -> Column:
    """``template.format(**cols)`` as a ``concat`` of literals and columns."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        pre, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if pre:
            parts.append(F.lit(pre))
        parts.append(T.s(cols[name]))
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def render_prompt(style: str = "inst") -> Column:
    """C19 ``format_sample`` text: unknown styles fall back to ``inst``."""
    template = PROMPT_TEMPLATES.get(style, PROMPT_TEMPLATES["inst"])
    return fill_template(template, instruction=F.col("instruction"), input=F.col("input"), output=F.col("output"))


def render_prompt_by_column(style_col: str = "style") -> Column:
    """C19 with the style taken per row (``CASE style``)."""
    st = F.col(style_col)
    return (F.when(st == "chat", render_prompt("chat"))
            .when(st == "cot", render_prompt("cot"))
            .otherwise(render_prompt("inst")))


def render_chat_request(instruction: str | Column = "instruction", inp: str | Column = "input") -> Column:
    """C20: service prompt = system prefix + ``[INST] {instruction}\\n{input} [/INST]\\n``,
    with the request defaults for missing fields."""
    i = F.coalesce(T.col(instruction), F.lit(SERVICE_DEFAULT_INSTRUCTION))
    x = F.coalesce(T.col(inp), F.lit(SERVICE_DEFAULT_INPUT))
    return F.concat(F.lit(SERVICE_SYSTEM_PROMPT), fill_template("[INST] {instruction}\n{input} [/INST]\n",
                                                                 instruction=i, input=x))


def compose_request(task_type: str | Column, context: str | Column) -> Column:
    """``instruction_type + " " + system_context``."""
    return F.concat(T.s(task_type), F.lit(" "), T.s(context))


def fixed_length(tokens: str | Column, max_seq: int = DEFAULT_MAX_SEQ, pad_id: int = 0) -> dict[str, Column]:
    """Truncate to ``max_seq``, right-pad with ``pad_id``; mask 1 for real
    tokens; labels are a copy of the ids (padding included, as the source does)."""
    t = F.slice(T.col(tokens), 1, max_seq)
    n = F.size(t)
    pad = F.lit(max_seq) - n
    ids = F.concat(t, F.array_repeat(F.lit(pad_id), pad))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), pad))
    return {"input_ids": ids, "attention_mask": mask, "labels": ids}


def exact_mean(value: str | Column) -> Column:
    """The mean of doubles, the same to the last bit however the rows are dealt to tasks.

    Each value is rounded once, to 18 decimal places; integers of that scale add up in any order
    (to 10**20 in all).  A value that is no number, or infinite, makes the mean that of plain ``avg``.
    """
    v = T.col(value).cast("double")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    mean = F.sum(F.when(~odd, v).cast("decimal(38,18)")).cast("double") / F.count(v)
    return F.when(F.bool_or(odd), F.avg(v)).otherwise(mean)


def loss_and_perplexity(token_loss: DataFrame) -> DataFrame:
    """A10: mean NLL over tokens whose label is not -100, and ``exp`` of it."""
    kept = token_loss.where(F.col("label") != IGNORE_LABEL)
    return kept.agg(exact_mean("nll").alias("eval_loss"), F.count(F.lit(1)).alias("tokens")) \
        .withColumn("eval_perplexity", F.exp("eval_loss"))


def steps_per_epoch(train_rows: Column, batch_size: int, grad_accum: int) -> Column:
    """``len(train) // (batch * accum)``."""
    return F.floor(train_rows / F.lit(batch_size * grad_accum)).cast("bigint")


# Python's urlparse splits scheme://netloc/path?query#fragment; we take the path.
URL_PATH_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def resolve_repo(target: str | Column, model_name: str) -> Column:
    """C25 ``resolve_hf_repo``: URL or id -> ``namespace/model``."""
    t = F.rtrim(T.py_strip(T.s(target)), F.lit("/"))
    is_url = t.startswith("http://") | t.startswith("https://")
    path = F.when(is_url, F.regexp_extract(t, URL_PATH_RE, 1)).otherwise(t)
    parts = F.filter(F.split(path, "/", -1), lambda p: p != "")
    return (F.when(F.length(t) == 0, F.lit(""))
            .when(F.size(parts) == 1, F.concat(F.get(parts, 0), F.lit("/" + model_name)))
            .when(F.size(parts) >= 2, F.concat(F.get(parts, 0), F.lit("/"), F.get(parts, 1)))
            .otherwise(F.lit("")))


def parse_repo_url(url: str | Column) -> dict[str, Column]:
    """C24 ``parse_repo_url``: the last two path parts; every ``.git`` removed from the repo."""
    # try_element_at: a URL with no "/" yields null for the owner instead of
    # failing the whole job (the source would raise on that one row).
    parts = F.split(F.rtrim(T.s(url), F.lit("/")), "/", -1)
    return {"owner": F.try_element_at(parts, F.lit(-2)),
            "repo": F.replace(F.try_element_at(parts, F.lit(-1)), F.lit(".git"), F.lit(""))}


def rewrite_identifiers(code: str | Column) -> Column:
    """When the code contains ``n``: ``s`` -> ``str``, then ``n`` -> ``num``."""
    c = T.s(code)
    return F.when(c.contains("n"), F.replace(F.replace(c, F.lit("s"), F.lit("str")), F.lit("n"), F.lit("num"))) \
        .otherwise(c)
