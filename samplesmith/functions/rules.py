"""Keyword cascades over an instruction.

Every rule is an ordered ``CASE WHEN lower(x) LIKE '%kw%'`` cascade: the first
hit wins and the test is a plain substring test ("api" hits "rapid").
The cascades are data (lists of ``(keywords, label)``) turned into one
``when().when().otherwise()`` expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from samplesmith.functions import text as T

# ---------------------------------------------------------------------------
# These keyword lists, labels and phrases must equal the source
# behaviour exactly, in this order (first hit wins).
# ---------------------------------------------------------------------------

PROBLEM_CLASSES = [  # C1
    (("write", "create", "implement"), "code_generation"),
    (("fix", "debug", "bug"), "bug_fix"),
    (("explain", "describe"), "explanation"),
    (("optimize", "improve"), "optimization"),
    (("find", "search"), "search"),
]
PROBLEM_CLASS_DEFAULT = "general"

ACTIONS = [  # C2
    (("write", "create", "implement"), "create new code"),
    (("fix", "debug", "bug"), "debug existing code"),
    (("explain", "describe"), "explain code"),
    (("optimize", "improve"), "optimize code"),
    (("find", "search"), "find/search code"),
]
ACTION_DEFAULT = "process the request"

STRATEGIES = [  # C3
    (("write", "create"), "write the code from scratch following best practices"),
    (("fix", "bug"), "identify and fix the issue"),
    (("explain",), "explain the code clearly with examples"),
    (("optimize",), "improve performance and readability"),
]
STRATEGY_DEFAULT = "generate appropriate solution"

CONSIDERATIONS = [  # C4
    (("sort",), "empty lists, single elements, duplicate values"),
    (("search", "find"), "element not found, empty input"),
    (("reverse",), "empty strings, single characters"),
    (("parse", "validate"), "invalid input, edge cases, error handling"),
]
CONSIDERATION_DEFAULT = "basic functionality, edge cases, error handling"

TOOL_KEYWORDS = ["fetch", "api", "http", "search", "read", "write", "file", "create", "execute", "run"]  # C5

PROBLEM_SUMMARY_EMPTY = "process the given instruction"  # C10
INPUT_SUMMARY_EMPTY = "no additional input provided"  # C11

# ---------------------------------------------------------------------------


def cascade(x: str | Column, rules, default: str) -> Column:
    """First matching ``(keywords, label)`` wins; ``default`` otherwise."""
    expr = None
    for words, label in rules:
        cond = T.lower_contains_any(T.s(x), words)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def classify_problem(instruction) -> Column:
    """C1 ``classify_problem``: one of six classes."""
    return cascade(instruction, PROBLEM_CLASSES, PROBLEM_CLASS_DEFAULT)


def determine_action(instruction) -> Column:
    """C2 ``determine_action``."""
    return cascade(instruction, ACTIONS, ACTION_DEFAULT)


def generate_strategy(instruction) -> Column:
    """C3 ``generate_strategy`` (the output argument is unused by the rule)."""
    return cascade(instruction, STRATEGIES, STRATEGY_DEFAULT)


def generate_consideration(instruction) -> Column:
    """C4 ``generate_consideration``."""
    return cascade(instruction, CONSIDERATIONS, CONSIDERATION_DEFAULT)


def should_use_tools(instruction) -> Column:
    """C5 ``should_use_tools``: any tool keyword as a substring."""
    return T.lower_contains_any(T.s(instruction), TOOL_KEYWORDS)


def summarize_problem(input_text) -> Column:
    """``text[:100].replace("\\n", " ").strip()`` or a default when empty."""
    x = T.col(input_text)
    return F.when(T.truthy(x), T.py_strip(T.one_line(T.head(x, 100)))).otherwise(F.lit(PROBLEM_SUMMARY_EMPTY))


def summarize_input(input_text) -> Column:
    """C11: ``text[:80].replace("\\n", " ").strip()`` or a default when empty."""
    x = T.col(input_text)
    return F.when(T.truthy(x), T.py_strip(T.one_line(T.head(x, 80)))).otherwise(F.lit(INPUT_SUMMARY_EMPTY))
