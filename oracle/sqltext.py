"""DuckDB SQL mirrors of ``samplesmith.functions.text`` (for the oracle only)."""

from __future__ import annotations

import sys

PY_WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())
WS = "(" + " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"
NL = "chr(10)"


def lit(v: str) -> str:
    """A SQL string literal (raw newlines are fine inside quotes)."""
    return "'" + v.replace("'", "''") + "'"


def s(x: str) -> str:
    return f"coalesce({x}, '')"


def truthy(x: str) -> str:
    return f"({x} IS NOT NULL AND length({x}) > 0)"


def nonempty(x: str) -> str:
    return f"nullif({x}, '')"


def first_nonempty(*xs: str, default: str = "") -> str:
    return "coalesce(" + ", ".join(nonempty(x) for x in xs) + f", {lit(default)})"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def head(x: str, n) -> str:
    return f"substr({x}, 1, {n})"


def first_line(x: str) -> str:
    return f"split_part({x}, {NL}, 1)"


def after_first_newline(x: str) -> str:
    return f"substr({x}, strpos({x}, {NL}) + 1)"


def one_line(x: str) -> str:
    return f"replace({x}, {NL}, ' ')"


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {lit(w)})" for w in words) + ")"


def pick(values, idx: str) -> str:
    return "list_extract([" + ", ".join(lit(v) for v in values) + f"], ({idx}) + 1)"


def lines(x: str) -> str:
    return f"string_split({x}, {NL})"


def head_lines(x: str, n: int) -> str:
    return f"array_to_string(list_slice({lines(x)}, 1, {n}), {NL})"


def cascade(x: str, rules, default: str) -> str:
    parts = " ".join(f"WHEN {contains_any(s(x), words)} THEN {lit(label)}" for words, label in rules)
    return f"(CASE {parts} ELSE {lit(default)} END)"
