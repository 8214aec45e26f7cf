"""Python string semantics as native Spark column expressions.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so the
work stays inside whole-stage codegen; nothing here is a Python UDF.

Semantics carried over from the Python source behaviour:

* ``str.strip()`` removes every Unicode whitespace code point, while Spark's
  ``trim`` removes spaces only.  ``py_strip`` trims the full set with ``btrim``.
* ``len`` and slicing count code points; so do ``length`` and ``substring``.
* ``"a\\nb\\n".split("\\n")`` keeps the trailing empty part: ``split(x, '\\n', -1)``.
* ``a or b`` treats both ``None`` and ``""`` as false: ``first_nonempty``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The exact set of code points for which Python's str.isspace() is true,
# derived from the running interpreter rather than written out by hand.
PY_WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())

NL = "\n"
BIG = 2_147_483_647  # "to the end" for substring


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def s(c: str | Column) -> Column:
    """Null-safe string: ``None`` becomes ``''`` (our rule for missing fields)."""
    return F.coalesce(col(c), F.lit(""))


def truthy(c: str | Column) -> Column:
    """Python truthiness of an optional string: not None and not ''."""
    c = col(c)
    return c.isNotNull() & (F.length(c) > 0)


def nonempty(c: str | Column) -> Column:
    """``nullif(c, '')``: ``''`` counts as missing for ``or``-chains."""
    return F.nullif(col(c), F.lit(""))


def first_nonempty(*cols: str | Column, default: str = "") -> Column:
    """``a or b or c or default`` over optional strings."""
    return F.coalesce(*[nonempty(c) for c in cols], F.lit(default))


def py_strip(c: str | Column) -> Column:
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


def py_lstrip(c: str | Column) -> Column:
    return F.ltrim(col(c), F.lit(PY_WHITESPACE))


def py_rstrip(c: str | Column) -> Column:
    return F.rtrim(col(c), F.lit(PY_WHITESPACE))


def head(c: str | Column, n: int) -> Column:
    """``x[:n]`` in code points."""
    return F.substring(col(c), 1, n)


def lower_contains_any(c: str | Column, words: Iterable[str]) -> Column:
    """``any(w in x.lower() for w in words)`` — a substring test, not word-bounded."""
    low = F.lower(col(c))
    out = None
    for w in words:
        t = low.contains(w)
        out = t if out is None else (out | t)
    return out


def first_line(c: str | Column) -> Column:
    """``x.split("\\n")[0]``."""
    return F.substring_index(col(c), NL, 1)


def after_first_newline(c: str | Column) -> Column:
    """``x[x.find("\\n") + 1:]`` (whole string when there is no newline)."""
    c = col(c)
    return F.substring(c, F.instr(c, NL) + 1, F.lit(BIG))


def normalize_newlines(c: str | Column) -> Column:
    """Text-mode read: ``\\r\\n`` and lone ``\\r`` become ``\\n``."""
    return F.regexp_replace(col(c), "\r\n?", "\n")


def one_line(c: str | Column) -> Column:
    """``x.replace("\\n", " ")``."""
    return F.replace(col(c), F.lit(NL), F.lit(" "))


def lines(c: str | Column) -> Column:
    """``x.split("\\n")`` with Python's edge cases (trailing empty part kept)."""
    return F.split(col(c), NL, -1)


def head_lines(c: str | Column, n: int) -> Column:
    """``"\\n".join(x.split("\\n")[:n])``."""
    return F.array_join(F.slice(lines(c), 1, n), NL)


def line_chunks(c: str | Column, window: int, max_lines: int | None = None) -> Column:
    """Array of ``"\\n".join(lines[i:i+window])`` for ``i`` in ``range(0, len, window)``.

    ``max_lines`` bounds the range as in ``range(0, min(len(lines), max_lines), window)``.
    Built with ``sequence`` + ``transform`` so the split happens once per row and the
    chunks stay a JVM array (exploded by the caller with ``posexplode``).
    """
    arr = lines(c)
    n = F.size(arr)
    upper = n if max_lines is None else F.least(n, F.lit(max_lines))
    starts = F.sequence(F.lit(0), upper - 1, F.lit(window))
    return F.transform(starts, lambda i: F.array_join(F.slice(arr, i + 1, window), NL))


def utf8_lenient(c: str | Column) -> Column:
    """Decode bytes like ``errors="ignore"``: invalid sequences are dropped.

    (A genuine U+FFFD in the file is dropped too; accepted deviation.)
    """
    return F.replace(F.make_valid_utf8(col(c).cast("string")), F.lit("\ufffd"), F.lit(""))


def octet_length(c: str | Column) -> Column:
    return F.octet_length(col(c))
