"""Tool catalogue and tool-call synthesis.

The catalogue is a constant rendered once on the driver; the per-row tool call
is a ``CASE`` cascade whose branches each concatenate a JSON object.

The call JSON is byte-for-byte Python's ``json.dumps`` output (spacing,
short escapes, ``\\uXXXX`` for non-ASCII), built from native string functions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from samplesmith.functions import text as T

# ---------------------------------------------------------------------------
# Tool definitions, in catalogue order, exactly as published.
# ---------------------------------------------------------------------------

TOOL_DEFINITIONS = [
    {
        "name": "python_executor",
        "description": "Execute Python code and return the result. Use for running calculations, data processing, and algorithm implementation.",
        "input_schema": {
            "type": "object",
            "properties": {"code": {"type": "string", "description": "Python code to execute"}},
            "required": ["code"],
        },
    },
    {
        "name": "file_reader",
        "description": "Read contents of a file from the filesystem.",
        "input_schema": {
            "type": "object",
            "properties": {
                "path": {"type": "string", "description": "Full path to file"},
                "lines": {"type": "integer", "description": "Number of lines to read (default 100)"},
            },
            "required": ["path"],
        },
    },
    {
        "name": "file_writer",
        "description": "Write content to a file.",
        "input_schema": {
            "type": "object",
            "properties": {
                "path": {"type": "string", "description": "Full path to file"},
                "content": {"type": "string", "description": "Content to write"},
            },
            "required": ["path", "content"],
        },
    },
    {
        "name": "web_search",
        "description": "Search the web for information, documentation, or code examples.",
        "input_schema": {
            "type": "object",
            "properties": {"query": {"type": "string", "description": "Search query"}},
            "required": ["query"],
        },
    },
    {
        "name": "git_clone",
        "description": "Clone a GitHub repository to get code samples.",
        "input_schema": {
            "type": "object",
            "properties": {"repo_url": {"type": "string", "description": "GitHub repository URL"}},
            "required": ["repo_url"],
        },
    },
    {
        "name": "code_search",
        "description": "Search code in a local repository for specific patterns or functions.",
        "input_schema": {
            "type": "object",
            "properties": {
                "pattern": {"type": "string", "description": "Regex pattern to search"},
                "path": {"type": "string", "description": "Directory to search in"},
            },
            "required": ["pattern"],
        },
    },
]

# Tool-choice cascade (C6), first hit wins.
WEB_WORDS = ("fetch", "api", "http")
READ_WORDS = ("read", "file")
WRITE_WORDS = ("save", "write", "create")
SEARCH_WORDS = ("search", "find")
CLONE_WORDS = ("clone", "repo", "github")
DEFAULT_READ_PATH = "example.py"
READ_LINES = 50
WRITE_PATH = "output.py"
SEARCH_PATH = "."
DEFAULT_REPO_URL = "https://github.com/example/repo"
DEFAULT_PATTERN = "def .*"
EMPTY_CODE = "pass"

# ---------------------------------------------------------------------------

# The catalogue as an indented JSON block, built once on the driver.
TOOL_CATALOGUE_JSON = json.dumps(TOOL_DEFINITIONS, indent=2)

# Python's \w for str patterns is Unicode-aware: letters, digits, underscore.
WORD = r"\p{L}\p{N}_"
_WS_CLASS = "".join("\\x{%x}" % ord(c) for c in T.PY_WHITESPACE)
PATH_QUOTED_RE = "[\"']([" + WORD + "/]+\\.py)[\"']"
PATH_BARE_RE = "([" + WORD + "/]+\\.py)"
GITHUB_RE = "github\\.com/[" + WORD + "-]+/[" + WORD + "-]+"
URL_RE = "https?://[" + WORD + "./-]+"
FIRST_WORD_RE = "^[" + _WS_CLASS + "]*([^" + _WS_CLASS + "]+)"


def extract_file_path(x) -> Column:
    """Quoted ``.py`` path first, else a bare one; ``None`` when absent."""
    x = T.s(x)
    return F.coalesce(
        T.nonempty(F.regexp_extract(x, PATH_QUOTED_RE, 1)),
        T.nonempty(F.regexp_extract(x, PATH_BARE_RE, 1)),
    )


def extract_pattern(x) -> Column:
    """``def <first whitespace-separated word>`` or ``def .*``."""
    first = T.nonempty(F.regexp_extract(T.s(x), FIRST_WORD_RE, 1))
    return F.when(first.isNotNull(), F.concat(F.lit("def "), first)).otherwise(F.lit(DEFAULT_PATTERN))


def extract_github_url(x) -> Column:
    """``https://github.com/owner/repo`` or the first URL mentioning github."""
    x = T.s(x)
    gh = T.nonempty(F.regexp_extract(x, GITHUB_RE, 0))
    url = T.nonempty(F.regexp_extract(x, URL_RE, 0))
    return (
        F.when(gh.isNotNull(), F.concat(F.lit("https://"), gh))
        .when(url.isNotNull() & F.lower(url).contains("github"), url)
    )


_PLAIN_ASCII_RE = r'^[ !#-\[\]-~]*\z'  # printable ASCII without '"' and '\'
_SHORT_ESCAPES = [('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"),
                  ("\f", "\\f")]


_NO_CONTROL_RE = r'^[^\x00-\x1f"\\]*\z'  # nothing to escape when ensure_ascii is off
_OTHER_CONTROL_RE = r'[\x00-\x07\x0b\x0e-\x1f]'  # control characters without a short escape


def json_string(c, ensure_ascii: bool = True) -> Column:
    """A JSON string literal exactly as Python's ``json.dumps`` writes it:
    short escapes for quote, backslash and \\n \\r \\t \\b \\f; ``\\uXXXX``
    (lower-case hex) for other control characters and — with ``ensure_ascii`` —
    for every code point outside space..tilde (a surrogate pair above U+FFFF).
    Strings with nothing to escape skip the per-code-point path."""
    c = T.col(c)
    if not ensure_ascii:
        def esc_raw(ch: Column) -> Column:
            cp = F.ascii(ch)
            expr = None
            for raw, out in _SHORT_ESCAPES:
                expr = F.when(ch == raw, F.lit(out)) if expr is None else expr.when(ch == raw, F.lit(out))
            return expr.when(cp < 32, F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(cp), 4, "0")))).otherwise(ch)
        # Fast path: the seven short escapes as plain replaces (backslash first);
        # the per-code-point path only when another control character is present.
        short = c
        for raw, out in [_SHORT_ESCAPES[1]] + [e for e in _SHORT_ESCAPES if e[0] != "\\"]:
            short = F.replace(short, F.lit(raw), F.lit(out))
        body = (F.when(c.rlike(_NO_CONTROL_RE), c)
                .when(~c.rlike(_OTHER_CONTROL_RE), short)
                .otherwise(F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), 0), esc_raw), "")))
        return F.concat(F.lit('"'), body, F.lit('"'))

    def hex4(n: Column) -> Column:
        return F.lower(F.lpad(F.hex(n), 4, "0"))

    def esc(ch: Column) -> Column:
        cp = F.ascii(ch)
        expr = None
        for raw, out in _SHORT_ESCAPES:
            expr = F.when(ch == raw, F.lit(out)) if expr is None else expr.when(ch == raw, F.lit(out))
        high = F.lit(0xD800) + F.shiftright(cp - 0x10000, 10)
        low = F.lit(0xDC00) + (cp - 0x10000).bitwiseAND(0x3FF)
        return (expr.when((cp >= 32) & (cp <= 126), ch)
                .when(cp > 0xFFFF, F.concat(F.lit("\\u"), hex4(high), F.lit("\\u"), hex4(low)))
                .otherwise(F.concat(F.lit("\\u"), hex4(cp))))

    body = F.when(c.rlike(_PLAIN_ASCII_RE), c).otherwise(
        F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), 0), esc), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


TOOL_CALL_SCHEMA = "struct<tool: string, args: map<string, string>>"


def parse_tool_call(c) -> Column:
    """A tool-call JSON string as ``struct<tool, args map<string,string>>``
    (numbers such as ``lines`` come back as their text)."""
    return F.from_json(T.col(c), TOOL_CALL_SCHEMA)


def tool_name(instruction) -> Column:
    """C6, first half: which tool the instruction asks for."""
    i = T.s(instruction)
    return (
        F.when(T.lower_contains_any(i, WEB_WORDS), F.lit("web_search"))
        .when(T.lower_contains_any(i, READ_WORDS), F.lit("file_reader"))
        .when(T.lower_contains_any(i, WRITE_WORDS), F.lit("file_writer"))
        .when(T.lower_contains_any(i, SEARCH_WORDS), F.lit("code_search"))
        .when(T.lower_contains_any(i, CLONE_WORDS), F.lit("git_clone"))
        .otherwise(F.lit("python_executor"))
    )


def tool_call_json(instruction, input_text, output) -> Column:
    """C6 ``create_tool_calling_example``: ``{"tool": ..., "args": {...}}`` as JSON text."""
    i, x, o = T.s(instruction), T.s(input_text), T.s(output)
    name = tool_name(instruction)

    def call(tool: str, **args) -> Column:
        # Python's json.dumps layout: ", " and ": " separators; strings escaped
        # by json_string, integers as digits.
        parts: list[Column] = [F.lit('{"tool": "' + tool + '", "args": {')]
        for k, (key, v) in enumerate(args.items()):
            parts.append(F.lit((", " if k else "") + '"' + key + '": '))
            parts.append(v.cast("string") if key == "lines" else json_string(v))
        parts.append(F.lit("}}"))
        return F.concat(*parts)

    return (
        F.when(name == "web_search",
               call("web_search", query=F.when(T.truthy(x), T.head(x, 100)).otherwise(i)))
        .when(name == "file_reader",
              call("file_reader", path=F.coalesce(extract_file_path(x), F.lit(DEFAULT_READ_PATH)),
                   lines=F.lit(READ_LINES)))
        .when(name == "file_writer",
              call("file_writer", path=F.lit(WRITE_PATH), content=T.head(o, 200)))
        .when(name == "code_search",
              call("code_search", pattern=extract_pattern(i), path=F.lit(SEARCH_PATH)))
        .when(name == "git_clone",
              call("git_clone", repo_url=F.coalesce(extract_github_url(x), F.lit(DEFAULT_REPO_URL))))
        .otherwise(call("python_executor", code=F.when(T.truthy(o), T.head(o, 200)).otherwise(F.lit(EMPTY_CODE))))
    )
