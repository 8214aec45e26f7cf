"""Source files -> samples: filters, chunkers and snippet extractors
(F5-F10, L4, P26-P29).

Input is a file table ``(repo, path, length, content)`` as produced by
``samplesmith.sources.trees.scan_tree`` (or an adapter).  Everything is a
narrow projection + ``posexplode`` of a per-row array, except the per-repo
file cap (L4): the salted two-stage ``head_per_group`` with partial
``WindowGroupLimit`` s, applied to short snippet rows (never whole files), so
even a repository with a third of all files ships at most ``n`` rows per map
task and reaches its final task as at most ``n * buckets`` rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplesmith.functions import text as T
from samplesmith.operators.limits import head_per_group

# ---------------------------------------------------------------------------
# Extension lists, pruned directories, skip words, windows and
# sample texts of the tree scanners, as published.
# ---------------------------------------------------------------------------
TREE_EXTS = [".py", ".js", ".ts", ".java", ".kt", ".cpp", ".xml"]            # W3
TREE_SKIP_WORDS = ["node_modules", ".gradle", "build", "__pycache__", ".git"]  # F7
TREE_WINDOW = 40
TREE_MIN_CHARS, TREE_MAX_CHARS = 50, 50000                                     # F9
CHUNK_MIN_STRIPPED = 20                                                         # F10

TASKS = [  # P27, in order; the first carries the language hint
    "Explain what this code does",
    "Find potential bugs, errors, or security issues in this code",
    "Refactor and improve this code for better performance and readability",
    "Write comprehensive unit tests for this code",
]


@dataclass(frozen=True)
class SnippetSource:
    """One repo-snippet scanner (P26a-d)."""
    exts: tuple
    pruned_dirs: tuple
    min_bytes: int | None   # exclusive lower bound
    max_bytes: int          # exclusive upper bound
    files_per_repo: int
    lines: int
    chars: int
    instruction: str        # '{ext}' is replaced by the extension without dot
    output: str


SNIPPET_SOURCES = {
    "a": SnippetSource((".py", ".js", ".ts", ".java", ".kt", ".cpp", ".go", ".rs"),
                       (".git", "node_modules", "build", "dist", "__pycache__", ".venv", "venv", "test", "tests"),
                       50, 50000, 500, 40, 600,
                       "Explain this {ext} code snippet.", "This is {ext} code that needs explanation."),
    "b": SnippetSource((".py", ".js", ".ts", ".java", ".kt", ".cpp", ".go", ".rs"),
                       (".git", "node_modules", "build", "dist", "__pycache__", ".venv"),
                       None, 50000, 300, 40, 600,
                       "Explain this {ext} code.", "Code snippet in {ext}."),
    "c": SnippetSource((".py", ".js", ".ts", ".go", ".rs", ".java", ".kt", ".rb", ".php"),
                       (".git", "node_modules", "__pycache__", "vendor", "dist", "build"),
                       None, 25000, 150, 40, 500,
                       "Explain this {ext} code.", "Code snippet in {ext}."),
    "d": SnippetSource((".py", ".js", ".ts", ".go", ".rs", ".java", ".kt"),
                       (".git", "node_modules", "build", "__pycache__", ".venv", "venv"),
                       None, 30000, 200, 50, 600,
                       "Explain this {ext} code.", "Code snippet."),
}

PY_TREE_PRUNED = ("venv", "env", "node_modules", "__pycache__")  # S8, plus any dot-directory
PY_TREE_WINDOW, PY_TREE_MAX_LINES, PY_TREE_MIN_CHARS = 20, 80, 100  # P29
# ---------------------------------------------------------------------------


def file_name(path: str | Column = "path") -> Column:
    return F.element_at(F.split(T.col(path), "/"), -1)


def parent_dirs(path: str | Column = "path") -> Column:
    """Directory segments of a relative path (the file name excluded)."""
    parts = F.split(T.col(path), "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def extension(path: str | Column = "path") -> Column:
    """``os.path.splitext(path)[1].lstrip('.')`` for names with a dot."""
    return F.regexp_extract(F.regexp_replace(file_name(path), r"\A\.+", ""), r"\.([^.]*)\z", 1)  # \z: Java's $ also matches before a final newline


def has_extension(exts, path: str | Column = "path") -> Column:
    """``any(name.endswith(ext) for ext in exts)`` (case-sensitive)."""
    name = file_name(path)
    out = None
    for e in exts:
        t = name.endswith(e)
        out = t if out is None else (out | t)
    return out


def not_in_pruned_dir(dirs, path: str | Column = "path") -> Column:
    """no directory segment is one of ``dirs``."""
    return ~F.arrays_overlap(parent_dirs(path), F.array(*[F.lit(d) for d in dirs]))


def not_in_hidden_or_pruned_dir(dirs, path: str | Column = "path") -> Column:
    """F6 (S8 variant): no dot-directory and no directory in ``dirs``."""
    segs = parent_dirs(path)
    return not_in_pruned_dir(dirs, path) & ~F.exists(segs, lambda d: d.startswith("."))


def name_has_no_skip_word(words, path: str | Column = "path") -> Column:
    """the file *name* (directories are not tested) contains none of ``words``."""
    name = file_name(path)
    out = None
    for w in words:
        t = ~name.contains(w)
        out = t if out is None else (out & t)
    return out


def byte_bound(min_bytes: int | None, max_bytes: int | None) -> Column:
    """F8 on the ``length`` column (pushed into a ``binaryFile`` scan)."""
    c = F.lit(True)
    if min_bytes is not None:
        c = c & (F.col("length") > min_bytes)
    if max_bytes is not None:
        c = c & (F.col("length") < max_bytes)
    return c


def char_bound(content: str = "content") -> Column:
    """50 <= len(code) <= 50000 characters."""
    n = F.length(T.col(content))
    return (n >= TREE_MIN_CHARS) & (n <= TREE_MAX_CHARS)


def chunk_rows(df: DataFrame, window: int, content: str = "content", max_lines: int | None = None) -> DataFrame:
    """Explode ``content`` into ``(chunk_no, chunk)`` windows of ``window`` lines."""
    return df.select("*", F.posexplode(T.line_chunks(content, window, max_lines)).alias("chunk_no", "chunk"))


def tree_chunks(files: DataFrame) -> DataFrame:
    """P28a + F9 + F10: 40-line chunks whose stripped text is longer than 20 chars
    (the generator's own non-blank test is implied by that)."""
    f = files.where(char_bound())
    c = chunk_rows(f, TREE_WINDOW)
    return c.where(F.length(T.py_strip("chunk")) > CHUNK_MIN_STRIPPED)


def min_chunks(df: DataFrame, window: int = 40, content: str = "content") -> DataFrame:
    """Variable window; keep chunks whose stripped length is above 20."""
    c = chunk_rows(df, window, content)
    return c.where(F.length(T.py_strip("chunk")) > CHUNK_MIN_STRIPPED)


def task_fanout(chunks: DataFrame) -> DataFrame:
    """P27 ``generate_samples``: each chunk -> four task samples (``task_no`` 0-3).
    A literal four-element array exploded per row: no join, no shuffle."""
    ext = extension("path")
    hint = F.when(ext != "", F.concat(F.lit(" ("), ext, F.lit(" code)"))).otherwise(F.lit(""))
    tasks = F.array(F.concat(F.lit(TASKS[0]), hint), *[F.lit(t) for t in TASKS[1:]])
    keep = [c for c in chunks.columns if c not in ("content", "chunk")]
    return chunks.select(*keep, F.posexplode(tasks).alias("task_no", "instruction"),
                         F.col("chunk").alias("input"), F.lit("").alias("output"))


def snippet_samples(files: DataFrame, source: SnippetSource) -> DataFrame:
    """P26 (a-d) with F5, F6, F8 and L4: per repo the first ``files_per_repo``
    eligible files in path order, then the head-lines snippet with its length test."""
    return snippet_samples_multi(files, {"_": source}).drop("variant")


def _eligible(source: SnippetSource) -> Column:
    return (byte_bound(source.min_bytes, source.max_bytes) & has_extension(source.exts)
            & not_in_pruned_dir(source.pruned_dirs))


def _fill(tpl: str, ext: Column) -> Column:
    if "{ext}" not in tpl:
        return F.lit(tpl)
    a, b = tpl.split("{ext}")
    return F.concat(F.lit(a), ext, F.lit(b))


def snippet_samples_multi(files: DataFrame, sources: dict[str, SnippetSource]) -> DataFrame:
    """P26 for several scanners at once (W10): one scan, one ranking.

    Each file is tagged with every scanner whose filters it passes; the
    snippet (at most 40-50 lines, cut to the scanner's character cap plus its
    length) is computed *before* the per-repo ranking, so the shuffle carries
    short text, never whole files.  One salted two-stage ranking over
    ``(variant, repo)`` serves all scanners (partial limit = the largest cap;
    each scanner's own cap is applied after)."""
    # The widest byte bounds over all scanners: a plain range on ``length`` that
    # the scan can take as a pushed filter, so oversize files are never read.
    mins = [s.min_bytes for s in sources.values()]
    envelope = byte_bound(None if None in mins else min(mins), max(s.max_bytes for s in sources.values()))
    tags = F.filter(F.array(*[F.when(_eligible(s), F.lit(k)) for k, s in sources.items()]), lambda x: x.isNotNull())
    f = files.where(envelope).select("repo", "path", "content", F.explode(tags).alias("variant"))

    def per_variant(pick):
        expr = None
        for k, s in sources.items():
            v = pick(s)
            expr = F.when(F.col("variant") == k, v) if expr is None else expr.when(F.col("variant") == k, v)
        return expr

    snippet = per_variant(lambda s: T.head_lines("content", s.lines))
    f = f.select("variant", "repo", "path", snippet.alias("snippet"))
    f = f.select("variant", "repo", "path", F.length("snippet").alias("snippet_chars"),
                 per_variant(lambda s: T.head("snippet", s.chars)).alias("input"))
    ranked = head_per_group(f, ["variant", "repo"], ["path"], max(s.files_per_repo for s in sources.values()))
    ranked = ranked.where(F.col("rank_in_group") <= per_variant(lambda s: F.lit(s.files_per_repo)))
    ext = extension("path")
    return (ranked.where(F.col("snippet_chars") > 100)
                  .select("variant", "repo", "path",
                          per_variant(lambda s: _fill(s.instruction, ext)).alias("instruction"), "input",
                          per_variant(lambda s: _fill(s.output, ext)).alias("output")))


def line_provenance_chunks(files: DataFrame, name: str) -> DataFrame:
    """20-line windows over the first 80 lines of ``.py`` files outside dot
    and virtualenv directories; raw length > 100; path and line range in the
    instruction."""
    f = files.where(has_extension([".py"]) & not_in_hidden_or_pruned_dir(PY_TREE_PRUNED))
    c = chunk_rows(f, PY_TREE_WINDOW, max_lines=PY_TREE_MAX_LINES).where(F.length("chunk") > PY_TREE_MIN_CHARS)
    first = F.col("chunk_no") * PY_TREE_WINDOW + 1
    return c.select(
        "repo", "path", "chunk_no",
        F.concat(F.lit(f"Explain this code from {name} ("), F.col("path"), F.lit(", lines "),
                 first.cast("string"), F.lit("-"), (first + PY_TREE_WINDOW - 1).cast("string"),
                 F.lit("):")).alias("instruction"),
        F.col("chunk").alias("input"),
        F.lit(f"The code implements {name} functionality.").alias("output"))
