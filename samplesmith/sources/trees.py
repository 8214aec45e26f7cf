"""Source-tree scans (S6-S8) as ``binaryFile`` reads.

The extension test becomes a ``pathGlobFilter`` (applied while listing), and
the byte-size bound is a filter on the ``length`` column that Spark pushes
into the scan (``PushedFilters: LessThan(length, ...)``), so oversize files
are never opened.  Column pruning keeps ``content`` unread when only paths
are needed.  Pruned directories are never descended into.  Spark's readers
pass over names that begin with ``_`` or ``.`` (``__init__.py``); the tasks
read those files by their listed paths, the one place of the core that runs
Python in tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplesmith.functions import text as T


GLOB = re.compile(r"([\\{}\[\]*?,])")


FILES = "path string, modificationTime timestamp, length long, content binary"
HIDDEN = (".", "_")  # beginnings of names that Spark's readers pass over


def listing(spark: SparkSession, root: str, exts: list[str] | None = None, pruned: tuple | list = (),
            hidden: bool = True) -> tuple[list[str], list[tuple[str, int]]]:
    """What lies under ``root`` outside the pruned folders: the folders that hold a wanted file which Spark's readers
    see (``root`` itself included), and path and size of the wanted files that they pass over, all in path order.

    A folder of a pruned name, and with ``hidden=False`` one whose name begins with a dot, is never listed: what
    lies in it, however much, costs nothing.  Files in a folder that Spark passes over are listed as it would pass over them.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    seen, passed, todo = [], [], [top]
    while todo:
        at, wanted = todo.pop(), False
        for f in fs.listStatus(at):
            name = f.getPath().getName()
            if f.isDirectory():
                if name not in pruned and (hidden or not name.startswith(".")):
                    todo.append(f.getPath())
            elif not exts or name.endswith(tuple(exts)):
                if name.startswith(HIDDEN):
                    passed.append((f.getPath().toString(), f.getLen()))
                else:
                    wanted = True
        if wanted:
            seen.append(at.toString())
    return sorted(seen), sorted(passed)


def read_listed(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """``(path, length, content)`` of listed files, each read by a task, a batch a file."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                yield pa.RecordBatch.from_pydict({"path": [path], "length": [length], "content": [content_of(path)]},
                                                 pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())]))
    if not files:
        return spark.createDataFrame([], FILES).select("path", "length", "content")
    paths = spark.createDataFrame(files, "path string, length long")
    return paths.repartition(min(len(files), 200), "path").mapInArrow(read, "path string, length long, content binary")


def content_of(path: str) -> bytes:
    """A file's bytes; schemes other than ``file`` go through Arrow's file systems."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        with open(path[len("file:"):] if at.scheme else path, "rb") as f:
            return f.read()
    from pyarrow import fs
    system, name = fs.FileSystem.from_uri(f"{at.scheme}://{at.netloc}{quote(path.split(at.netloc, 1)[1] if at.netloc else at.path)}")
    with system.open_input_stream(name) as f:
        return f.read()


def scan_tree(spark: SparkSession, root: str, exts: list[str] | None = None, min_bytes: int | None = None,
              max_bytes: int | None = None, repo: str | None = None, pruned: tuple | list | None = None, hidden: bool = True) -> DataFrame:
    """Files under ``root`` as ``(repo, path, length, content)``.

    ``path`` is relative to ``root``; ``content`` is decoded like
    ``open(..., errors="ignore")`` in text mode (invalid bytes dropped,
    ``\\r\\n`` and ``\\r`` turned into ``\\n``).  ``repo`` defaults to the first
    path segment (a root holding one directory per repository).  With ``pruned`` (S7, S8) the
    folders of these names are not descended into while listing, so what cannot be read there does no harm.
    Names that begin with ``_`` or ``.`` count like any other.
    """
    seen, passed = listing(spark, root, exts, pruned or (), hidden)
    passed = [(p, n) for p, n in passed if (min_bytes is None or n > min_bytes) and (max_bytes is None or n < max_bytes)]
    end = "{" + ",".join(exts) + "}" if exts else ""
    # the patterns name files only, unless a folder's name ends like one: it is not descended into
    held = [GLOB.sub(r"\\\1", d) + "/*" + end for d in seen]
    reader = spark.read.format("binaryFile")
    if exts:
        reader = reader.option("pathGlobFilter", "*" + end)
    df = reader.load(held) if held else spark.createDataFrame([], FILES)
    if min_bytes is not None:
        df = df.where(F.col("length") > min_bytes)
    if max_bytes is not None:
        df = df.where(F.col("length") < max_bytes)
    if passed:
        df = df.select("path", "length", "content").unionByName(read_listed(spark, passed))
    base = urlparse(root).path.rstrip("/") + "/"
    rel = F.substring(F.col("path"), F.instr(F.col("path"), base) + len(base), F.lit(T.BIG))
    repo_col = F.lit(repo) if repo else F.element_at(F.split(rel, "/"), 1)
    return df.select(repo_col.alias("repo"), rel.alias("path"), F.col("length"),
                     T.normalize_newlines(T.utf8_lenient("content")).alias("content"))
