"""JSONL sources and sinks.

Reads use an explicit schema (never inference).  File order — which the
keep-first dedup and head-N limits depend on — is carried explicitly as
``(file_order, file_block_start, row_in_block)``: each file split is read by
exactly one task, in order, so ``monotonically_increasing_id`` increases with
the line within a split, and the split offset orders splits within a file.
No single task ever has to number a whole file.

A sink is a folder of parts.  Rows with an ``order`` are dealt to ranges, sorted
there and written as one part for each, numbered in range order.  Part names begin with the number of
the write (``part-00000001.<job>-00003-...``), so appended parts come after older
ones.  ``file_order`` compares these numbers as numbers.

A write with a ``job_id`` ends with a marker that holds its counts.  A retry of a finished job
finds the marker, writes nothing and returns the same counts; a retry of one
that broke off first removes what it left.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplesmith.functions import text as TX
from samplesmith.schema import RAW, SAMPLE, SAMPLE_FIELDS

CORRUPT = "_corrupt"
FILE_ORDER = ["file_order", "file_block_start", "row_in_block"]
ORDER_COLUMNS = ["file_path", *FILE_ORDER]
PART = r"^part-(\d+)\.([^-]*)-(\d+)-"  # number of the write, job, number of the part


def existing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Driver-side existence check through the cluster file system (missing
    files are skipped, as the source does)."""
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
    except Exception:  # no JVM handle (e.g. a Spark Connect session): ask the reader
        jvm = conf = None
    out = []
    for p in paths:
        if jvm is not None:
            hp = jvm.org.apache.hadoop.fs.Path(p)
            if hp.getFileSystem(conf).exists(hp):
                out.append(p)
            continue
        try:
            _ = spark.read.format("text").load(p).schema  # lists the path; raises when missing
            out.append(p)
        except Exception:
            pass
    return out


def file_order(path: F.Column) -> F.Column:
    """A string that sorts like the file's place: folder, number of the write, number of the part, name."""
    folder, name = F.regexp_extract(path, "^(.*/)", 1), F.substring_index(path, "/", -1)
    plain = r"^part-(\d+)-"  # Spark's own names
    numbers = F.when(name.rlike(PART), F.concat(F.lpad(F.regexp_extract(name, PART, 1), 12, "0"), F.lit("-"),
                                                F.lpad(F.regexp_extract(name, PART, 3), 12, "0"))) \
        .when(name.rlike(plain), F.concat(F.lit("0" * 12 + "-"), F.lpad(F.regexp_extract(name, plain, 1), 12, "0")))
    return F.concat(folder, F.coalesce(numbers, F.lit("")), F.lit("/"), name)


def _with_order(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), file_order(F.col("_metadata.file_path")).alias("file_order"),
                     F.col("_metadata.file_block_start").alias("file_block_start"),
                     F.monotonically_increasing_id().alias("row_in_block"))


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    extra = [T.StructField("file_path", T.StringType()), T.StructField("file_order", T.StringType()),
             T.StructField("file_block_start", T.LongType()),
             T.StructField("row_in_block", T.LongType())]
    return spark.createDataFrame([], T.StructType(list(schema.fields) + extra))


def read_jsonl_strict(spark: SparkSession, paths: list[str] | str, schema: T.StructType = RAW) -> DataFrame:
    """S1 ``load_jsonl`` (merge variant): blank lines skipped, malformed lines set
    aside (see ``rejected_lines``), rows kept when ``instruction`` or ``prompt``
    is truthy (F2); missing files contribute nothing."""
    df = read_jsonl_all(spark, paths, schema)
    if CORRUPT not in df.columns:
        return df
    ok = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return ok.where(TX.truthy("instruction") | TX.truthy("prompt"))


END = uuid.uuid4().hex  # unknown to whoever wrote the lines
END_FIELD = "__end"


def parsed(line: F.Column, schema: T.StructType) -> F.Column:
    """The object on a line, or null where the line is not one JSON object and nothing else.

    The line is put in an array before an object that holds ``END``.  Only if the line is a
    single value does the array have two elements of which the second is that object: what a line closes or
    leaves open itself (``}],[{``, ``}] x }``, a second object, a comment) moves or hides it.
    """
    text = TX.py_strip(line)
    guarded = T.StructType([*schema.fields, T.StructField(END_FIELD, T.StringType())])
    found = F.from_json(F.concat(F.lit("["), text, F.lit(',{"' + END_FIELD + '":"' + END + '"}]')), T.ArrayType(guarded),
                        {"allowSingleQuotes": "false"})
    whole = (F.size(found) == 2) & (F.get(found, F.lit(1))[END_FIELD] == END)
    value = F.get(found, F.lit(0))
    return F.when(F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")) & whole,
                  F.struct(*[value[f.name].alias(f.name) for f in schema.fields]))


def _lines(spark: SparkSession, found: list[str]) -> DataFrame:
    """Non-blank lines with their order columns."""
    return _with_order(spark.read.text(found)).where(F.length(TX.py_strip("value")) > 0)


def read_jsonl_all(spark: SparkSession, paths: list[str] | str, schema: T.StructType = RAW) -> DataFrame:
    """Every non-blank line with ``_corrupt`` holding the raw text of malformed ones."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = existing_paths(spark, paths)
    if not found:
        return _empty(spark, schema)
    rows = _lines(spark, found).withColumn("__o", parsed(F.col("value"), schema))
    return rows.select(*[F.col("__o")[f.name].alias(f.name) for f in schema.fields],
                       F.when(F.col("__o").isNull(), F.col("value")).alias(CORRUPT), *ORDER_COLUMNS)


def rejected_lines(spark: SparkSession, paths: list[str] | str, schema: T.StructType = RAW) -> DataFrame:
    """S3: path, 1-based line number and raw text of every malformed (non-blank,
    unparseable) line.

    Line numbers without numbering a file in one task: within a file split,
    ``monotonically_increasing_id`` is consecutive, so a row's line is the
    lines of earlier splits of its file (a running sum over the per-split
    counts: one small row per split) plus its offset in the split, plus one.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = existing_paths(spark, paths)
    if not found:
        return spark.createDataFrame([], f"file_path string, line_no long, {CORRUPT} string")
    lines = _with_order(spark.read.text(found))
    splits = lines.groupBy("file_path", "file_block_start").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_in_block").alias("first_id"))
    before = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("lines_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bad = (F.length(TX.py_strip("value")) > 0) & parsed(F.col("value"), schema).isNull()
    rejected = lines.where(bad).join(splits, ["file_path", "file_block_start"])
    return rejected.select("file_path",
                           (F.col("lines_before") + F.col("row_in_block") - F.col("first_id") + 1).alias("line_no"),
                           F.col("value").alias(CORRUPT))


def read_jsonl_lenient(spark: SparkSession, paths: list[str] | str, schema: T.StructType = SAMPLE) -> DataFrame:
    """Malformed and blank lines silently dropped, no field filter; missing
    files contribute nothing."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = existing_paths(spark, paths)
    if not found:
        return _empty(spark, schema)
    return read_jsonl_all(spark, paths, schema).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_placed(spark: SparkSession, paths: list[str] | str, schema: T.StructType = SAMPLE, name: str = "place") -> DataFrame:
    """S2 with each kept row's place (from 1) in the file order, its order columns dropped.

    No row moves: a file split is read by one task, in order, so a row's place is the rows of earlier splits (a running
    sum over one small row per split) plus its offset in its split.  Should the two scans ever cut the files
    differently, the query fails; it never gives a wrong place.
    """
    rows = read_jsonl_lenient(spark, paths, schema).withColumn("__id", F.monotonically_increasing_id())  # consecutive in a split
    split = ["file_order", "file_block_start"]
    splits = rows.groupBy(*split).agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    offset = F.col("__id") - F.col("__first")
    place = F.when((offset >= 0) & (offset < F.col("__n")), F.col("__before") + offset + 1) \
        .otherwise(F.raise_error(F.lit("the files were cut into other splits between two scans")).cast("long"))
    return rows.join(F.broadcast(splits), split, "left").select(*schema.fieldNames(), place.alias(name))


def python_json_line(fields: list[str]) -> F.Column:
    """One line exactly as ``json.dumps(sample, ensure_ascii=False)`` writes it
    for string fields: ``{"k": "v", ...}`` in field order, raw UTF-8, nulls as ``null``."""
    from samplesmith.functions.tools import json_string
    parts: list = [F.lit("{")]
    for k, f in enumerate(fields):
        parts.append(F.lit((", " if k else "") + '"' + f + '": '))
        parts.append(F.coalesce(json_string(F.col(f), ensure_ascii=False), F.lit("null")))
    parts.append(F.lit("}"))
    return F.concat(*parts)


def _folder(spark: SparkSession, path: str):
    """The file system and path of a folder, and the names in it."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, folder, [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []


def _marker(job_id: str) -> str:
    return f"_job-{job_id}.json"


def committed_counts(spark: SparkSession, path: str, job_id: str) -> dict | None:
    """The counts of a job that has finished its write to ``path``."""
    fs, _, names = _folder(spark, path)
    if _marker(job_id) not in names:
        return None
    jvm = spark.sparkContext._jvm
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(path, _marker(job_id)))
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_parts(lines: DataFrame, path: str, mode: str = "overwrite", order: list[str] | None = None, job_id: str | None = None,
                counts: dict[str, F.Column] | None = None, keep: F.Column | None = None, line: F.Column | None = None,
                compression: str | None = None) -> dict:
    """Write a ``line`` (else the ``value`` column) for each row of ``lines`` as text parts, in ``order`` where it is given; returns the counts.

    The line is built behind the sort: the fields move, and the pass that samples the ranges builds none.  ``counts`` are aggregates over all of ``lines``, ``rows`` counts those written (``keep``).  They are collected by the
    last stage of the write, of which each task counts once however often stages before it run again.
    """
    spark = lines.sparkSession
    if job_id is not None:
        if not re.fullmatch(r"[A-Za-z0-9_.]+", job_id):
            raise ValueError("a job id has letters, digits, dots and underscores only")
        done = committed_counts(spark, path, job_id)
        if done is not None:
            return done
    fs, folder, names = _folder(spark, path)
    parts = [m for m in (re.match(PART, n) for n in names) if m]
    if mode == "append" and job_id is not None:
        for m in parts:  # of a try that broke off
            if m.group(2) == job_id:
                fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, m.string), False)
        parts = [m for m in parts if m.group(2) != job_id]
    number = max((int(m.group(1)) for m in parts), default=-1) + 1 if mode == "append" else 0
    if mode == "append" and not parts and any(n.startswith("part-") for n in names):
        number = 1  # behind parts that Spark named
    rows = lines.orderBy(*order) if order else lines
    keep = F.lit(True) if keep is None else keep
    obs = Observation("written")
    rows = rows.observe(obs, F.count_if(keep).alias("rows"), *[c.alias(k) for k, c in (counts or {}).items()])
    name = f"part-{number:08d}.{job_id or uuid.uuid4().hex[:8]}"
    value = (F.col("value") if line is None else line).alias("value")
    rows.where(keep).select(value).write.mode(mode).option("mapreduce.output.basename", name).text(path, compression=compression)
    told = {k: int(v or 0) for k, v in obs.get.items()} if obs.get else {"rows": 0}
    if job_id is not None:
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, _marker(job_id)), True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
    return told


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", fields: list[str] | None = None,
                layout: str = "python", order: list[str] | None = None, job_id: str | None = None, compression: str | None = None) -> int:
    """One UTF-8 JSON object per line (all-null rows skipped); returns
    the row count, collected by the write job itself.

    ``layout="python"`` writes each line byte-for-byte as the source does
    (``json.dumps(..., ensure_ascii=False)``); ``layout="spark"`` uses Spark's
    compact JSON writer (which omits null fields).  With ``order`` the lines of the parts, in file
    order, are in that order; ``mode="append"`` adds them behind the lines there are.  A ``job_id`` makes the write safe to repeat.
    ``compression="gzip"`` packs the parts; every reader here opens them by their names."""
    fields = fields or SAMPLE_FIELDS
    any_set = F.lit(False)
    for f in fields:
        any_set = any_set | F.col(f).isNotNull()
    line = F.to_json(F.struct(*fields)) if layout == "spark" else python_json_line(fields)
    keys = {f"__o{k}": F.col(c) for k, c in enumerate(order or [])}
    out = df.where(any_set).select(*fields, *[c.alias(k) for k, c in keys.items()])
    return write_parts(out, path, mode, list(keys) or None, job_id, line=line, compression=compression)["rows"]


def write_jsonl_files(df: DataFrame, root: str, lines: dict[str, F.Column], order: list[str], compression: str | None = None) -> dict[str, str]:
    """Several datasets from one sort: each row gives one line to each of ``lines`` (null: none), all in ``order``.

    ``df`` is dealt to ranges once, and its lines are built there.  Returns each dataset's folder, ``<root>/file=<name>``.
    """
    each = F.filter(F.array(*[F.struct(F.lit(n).alias("file"), line.alias("value")) for n, line in lines.items()]), lambda x: x["value"].isNotNull())
    keys = [F.col(c).alias(f"__o{k}") for k, c in enumerate(order)]
    rows = df.repartitionByRange(*order).select(*keys, F.inline(each))
    rows = rows.sortWithinPartitions("file", *[f"__o{k}" for k in range(len(order))])
    name = f"part-{0:08d}.{uuid.uuid4().hex[:8]}"
    rows.select("file", "value").write.mode("overwrite").partitionBy("file").option("mapreduce.output.basename", name).text(root, compression=compression)
    return {n: f"{root}/file={n}" for n in lines}


def concat_files(spark: SparkSession, paths: list[str], out: str, job_id: str | None = None) -> int:
    """Raw concatenation of JSONL files: their lines as they are, in the order of ``paths`` and of each file."""
    parts = [_with_order(spark.read.text(p)).withColumn("dataset_ord", F.lit(k)) for k, p in enumerate(paths) if existing_paths(spark, [p])]
    if not parts:
        return 0
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    return write_parts(lines, out, order=["dataset_ord", *FILE_ORDER], job_id=job_id)["rows"]
