"""W3 on Structured Streaming: files landing under a root become samples.

Per-file work (filters, chunking, the four-task fan-out) is stateless, so the
batch operators apply unchanged to a ``binaryFile`` stream; progress and
exactly-once output live in a checkpoint folder in shared storage.
"""

from __future__ import annotations

import posixpath
from urllib.parse import urlparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from samplesmith.functions import text as T
from samplesmith.operators import snippets as SN
from samplesmith.schema import SAMPLE_FIELDS
from samplesmith.session import checkpoint_dir
from samplesmith.sources.jsonl import python_json_line

# The binaryFile source's fixed schema (streams must state it).
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def start_tree_stream(spark: SparkSession, root: str, out_dir: str, checkpoint: str | None = None,
                      available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Stream W3: new source files under ``root`` -> four-task samples (JSONL)."""
    if checkpoint is None:
        checkpoint = posixpath.join(checkpoint_dir(spark), "tree-samples")
    r = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", "true")
         .option("pathGlobFilter", "*{" + ",".join(SN.TREE_EXTS) + "}"))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = r.load(root)
    base = urlparse(root).path.rstrip("/") + "/"
    rel = F.substring(F.col("path"), F.instr(F.col("path"), base) + len(base), F.lit(T.BIG))
    files = raw.select(rel.alias("path"), "length",
                       T.normalize_newlines(T.utf8_lenient("content")).alias("content"))
    files = files.where(SN.name_has_no_skip_word(SN.TREE_SKIP_WORDS))
    samples = SN.task_fanout(SN.tree_chunks(files).select("path", "chunk_no", "chunk"))
    w = (samples.select(python_json_line(SAMPLE_FIELDS).alias("value")).writeStream.format("text")
         .option("path", out_dir).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
