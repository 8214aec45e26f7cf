"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (each phrase is the longest one seen
before plus one character), the phrase set is hashed, and its smallest hashes are the
signature.  Two signatures estimate the overlap of the phrase sets, which stands
in for how well one text would compress given the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 64  # smallest hashes kept
BUCKETS = 1 << 16  # most buckets: their splitters go through the driver


class Phrases:
    """LZ78 parse of a text; a parse can go on tentatively and be taken back.

    Every prefix of a known phrase is known, so the longest known phrase is
    found by stepping up or down from the length of the phrase before.
    """

    def __init__(self) -> None:
        self.known: set[str] = set()
        self.hashes: list[int] = []
        self.open = ""  # a known phrase at the end of the text so far

    def feed(self, text: str) -> list[str]:
        """Parse on; returns the new phrases."""
        known, new, text = self.known, [], self.open + text
        i, n, length = 0, len(text), 1
        while i < n:
            phrase = text[i:i + length]
            if phrase in known:
                while phrase in known and i + length < n:
                    length += 1
                    phrase = text[i:i + length]
                if phrase in known:
                    break
            else:
                while len(phrase) > 1 and phrase[:-1] not in known:
                    phrase = phrase[:-1]
                length = len(phrase)
            known.add(phrase)
            new.append(phrase)
            i += len(phrase)
        self.open = text[i:]
        self.hashes += map(xxhash.xxh32_intdigest, new)
        return new

    def signature_with(self, text: str) -> np.ndarray:
        """The signature after ``text`` too, which is then forgotten."""
        before, n = self.open, len(self.hashes)
        new = self.feed(text)
        found = self.signature()
        self.known.difference_update(new)
        del self.hashes[n:]
        self.open = before
        return found

    def signature(self) -> np.ndarray:
        """The ``SIZE`` smallest distinct 32-bit hashes of the phrases, ascending."""
        return np.unique(np.array(self.hashes, np.uint32))[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest hashes of the union that both have; two empty signatures are alike."""
    if not len(a) and not len(b):
        return 1.0
    both, n = np.unique(np.concatenate([a, b]), return_counts=True)  # each signature has a hash once
    return float(np.mean(n[:SIZE] == 2))


def text_of(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def _buckets(order: pa.Array, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, order.to_numpy(), "right").astype(np.int32)


def in_order(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """Rows ``(doc_id, text, o, h, bucket, guard)`` dealt to buckets of consecutive ids, sorted.

    Each bucket is closed by guards: copies of the next bucket's first rows (the
    first bucket's close the last one).  Splitters are quantiles of the ids,
    about one for ``rows`` rows and at most ``BUCKETS``; they balance the buckets and
    do not touch the result; a bucket is sorted by Spark and read as a stream.  Null ids come first; rows that share an id are ordered by text hash.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    order = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o")
    ids = docs.select(order)
    n = ids.count()
    parts = min(max(1, -(-n // rows)), BUCKETS)
    quantiles = ids.where("o > -9223372036854775808").approxQuantile("o", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    cuts = np.array(sorted({int(x) for x in quantiles}), np.int64)

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_buckets(b.column("o"), cuts)), b.column("o")], ["bucket", "o"])

    firsts = {r["bucket"]: r["o"] for r in ids.mapInArrow(lowest, "bucket int, o long").groupBy("bucket").agg(F.min("o").alias("o")).collect()}
    full = sorted(firsts)
    closes = {firsts[b]: full[i - 1] for i, b in enumerate(full)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket = _buckets(b.column("o"), cuts)
            names = [*b.schema.names, "bucket", "guard"]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bucket), pa.array([False] * len(bucket))], names)
            extra = b.filter(pa.array([x in closes for x in b.column("o").to_pylist()], pa.bool_()))
            if extra.num_rows:
                to = pa.array([closes[x] for x in extra.column("o").to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([*extra.columns, to, pa.array([True] * len(to))], names)

    keyed = docs.select("doc_id", "text", order, F.xxhash64("text").alias("h"))
    placed = keyed.mapInArrow(place, "doc_id long, text binary, o long, h long, bucket int, guard boolean")
    return placed.repartition(max(parts // 4, 1), "bucket").sortWithinPartitions("bucket", "guard", "o", "h")


def fingerprints(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` per row.

    The edited text is the text with its last ``floor(n_chars / 2)`` code points
    replaced by the first as many (or all) of the next document, ascending
    ``doc_id``; the first follows the last, and a document alone follows itself.
    A null text is empty; its fingerprint is empty, and like only to another
    empty one.  Equal texts have equal fingerprints.  Repeated rows come back
    repeated; an empty table gives no rows; other columns are never read.
    """
    kinds = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
             ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # (bucket, doc_id, text, head phrases, signature) of the row whose next row has not come yet
        for b in batches:
            out = []
            for doc, raw, bucket, guard in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "guard"))):
                if guard and (waiting is None or waiting[0] != bucket):
                    continue  # a further guard of a bucket that is closed
                text = (raw or b"").decode("utf-8", "replace")
                keep = len(text) - len(text) // 2
                head = Phrases()
                head.feed(text[:keep])
                mark = head.signature_with(text[keep:])
                if waiting is not None:
                    _, its_id, its_text, its_head, its_mark = waiting
                    n = len(its_text)
                    tail = text[:n // 2]
                    edited = its_head.signature_with(tail)
                    whole = hashlib.sha256((its_text[:n - n // 2] + tail).encode()).hexdigest()
                    out.append((its_id, n, whole, text_of(its_mark), text_of(edited), likeness(its_mark, edited), likeness(its_mark, mark)))
                waiting = None if guard else (bucket, doc, text, head, mark)
            cols = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds)], [k for k, _ in kinds])
    return in_order(docs, rows).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                                "edited_fingerprint string, near_edited double, near_next double")
