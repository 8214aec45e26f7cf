"""Language identification as inference of a mixture of languages.

Each language has a smoothed distribution over hashed byte trigrams, learned
from all labelled training rows.  A document is a mixture of languages: an
expectation-maximisation run finds the mixture weights, languages are ranked by
weight, and the set of languages is grown while the penalised likelihood
improves.  The model holds ``languages * BUCKETS`` numbers, whatever the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructType

from samplesmith.llm.common import held_out, id_and_bytes

BITS = 15
BUCKETS = 1 << BITS
#: Lower-cases ASCII, keeps bytes of other letters, and makes all else a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ASCII_LETTER = re.compile(rb"[A-Za-z]")
UNKNOWN = "und"


def trigrams(text: bytes) -> np.ndarray:
    """Counts of the hashed byte trigrams of the folded text, words set off by one space."""
    a = np.frombuffer(b" " + b" ".join(text.translate(FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(BUCKETS, np.int64)
    x = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    return np.bincount((x * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=BUCKETS)


def has_letter(text: bytes | None) -> bool:
    """True if any Unicode letter occurs."""
    if not text:
        return False
    return bool(ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "ignore"))


@dataclass
class Model:
    """``prob[bucket, language]``; languages in name order."""

    languages: list[str]
    prob: np.ndarray


def learn(docs: DataFrame, smoothing: float = 0.5) -> Model:
    """Trigram distributions of all rows with a ``lang``, text and id outside the held-out fold.

    Partitions pre-aggregate their counts; the result has at most one number
    for each language and bucket.  No labelled row gives a model without languages.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                sums[lang] = sums.get(lang, 0) + trigrams(text)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                              pa.array(n[at].astype(np.int64))], ["lang", "bucket", "n"])

    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                       & ~held_out(F.col("doc_id")))
    counts = (id_and_bytes(train, F.col("lang").cast("string").alias("lang"))
              .mapInArrow(run, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    names = sorted(set(counts["lang"].to_pylist()))
    table = np.full((BUCKETS, len(names)), smoothing)
    column = {x: i for i, x in enumerate(names)}
    table[counts["bucket"].to_numpy(), [column[x] for x in counts["lang"].to_pylist()]] += counts["n"].to_numpy()
    return Model(names, table / table.sum(axis=0) if names else table)


def mixture(p: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """EM weights of the columns of ``p`` for rows seen ``n`` times, and the log-likelihood."""
    w = np.full(p.shape[1], 1 / p.shape[1])
    share = n / n.sum()
    for _ in range(rounds if p.shape[1] > 1 else 0):
        w = w * ((share / (p @ w)) @ p)
    return w, float(n @ np.log(p @ w))


def infer(text: bytes | None, model: Model, rounds: int = 8, penalty: float = 4.0) -> list[tuple[str, float]]:
    """The document's languages and proportions, largest first; empty for null or letterless text.

    A language is added while it raises the log-likelihood by more than
    ``penalty * log(number of trigrams)``.  Ties go to the name that sorts first.
    """
    if not model.languages or not has_letter(text):
        return []
    counts = trigrams(text)
    at = np.flatnonzero(counts)
    if not len(at):
        return [(model.languages[0], 1.0)]
    p, n = model.prob[at], counts[at]
    single = n @ np.log(p)
    first = int(np.argmax(single))
    chosen, best, weights = [first], float(single[first]), np.ones(1)
    full, _ = mixture(p, n, rounds)
    for k in [int(k) for k in np.argsort(-full, kind="stable") if k != first]:
        w, ll = mixture(p[:, [*chosen, k]], n, rounds)
        if ll - best <= penalty * np.log(n.sum() + 1):
            break
        chosen, best, weights = [*chosen, k], ll, w
    return sorted(((model.languages[k], float(x)) for k, x in zip(chosen, weights)), key=lambda x: (-x[1], x[0]))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, rounds: int = 8, penalty: float = 4.0) -> DataFrame:
    """Columns ``keep`` (``doc_id`` alone by default) with ``lang_pred``, ``score`` and ``languages``.

    They are the main language, its proportion, and the whole set.  ``und`` with
    score 0 and no languages for null text or text without a letter.  Repeated
    rows come back repeated; an empty table gives no rows; other columns are
    never read, and kept ones with the new names are replaced.
    """
    names = [c for c in (keep or ["doc_id"]) if c not in ("lang_pred", "score", "languages")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [infer(t, model, rounds, penalty) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array([x[0][0] if x else UNKNOWN for x in found], pa.string()),
                 pa.array([min(x[0][1], 1.0) if x else 0.0 for x in found], pa.float64()),
                 pa.array(found, pa.map_(pa.string(), pa.float64()))], [*names, "lang_pred", "score", "languages"])

    given = docs.select(*names, F.col("text").cast("string").cast("binary").alias("__text"))
    kinds = StructType([f for f in given.schema if f.name != "__text"])
    kinds.add("lang_pred", "string").add("score", "double").add("languages", MapType(StringType(), DoubleType()))
    return given.mapInArrow(run, kinds)
