"""Spelling variants: words at one edit from a much more frequent word.

The vocabulary is counted over all texts.  One edit leaves the front half of the
shorter word or its other half as it is, so a word is posted under both (as the
shorter and as the longer of a pair), and only words of one block are compared.
A block is a sorted list.  Its words share beginnings, so the banded rows of the
edit matrix are kept for each shared beginning (from the lengths of common
prefixes of neighbours) and reused by all words below it, and a range whose
beginning already has more than one edit is skipped.  A row of the band has three
cells of 0, 1 or "more", so it is one of 27 and the next row is a table entry.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplesmith.llm.common import cut

RUN = re.compile("[a-zÀ-ÿ]+")  # after A-Z is lower-cased
DAMAGE = 199
HELD = 500_000  # distinct words that a task counts before it hands them on
CELLS = 1 << 22  # letters of a batch of blocks
ASKING = 1 << 13  # words of a batch that walk the list at a time
HOT = 100_000  # words of a block above which it is posted again under a second half


def counted_words(docs: DataFrame) -> DataFrame:
    """``(word, n)``: partial counts of the damaged runs of letters of every text."""
    kind = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def batch(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if not text:
                    continue
                seed = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for word, n in Counter(RUN.findall(text.lower().decode())).items():  # bytes.lower() folds A-Z alone
                    h = zlib.crc32(word.encode(), seed)
                    if h % DAMAGE == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    total[word] += n
                if len(total) > HELD:
                    yield batch(total)
                    total = Counter()
        yield batch(total)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, min_length: int, min_count: int) -> DataFrame:
    """``(word, n)`` of the words long and frequent enough."""
    total = counted_words(docs).groupBy("word").agg(F.sum("n").alias("n"))
    return total.where((F.length("word") >= min_length) & (F.col("n") >= min_count))


def _rows() -> tuple[np.ndarray, np.ndarray]:
    """``step[row, equal]`` and ``least[row]`` of the band's rows; a row is three capped cells in base 3.

    The cells of row r stand at the asking word's places r - 1, r and r + 1;
    ``equal`` has a bit for each of these places' letters.
    """
    step, least = np.zeros((27, 8), np.uint8), np.zeros(27, np.uint8)
    for a, b, c in product(range(3), repeat=3):
        row = 9 * a + 3 * b + c
        least[row] = min(a, b, c)
        for equal in range(8):
            x = min(b + 1, a + (not equal & 1), 2)
            y = min(b + (not equal & 2), c + 1, x + 1, 2) if not equal & 2 else min(b, c + 1, x + 1, 2)
            z = min(c + (0 if equal & 4 else 1), y + 1, 2)
            step[row, equal] = 9 * x + 3 * y + z
    return step, least


STEP_ROW, LEAST = _rows()
START = 9 * 2 + 3 * 0 + 1


def one_edit(letters: np.ndarray, size: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asking, found) of places in the list whose words are one edit apart and in one block.

    ``letters`` holds the words' code points, padded with zeros, sorted within blocks.
    """
    n, width = letters.shape
    lcp = np.zeros(n, np.int64)  # with the word before; -1 where a block begins
    if n > 1:
        differ = letters[1:] != letters[:-1]
        lcp[1:] = np.where(block[1:] == block[:-1], np.where(differ.any(axis=1), differ.argmax(axis=1), width), -1)
    lcp[0] = -1
    begins = [np.flatnonzero(lcp < depth) for depth in range(width + 2)]  # first words of the ranges that share `depth` letters
    ordinal = [np.cumsum(lcp < depth) - 1 for depth in range(width + 2)]
    padded = np.concatenate([np.full((n, 1), 0xFFFFFFFF, np.uint32), letters, np.zeros((n, 2), np.uint32)], axis=1)
    asking, found = [], []
    for at in range(0, n, ASKING):
        ask = np.arange(at, min(at + ASKING, n))
        here = begins[0][ordinal[0][ask]]  # a range is named by its first word
        row = np.full(len(ask), START, np.uint8)
        for depth in range(width + 1):
            if not len(ask):
                break
            first = ordinal[depth + 1][here]
            after = np.r_[begins[depth], n][ordinal[depth][here] + 1] - 1
            count = ordinal[depth + 1][after] - first + 1
            ask, row = np.repeat(ask, count), np.repeat(row, count)
            child = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(ask))
            here = begins[depth + 1][child]
            letter = letters[here, depth] if depth < width else np.zeros(len(here), np.uint32)
            ended = letter == 0
            # a word that ends here is compared at the cell of the asking word's end
            offset = size[ask[ended]] - depth
            cell = np.where(offset == -1, row[ended] // 9, np.where(offset == 0, row[ended] // 3 % 3, row[ended] % 3))
            hit = (np.abs(offset) <= 1) & (cell == 1)
            asking.append(ask[ended][hit])
            found.append(here[ended][hit])
            ask, here, row, letter = ask[~ended], here[~ended], row[~ended], letter[~ended]
            if depth + 2 >= padded.shape[1]:
                break
            equal = ((padded[ask, depth] == letter) * 1 + (padded[ask, depth + 1] == letter) * 2 + (padded[ask, depth + 2] == letter) * 4)
            row = STEP_ROW[row, equal]
            on = LEAST[row] <= 1
            ask, here, row = ask[on], here[on], row[on]
    return np.concatenate(asking), np.concatenate(found)


def _half(side: str, word: Column, size: Column, short: Column) -> Column:
    """The front half of the shorter of a pair of words, or its other half, as the longer has them too."""
    front = F.floor(short / 2).cast("int")
    return F.substring(word, F.lit(1), front) if side == "front" else F.substring(word, size - (short - front) + 1, short - front)


def postings(words: DataFrame, hot: int = HOT) -> DataFrame:
    """``(short, part, affix, more, word, n)``: a row for each block of a word.

    A block over ``hot`` words is posted again: the rest beside the kept half is
    cut in two by the same rule, so its blocks keep three quarters of the letters.
    """
    size = F.length("word")
    short = F.explode(F.array(size, size - 1)).alias("short")
    base = words.withColumn("size", size).select("*", short)
    parts = F.array(*[F.struct(F.lit(s).alias("part"), _half(s, F.col("word"), F.col("size"), F.col("short")).alias("affix"))
                      for s in ("front", "back")])
    rows = base.select("short", "word", "n", "size", F.explode(parts).alias("p")).select("short", "p.*", "word", "n", "size")
    key = ["short", "part", "affix"]
    large = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).select(*key, F.lit(True).alias("large")))
    rows = rows.join(large, key, "left")
    kept = F.length("affix")
    rest = F.when(F.col("part") == "front", F.substring("word", kept + 1, F.col("size"))).otherwise(
        F.substring("word", F.lit(1), F.col("size") - kept))
    left = F.col("short") - kept
    again = F.array(*[F.concat(F.lit(s + ":"), _half(s, rest, F.length(rest), left)) for s in ("front", "back")])
    more = F.when(F.col("large"), again).otherwise(F.array(F.lit("")))
    return rows.select(*key, F.explode(more).alias("more"), "word", "n")


def _first_block(x: str, y: str, posted: int, part: str, more: str) -> bool:
    """Whether this block is the pair's own: of the shorter word's length, and of these the first (fronts before backs)."""
    short = min(len(x), len(y))
    half = short // 2
    if posted != short or part == "back" and x[:half] == y[:half]:
        return False
    if more.startswith("back:"):
        x, y, left = (x[half:], y[half:], short - half) if part == "front" else (x[:len(x) - short + half], y[:len(y) - short + half], half)
        return x[:left // 2] != y[:left // 2]
    return True


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """``(word, near, near_n)``: all ordered pairs of words one edit apart, with the second one's count."""
    kind = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
    order = ["short", "part", "affix", "more"]

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        names = [r[4] for r in rows]
        size = np.fromiter(map(len, names), np.int64, len(names))
        letters = np.zeros((len(names), int(size.max())), np.uint32)
        filled = np.arange(letters.shape[1]) < size[:, None]
        letters[filled] = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
        block = np.cumsum([i > 0 and rows[i][:4] != rows[i - 1][:4] for i in range(len(rows))])
        a, b = one_edit(letters, size, block)
        kept = [(names[i], names[j], rows[j][5]) for i, j in zip(a.tolist(), b.tolist())
                if _first_block(names[i], names[j], rows[i][0], rows[i][1], rows[i][3])]
        return pa.RecordBatch.from_arrays([pa.array([k[c] for k in kept], f.type) for c, f in enumerate(kind)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in [*order, "word", "n"])):
                # a new block: compare what is held once it is large
                if held and row[:4] != held[-1][:4] and len(held) * max(len(held[-1][4]), 8) > CELLS // 8:
                    yield compare(held)
                    held = []
                held.append(row)
        if held:
            yield compare(held)
    blocks = postings(words, hot).repartition(*order).sortWithinPartitions(*order, "word")
    return blocks.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for words that have a form: forms are followed to the last, by pointer doubling."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"))
        at = moved.select("word", "root")
        if moved.where("further IS NOT NULL").isEmpty():
            return at


def variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, hot: int = HOT) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``docs``.

    Words are maximal runs of letters (A-Z lower-cased, others as they are) of at least
    ``min_length`` code points that occur ``min_count`` times.  A word's form is its most
    frequent near word (ties: smallest in code-point order) if that has ``ratio`` times its count;
    ``root`` is the last of the forms from it, itself if it has none.  Null and empty texts
    have no words; a null ``doc_id`` counts as an empty one in the damage rule; repeated
    rows count again; no words give no rows; other columns are ignored.
    """
    words = cut(vocabulary(docs, min_length, min_count))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words, hot).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"))
    found = words.join(near, "word", "left")
    clear = -F.col("b.less") >= ratio * F.col("n")
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(clear, F.col("b.near")).alias("form"),
                             F.when(clear, -F.col("b.less")).alias("form_n")))
    return (found.join(roots(found.where("form IS NOT NULL")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
