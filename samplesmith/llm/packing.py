"""Packing of token pieces into sequences by bin completion.

Only lengths matter to the packing, and there are at most ``capacity`` of them,
so the branch and bound runs on the histogram of lengths: a table whose size is
set by the sequence length and not by the corpus.  It yields *fillings* (multisets
of lengths) and how often each is used; pieces then find their places in
parallel from their rank within their length.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from samplesmith.llm.common import cut

Filling = list[tuple[int, int]]  # (length, how many), longest first
SPECIAL = "<|endoftext|>"


class Ids:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    ``ranks_path`` holds the vocabulary of ``json_path`` as ranks, which encode
    the same ids faster; only a text that holds the special token's string,
    which the ranks do not know, goes through the tokenizer file itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.exact = json_path, None

    def __call__(self, text: str) -> bytes:
        if SPECIAL not in text:
            ids = self.fast.encode_ordinary(text)
        else:
            self.exact = self.exact or Tokenizer.from_file(self.json_path)
            ids = self.exact.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes() if sys.byteorder != "little" else array("I", ids).tobytes()


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, capacity: int = 1024,
                 end_id: int = 2) -> DataFrame:
    """``(doc_id, piece, start, length, tokens)``: each document's ids and ``end_id``, cut to ``capacity``.

    ``tokens`` holds the ids as little-endian unsigned 32-bit integers.  Only
    documents longer than ``capacity`` are cut; their first piece takes the
    remainder.  A null or empty text is ``end_id`` alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Ids(json_path, ranks_path, pattern), np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "tokens"]
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = encode((text or b"").decode("utf-8", "replace")) + end
                n = len(ids) // 4
                at = [0, *range((n - 1) % capacity + 1, n, capacity), n]
                rows += [(doc, k, x, y - x, ids[4 * x:4 * y]) for k, (x, y) in enumerate(zip(at, at[1:]))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else
                                             [pa.array([], t) for t in kinds], names)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return kept.mapInArrow(run, "doc_id long, piece int, start long, length long, tokens binary")


def _reach(counts: dict[int, int], room: int) -> list[tuple[int, int, int]]:
    """``(length, count, sums)`` shortest first: bit s of ``sums`` is set if the lengths so far can fill exactly s."""
    mask, sums, out = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts):
        left = min(counts[length], room // length) if length <= room else 0
        take = 1
        while left:
            take = min(take, left)
            sums = (sums | (sums << (take * length))) & mask
            left -= take
            take *= 2
        out.append((length, counts[length], sums))
    return out


def fillings(counts: dict[int, int], longest: int, capacity: int, width: int) -> Iterator[tuple[int, Filling]]:
    """Up to ``width`` undominated fillings around ``longest``, least waste first, as ``(waste, filling)``.

    The sums that the other lengths can reach give the least waste exactly, and
    prune every branch that cannot end in a chosen sum.  Among equal waste,
    larger pieces come first: they dominate the same space cut smaller.
    """
    rest = dict(counts)
    rest[longest] -= 1
    table = _reach({k: n for k, n in rest.items() if n}, capacity - longest)
    sums = table[-1][2] if table else 1
    given, total = 0, capacity - longest
    while total >= 0 and given < width:
        if sums >> total & 1:
            todo: list[tuple[int, int, Filling]] = [(len(table) - 1, total, [])]
            while todo and given < width:
                i, need, have = todo.pop()
                if not need:
                    put = dict(have)
                    put[longest] = put.get(longest, 0) + 1
                    yield capacity - longest - total, sorted(put.items(), reverse=True)
                    given += 1
                    break  # one filling for each waste; others of the same waste only permute sizes
                length, n, _ = table[i]
                below = table[i - 1][2] if i else 1
                for k in range(0, min(n, need // length) + 1):  # the last pushed, most of the longest, goes first
                    if below >> (need - k * length) & 1:
                        todo.append((i - 1, need - k * length, [*have, (length, k)] if k else have))
        total -= 1


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on the histogram: each bin takes the longest pieces that still fit."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        room, put = capacity, {}
        for length in sorted(left, reverse=True):
            k = min(left[length], room // length)
            if k:
                put[length] = k
                room -= k * length
            if not room:
                break
        times = min(left[x] // k for x, k in put.items())
        out.append((sorted(put.items(), reverse=True), times))
        for x, k in put.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
    return out


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = 6000, width: int = 3) -> list[tuple[Filling, int]]:
    """Bin completion: ``(filling, times)`` that use up ``counts``; as few bins as the search finds.

    Depth first over fillings around the longest piece left.  A branch is cut
    when the waste it has gathered shows that it needs as many bins as the
    incumbent, which starts as best fit and is replaced by each better solution.
    The search ends at the bound ceil(total / capacity) or after ``nodes`` nodes.
    """
    left = {k: n for k, n in counts.items() if n}
    if not left:
        return []
    total = sum(k * n for k, n in left.items())
    bound = max(-(-total // capacity), sum(n for k, n in left.items() if 2 * k > capacity))
    incumbent = best_fit(left, capacity)
    most = sum(t for _, t in incumbent)
    todo: list[tuple[dict[int, int], int, int, list | None]] = [(left, 0, 0, None)]
    while todo and most > bound and nodes:
        nodes -= 1
        left, waste, used, path = todo.pop()
        if waste > (most - 1) * capacity - total:
            continue
        if not left:
            most, incumbent = used, []
            while path:
                path, step = path
                incumbent.append(step)
            continue
        children = []
        for lost, filling in fillings(left, max(left), capacity, width):
            times = min(left[x] // k for x, k in filling)
            rest = dict(left)
            for x, k in filling:
                rest[x] -= k * times
                if not rest[x]:
                    del rest[x]
            children.append((rest, waste + lost * times, used + times, [path, (filling, times)]))
        todo += reversed(children)
    return incumbent


def _places(plan: list[tuple[Filling, int]]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, pieces per sequence, first sequence, first offset) in rank order."""
    seen: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for filling, times in plan:
        offset = 0
        for length, k in filling:
            rows.setdefault(length, []).append((seen.get(length, 0), k, sequence, offset))
            seen[length] = seen.get(length, 0) + k * times
            offset += k * length
        sequence += times
    return {length: np.array(x, np.int64) for length, x in rows.items()}


def pack(pieces: DataFrame, capacity: int = 1024, nodes: int = 6000, group_rows: int = 50_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless places in sequences of at most ``capacity``.

    Needs a column ``length`` from 1 to ``capacity``; all columns come back.
    Ranks are taken in hash groups of about ``group_rows`` rows, so a length
    that most pieces share is no hot group.  No pieces, no rows; repeated rows
    each get a place of their own.
    """
    data = [c for c in pieces.columns]
    pieces = cut(pieces.withColumn("__h", F.xxhash64(*data)))
    sizes = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(complete_bins(sizes, capacity, nodes))
    groups = max(1, -(-sum(sizes.values()) // group_rows))
    keyed = pieces.withColumn("__g", F.pmod("__h", F.lit(groups)))
    before = (keyed.groupBy("length", "__g").agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__g")) - F.col("__n")))
    ranked = (keyed.withColumn("__r", F.row_number().over(Window.partitionBy("length", "__g").orderBy("__h")) - 1)
              .join(before.drop("__n"), ["length", "__g"])
              .select(*data, (F.col("__r") + F.col("__before")).alias("__rank")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                t = places[x]
                row = t[np.searchsorted(t[:, 0], rank[at], "right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + k // row[:, 1]
                offset[at] = row[:, 3] + k % row[:, 1] * x
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in data), pa.array(sequence), pa.array(offset)],
                                             [*data, "sequence_id", "offset"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*data).schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")
