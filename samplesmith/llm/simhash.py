"""SimHash near-duplicates: 64-bit fingerprints, linked through BK-trees.

Fingerprints within ``max_bits`` differ in at most ``max_bits`` of
``max_bits + 2`` bit blocks, so they agree on at least two whole blocks.  Every
pair of blocks makes a shard key; one shuffle brings the distinct fingerprints
of a shard together, and each shard builds a BK-tree (children keyed by the
Hamming distance to their parent) and asks it for every member, following only
the edges within the radius.  The trees travel by that shuffle and not by a
broadcast: together they grow with the corpus, so they have no size bound.  A
shard of more than ``SHARD`` fingerprints is built as trees of pairs of its chunks.
A member that was reached is taken out of the tree at once: a dense group of m
near copies costs about m visits, never its m * m pairs, and yields m - 1 links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplesmith.llm.common import cut, id_and_bytes, split_hot
from samplesmith.llm.components import connected_components

SEED = 42
SHARD = 100_000  # fingerprints of a shard, or of a chunk of a larger shard
STEP = 1 << 16  # shingles counted at a time, so a very long text needs no more memory


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of a text's word shingles (repeats count); no words: zero."""
    words = (text or b"").lower().split()  # ASCII case and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    width = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(width + 1) - 1
    starts = (ends - width).tolist()
    k = min(shingle, len(words))
    ends = ends[k - 1:].tolist()
    digest, total, ones = xxhash.xxh64_intdigest, len(ends), np.zeros(64, np.int64)
    for i in range(0, total, STEP):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i:i + STEP], ends[i:i + STEP])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint's 64 bits as a signed long; one row per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t, shingle)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])
    return id_and_bytes(docs).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """BK-tree over distinct integers; counts of live nodes let a search skip emptied branches."""

    def __init__(self, points: list[int]) -> None:
        self.points, self.children, self.parent, self.live = [points[0]], [{}], [-1], [1]
        for p in points[1:]:
            self._add(p)

    def _add(self, p: int) -> None:
        node = 0
        while True:
            self.live[node] += 1
            d = (p ^ self.points[node]).bit_count()
            child = self.children[node].get(d)
            if child is None:
                break
            node = child
        self.children[node][d] = len(self.points)
        self.points.append(p)
        self.children.append({})
        self.parent.append(node)
        self.live.append(1)

    def _own(self, node: int) -> bool:
        return self.live[node] > sum(self.live[c] for c in self.children[node].values())

    def drop(self, node: int) -> None:
        while node >= 0:
            self.live[node] -= 1
            node = self.parent[node]

    def near(self, p: int, radius: int, gone: list[bool]) -> list[int]:
        found, todo = [], [0] if self.live[0] else []
        while todo:
            node = todo.pop()
            d = (p ^ self.points[node]).bit_count()
            if d <= radius and not gone[node]:
                found.append(node)
            for at, child in self.children[node].items():
                if d - radius <= at <= d + radius and self.live[child]:
                    todo.append(child)
        return found


def star_links(points: list[int], radius: int) -> list[tuple[int, int]]:
    """Links ``(point, first of its component)`` joining all of ``points`` that chain within ``radius``."""
    tree, gone, out = BKTree(points), [False] * len(points), []
    for seed in range(len(points)):
        if gone[seed]:
            continue
        gone[seed] = True
        tree.drop(seed)
        todo = [seed]
        while todo and tree.live[0]:
            for node in tree.near(tree.points[todo.pop()], radius, gone):
                gone[node] = True
                tree.drop(node)
                out.append((tree.points[node], tree.points[seed]))
                todo.append(node)
    return out


def shard_keys(fp: Column, max_bits: int) -> Column:
    """One key per pair of bit blocks: ``max_bits + 2`` blocks, any two of which may be the equal ones."""
    n = max_bits + 2
    cuts = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(n)]
    keys = []
    for k, (i, j) in enumerate(combinations(range(n), 2)):
        wide = cuts[j + 1] - cuts[j]
        value = F.shiftleft(block[i], wide).bitwiseOR(block[j])
        keys.append(F.xxhash64(F.lit(k), value) if n < 4 else value.bitwiseOR(F.lit(k << 52)))
    return F.array(*keys)


def links(distinct_fps: DataFrame, max_bits: int = 4, limit: int = SHARD) -> DataFrame:
    """``(a, b)`` links that join all distinct fingerprints chaining within ``max_bits``.

    One task holds at most about ``2 * limit`` fingerprints of a shard at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def shards(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.diff(keys)) + 1
            lo, hi = np.r_[0, edge], np.r_[edge, len(keys)]
            out = []
            for a, b in zip(lo[hi - lo > 1].tolist(), hi[hi - lo > 1].tolist()):
                out += star_links([x & 0xFFFFFFFFFFFFFFFF for x in fps[a:b].tolist()], max_bits)
            ends = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        for batch in batches:
            k = np.r_[rest_k, batch.column("part").to_numpy()]
            f = np.r_[rest_f, batch.column("fp").to_numpy()]
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
            rest_k, rest_f = k[last:], f[last:]
            if last:
                yield shards(k[:last], f[:last])
        if len(rest_k):
            yield shards(rest_k, rest_f)

    keyed = distinct_fps.select(F.explode(shard_keys(F.col("fp"), max_bits)).alias("key"), "fp")
    parted = split_hot(keyed, "key", "fp", limit).select("part", "fp")
    return parted.repartition("part").sortWithinPartitions("part", "fp").mapInArrow(run, "a long, b long").distinct()


def near_dedup(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` per input row.

    ``component_id`` is the smallest ``doc_id`` reachable over links of
    ``max_bits`` or fewer differing bits.  Null, empty and blank texts have
    fingerprint zero and link like any other; equal fingerprints are one class
    (copies are never expanded into pairs); repeated rows come back repeated; a
    null ``doc_id`` never names a component unless it stands alone (then null).
    An empty table gives an empty result; other columns are ignored.
    """
    fps = cut(fingerprints(docs, shingle))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = connected_components(links(classes.select("fp"), max_bits))
    of = (classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
          .withColumn("component", F.coalesce("component", "fp")))
    ids = of.groupBy("component").agg(F.min("first").alias("component_id"))
    return fps.join(cut(of.join(ids, "component").select("fp", "component_id")), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` without near copies: each component keeps its smallest ``doc_id``.

    Of rows that share that id one stays, the one whose whole row hashes
    lowest.  Rows with a null id cannot be told apart by id and all stay.
    """
    found = cut(near_dedup(docs, shingle, max_bits).where(F.col("doc_id").isNotNull())
                .groupBy(F.col("doc_id").alias("__id")).agg((F.min("doc_id") != F.min("component_id")).alias("later"),
                                                            F.count(F.lit(1)).alias("n")))
    repeated = found.where(~F.col("later") & (F.col("n") > 1)).select("__id")
    on = docs["doc_id"] == F.col("__id")
    kept = docs.join(found.where(F.col("later") | (F.col("n") > 1)).select("__id"), on, "left_anti")
    if repeated.isEmpty():
        return kept
    whole = F.xxhash64(*docs.columns)
    first = (docs.join(repeated, on, "left_semi")
             .withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy(whole))))
    return kept.unionByName(first.where("__n = 1").drop("__n"))
