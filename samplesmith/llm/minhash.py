"""MinHash near-duplicates: a signature-coordinate inverted join.

Equal shingle sets are one class.  A class is posted under each of its
``COORDINATES`` (coordinate, minimum) pairs.  Two classes at the asked similarity agree
in at least ``match_threshold`` coordinates but for a chance of ``MISS``, so with every
class's pairs in one order, rarest first, they share a pair among the first ones
(its *prefix*): only prefixes are joined, the long lists behind them are skipped,
and a collision is counted by comparing the two signatures.

Two exact bounds skip what cannot link before signatures are compared: the set
sizes, and the parity of the shingles in each of ``BITS`` cells, in which two sets differ at
most as often as their shingles do.  Links are confirmed on the full sets.  They are looked
for twice: first every posting list is joined with its most central class
(linear), and after the components of these links only classes of different components
are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplesmith.llm.common import cut
from samplesmith.llm.components import connected_components
from samplesmith.llm.paragraph_dedup import Powers, Text
from samplesmith.llm.winnow import gram_hashes, mix

COORDINATES = 64
MISS = 1e-9  # a pair at the similarity itself is missed with at most this chance
BITS = 1024
CHUNK = 20_000  # classes of a posting list that one task holds as targets
STEP = 1 << 15  # shingles hashed at a time


@cache
def match_threshold(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest number of matches that a pair at ``similarity`` falls below with at most ``miss`` probability."""
    below, t = 0.0, 0
    while below + (p := comb(coordinates, t) * similarity ** t * (1 - similarity) ** (coordinates - t)) <= miss:
        below, t = below + p, t + 1
    return t


def shingle_set(text: bytes | None, shingle: int, powers: Powers) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word shingles; fewer words: of the whole sequence; no word: none."""
    words = Text(text or b"", powers).words
    return np.unique(gram_hashes(words, min(shingle, len(words)))) if len(words) else words


def signature(shingles: np.ndarray) -> np.ndarray:
    """One posting key per coordinate: the minimum of a permuted hash, which names its coordinate too."""
    rng = np.random.default_rng(11)
    flip, factor = (rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) for _ in range(2))
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), STEP):
        part = (shingles[i:i + STEP, None] ^ flip) * (factor * np.uint64(2) + np.uint64(1))
        low = np.minimum(low, part.min(axis=0))
    return mix(low + np.arange(COORDINATES, dtype=np.uint64))


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether each cell holds an odd number of the shingles, as 64-bit words."""
    odd = np.bincount((mix(shingles) >> np.uint64(32)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def signed_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, n, same, whole, signature, parity)`` per row; ``same`` digests the set and ``whole`` the text, in 128 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            n, same, signs, odd = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, shingle, powers)
                n.append(len(s))
                same.append(xxhash.xxh3_128_digest(s.tobytes()))
                signs.append(signature(s).view(np.int64) if len(s) else None)
                odd.append(parities(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(same, pa.binary()),
                                              b.column("whole"), pa.array(signs, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                                             ["doc_id", "n", "same", "whole", "signature", "parity"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return (rows.withColumn("whole", F.unhex(F.md5(F.coalesce("text", F.lit(b"")))))
            .mapInArrow(run, "doc_id long, n long, same binary, whole binary, signature array<long>, parity array<long>"))


def prefixes(classes: DataFrame, threshold: int) -> DataFrame:
    """``(key, node, shared)``: the postings of every class's prefix that another class shares, and how many of its pairs are shared.

    Pairs that no other class has come first in the order, so they use up places
    of the prefix; a class with too few shared pairs has none left.
    """
    posted = classes.select("node", F.explode("signature").alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    order = F.sort_array(F.collect_list(F.struct("n", "key")))
    ranked = posted.join(shared, "key").groupBy("node").agg(order.alias("keys"))
    first = F.slice("keys", F.lit(1), F.size("keys") - threshold + 1)
    posts = cut(ranked.where(F.size("keys") >= threshold).select("node", F.size("keys").alias("shared"), F.explode(first).alias("k"))
                .select("k.key", "node", "shared"))
    return posts.join(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key")


def class_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``(node, shingles)`` of the classes in ``nodes`` (node, whole)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            sets = [shingle_set(t, shingle, powers).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])
    raw = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    texts = docs.select(raw.alias("text")).withColumn("whole", F.unhex(F.md5("text")))
    found = texts.join(nodes.select("node", "whole"), "whole").select("node", "text")
    return found.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _similar(both: Column | np.ndarray, union: Column | np.ndarray, percent: int) -> Column | np.ndarray:
    return 100 * both >= percent * union


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(_similar(both, F.size("x") + F.size("y") - both, percent)).select("a", "b")


def central_pairs(posts: DataFrame, nodes: DataFrame, threshold: int, percent: int) -> DataFrame:
    """``(a, b)``: every class with the most central one of each of its posting lists, if sizes and matches allow.

    The class with the most shared pairs is central: few of its shingles are its own.
    """
    rank = F.struct("shared", F.xxhash64("node").alias("h"), "node")
    centre = posts.groupBy("key").agg(F.max(rank)["node"].alias("b"))
    pairs = posts.join(centre, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("signature").alias("s1"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("signature").alias("s2"))
    matches = F.aggregate(F.zip_with("s1", "s2", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    sizes = _similar(F.least("n1", "n2"), F.greatest("n1", "n2"), percent)
    return pairs.join(left, "a").join(right, "b").where(sizes).where(matches >= threshold).select("a", "b")


def crossing_pairs(posts: DataFrame, nodes: DataFrame, threshold: int, percent: int, chunk: int = CHUNK) -> DataFrame:
    """``(a, b)``: classes of one posting list in different components, if sizes, parities and matches allow.

    Classes outside the list's largest component ask, all are asked.  A list is
    dealt to chunks of about ``chunk`` classes, and those that ask go to each of them, so no task
    holds a whole list and a list that is one component costs nothing.
    """
    member = posts.join(nodes.select("node", "component"), "node")
    sizes = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    lists = (sizes.groupBy("key").agg(F.sum("m").alias("total"), F.count(F.lit(1)).alias("kinds"),
                                      F.max(F.struct("m", "component"))["component"].alias("largest"))
             .where("kinds > 1").select("key", "largest", F.ceil(F.col("total") / chunk).alias("k")))
    own = F.pmod(F.xxhash64("node"), F.col("k"))
    asks = F.col("component") != F.col("largest")
    to = F.when(asks, F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).otherwise(F.array(own))
    dealt = (member.join(lists, "key").select("key", "node", asks.alias("asks"), own.alias("own"), F.explode(to).alias("part"))
             .withColumn("asked", F.col("own") == F.col("part")).drop("own"))
    own_keys = posts.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    rows = dealt.join(nodes.select("node", "component", "n", "signature", "parity").join(own_keys, "node"), "node")
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        key = t.column("key")[0].as_py()
        lists = t.column("keys").combine_chunks()
        edge, posted = lists.offsets.to_numpy(), lists.values.to_numpy()
        edge = edge - edge[0]
        posted = posted[len(posted) - edge[-1]:]
        before = [posted[x:y][posted[x:y] < key] for x, y in zip(edge, edge[1:])]  # lists that come before this one
        width = max(map(len, before))
        earlier = np.full((len(before), width), key, np.int64)
        for i, x in enumerate(before):
            earlier[i, :len(x)] = x
        node, comp, n = (t.column(c).to_numpy() for c in ("node", "component", "n"))
        odd = t.column("parity").combine_chunks().values.to_numpy().reshape(-1, BITS // 64).view(np.uint64)
        sign = t.column("signature").combine_chunks().values.to_numpy().reshape(-1, COORDINATES)
        order = np.flatnonzero(t.column("asked").to_numpy(zero_copy_only=False))
        order = order[np.argsort(n[order], kind="stable")]
        a, b = [], []
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(asks).tolist():
            lo, hi = np.searchsorted(n[order] * 100, n[i] * percent), np.searchsorted(n[order] * percent, n[i] * 100, "right")
            j = order[lo:hi]
            j = j[comp[j] != comp[i]]
            apart = np.bitwise_count(odd[j] ^ odd[i]).sum(axis=1, dtype=np.int64)  # at most the symmetric difference
            j = j[(100 + percent) * apart <= (100 - percent) * (n[j] + n[i])]
            j = j[(sign[j] == sign[i]).sum(axis=1) >= threshold]
            j = j[~np.isin(earlier[j], before[i]).any(axis=1)]  # a pair is told by the first list that both are in
            if len(asking := j[asks[j]]):  # and once, if both ask
                j = np.setdiff1d(j, asking[node[asking] < node[i]])
            a.append(np.minimum(node[j], node[i]))
            b.append(np.maximum(node[j], node[i]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [np.empty(0, np.int64)])) for x in (a, b)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([batch.column("key").to_numpy(), batch.column("part").to_numpy()])
            edge = np.r_[0, np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1, len(key)].tolist()
            for lo, hi in zip(edge, edge[1:]):
                if at != tuple(key[lo]) and held:
                    yield compare(held)
                    held = []
                at = tuple(key[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield compare(held)
    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, "a long, b long")


def components(classes: DataFrame, docs: DataFrame, shingle: int, percent: int, chunk: int = CHUNK) -> DataFrame:
    """``(node, component)`` of the classes that have a link."""
    threshold = match_threshold(percent / 100)
    posts = cut(prefixes(classes, threshold))
    nodes = cut(classes.join(posts.select("node").distinct(), "node"))
    sets = cut(class_sets(docs, nodes, shingle))
    nodes = nodes.drop("whole")
    first = cut(confirmed(central_pairs(posts, nodes, threshold, percent), sets, percent))
    linked = cut(connected_components(first))
    grouped = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = confirmed(cut(crossing_pairs(posts, cut(grouped), threshold, percent, chunk)), sets, percent)
    return connected_components(more.unionByName(linked.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def near_dedup(docs: DataFrame, shingle: int = 3, percent: int = 85, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per input row.

    Links have ``100 * intersection >= percent * union`` on sets of distinct word
    shingles (ASCII case folded; fewer words than ``shingle``: the whole sequence).
    ``component_id`` is the smallest ``doc_id`` reachable, itself included, and the
    row that has it is ``kept``.  Null, empty and blank texts have no set and link with
    nothing.  Equal sets are one class and never expanded into pairs; repeated
    rows come back repeated; a null ``doc_id`` names a component only if all its ids are
    null (then null, and kept).  An empty table gives no rows; other columns are ignored.
    """
    rows = cut(signed_sets(docs, shingle))
    classes = cut(rows.where("n > 0").groupBy("same").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"),
                                                          F.first("signature").alias("signature"),
                                                          F.first("parity").alias("parity"), F.min("whole").alias("whole"))
                  .withColumn("node", F.monotonically_increasing_id()))
    linked = components(classes.drop("same", "first"), docs, shingle, percent, chunk)
    of = classes.select("same", "first", "node").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    named = cut(of.join(least, "component").select(F.col("same").alias("__same"), "component_id"))
    found = rows.select("doc_id", F.col("n").alias("n_shingles"), "same").join(named, F.col("same") == F.col("__same"), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return (found.select("doc_id", "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
