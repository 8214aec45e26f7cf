"""Substring dedup by paragraphs: exact classes, MinHash banding, verified links, components.

A text's paragraphs are its lines of ``min_words`` words or more; a shorter line is judged together with the lines
before it and with those behind it, as many as make ``min_words`` words.  A second cut does not depend on where lines
break: its *stretches* are words between places where the hash of a word pair is the least among its neighbours.  Equal
paragraphs are one class.  Different lines whose shingle MinHashes collide in a band are joined, verified by exact
Jaccard, and clustered by connected components.  The first paragraph of a class or cluster stays.  Repeated stretches are
the seeds of passages inside different lines: from both ends of a row of them the words are compared with those around
the first occurrence, over changed words too while the Jaccard similarity of the passage's shingles holds, and the whole
passage goes if it has ``min_words`` words.  Words at its ends that the seed's first occurrence lacks stay.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplesmith.llm.common import cut, split_hot
from samplesmith.llm.components import connected_components
from samplesmith.llm.winnow import BASE, gram_hashes, mix, window_min

SHINGLE = 5
REACH = 5  # a stretch begins where a word pair's hash is least among this many on either side
CONTEXT = 64  # words compared beyond a seed; so many equal words in a row hold another seed
GAP = 3  # changed, added or left out words in a row within a passage
SALTS = 64  # parts of the followers of one first occurrence
CHUNK = 1 << 18  # bytes of texts that are hashed together
BANDS, ROWS = 8, 3  # finds a pair of Jaccard 0.8 with probability 1 - (1 - 0.8 ** 3) ** 8 = 0.997
BAND = 10_000  # different lines of a band's collision, or of a chunk of a larger one
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
INVERSE = pow(BASE, -1, 1 << 64)

UNIT = [("key", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("w0", pa.int32()), ("w1", pa.int32()),
        ("b0", pa.int32()), ("b1", pa.int32()), ("kind", pa.int32()), ("lead", pa.int64()), ("lead0", pa.int32())]
STRETCH, LINE, SETTLED, RUN, SHORT = 0, 1, 2, 4, 8  # a settled line is LINE | SETTLED; RUN: lines of a short one and its neighbours


def _sql(kinds: list[tuple[str, pa.DataType]]) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"{n} {names[t]}" for n, t in kinds)


def _batch(columns: list, kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])


class Powers:
    """Powers of the base and of its inverse, for hashes of any stretch of a sequence."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``values[start:end]`` for arrays of bounds."""
        while len(self.up) <= len(values):
            n = len(self.up)
            self.up = np.r_[self.up, self.up * np.uint64(pow(BASE, n, 1 << 64))]
            self.down = np.r_[self.down, self.down * np.uint64(pow(INVERSE, n, 1 << 64))]
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(values * self.up[:len(values)], dtype=np.uint64)]
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


class Text:
    """Words of a text: byte bounds, hashes, and the first word of each line."""

    def __init__(self, text: bytes, powers: Powers) -> None:
        a = np.frombuffer(text, np.uint8)
        solid = ~SPACE[a]
        turn = np.diff(np.r_[False, solid, False].astype(np.int8))
        self.start, self.end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        self.after = np.r_[self.start[1:], len(a)] if len(self.start) else self.start
        self.powers, self.n = powers, len(self.start)
        self.words = powers.spans(LOWER[a] + np.uint64(1), self.start, self.end)
        line = np.searchsorted(np.flatnonzero(a == 10), self.start)
        self.lines = np.flatnonzero(np.r_[True, np.diff(line) != 0]) if self.n else self.start


class Texts(Text):
    """Words of several texts one after another, with the first word of each text that has any."""

    def __init__(self, texts: list[bytes], powers: Powers) -> None:
        super().__init__(b"\n".join(texts), powers)
        size = np.array([len(t) for t in texts], np.int64)
        self.offset = np.cumsum(size + 1) - size - 1
        self.text = np.searchsorted(self.offset, self.start, "right") - 1
        self.after = np.minimum(self.after, (self.offset + size)[self.text])
        self.breaks = np.flatnonzero(np.r_[True, np.diff(self.text) != 0]) if self.n else self.start

    def stretches(self) -> np.ndarray:
        """First words of the stretches; no text's depend on another's."""
        if self.n < 2:
            return self.breaks
        highest = np.iinfo(np.uint64).max
        pair = gram_hashes(self.words, 2)
        pair[self.breaks[1:] - 1] = highest
        group = np.searchsorted(self.breaks, np.arange(len(pair)), "right")
        at = np.arange(len(pair)) + REACH * group
        padded = np.full(at[-1] + REACH + 1, highest, np.uint64)
        padded[at] = pair
        least = window_min(padded, REACH)
        return np.sort(np.r_[self.breaks, np.flatnonzero((pair < least[at - REACH]) & (pair <= least[at + 1])) + 1])

    def units(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first word, word after the last, kind) of the paragraphs, and of lines too short to be one."""
        first, last = self.bounds(self.lines)
        short = last - first < min_words
        text = self.text[first] if self.n else first
        behind = np.searchsorted(last, first + min_words)
        before = np.searchsorted(first, last - min_words, "right") - 1
        ahead = short & (behind < len(first)) & (text[np.minimum(behind, len(first) - 1)] == text)
        back = short & (before >= 0) & (text[before] == text)
        run = np.unique(np.r_[first[ahead] * (self.n + 1) + last[behind[ahead]], first[before[back]] * (self.n + 1) + last[back]])
        cuts = self.bounds(self.stretches())
        enough = cuts[1] - cuts[0] >= SHINGLE
        parts = [(first[~short], last[~short], LINE), (first[short], last[short], SHORT),
                 (run // (self.n + 1), run % (self.n + 1), RUN), (cuts[0][enough], cuts[1][enough], STRETCH)]
        return tuple(np.concatenate(x) for x in zip(*(
            (self.powers.spans(self.words, f, e) ^ np.uint64(kind), f, e, np.full(len(f), kind)) for f, e, kind in parts)))

    def bounds(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return first, np.r_[first[1:], self.n] if len(first) else first


def together(texts: list[bytes], powers: Powers) -> Iterator[tuple[int, Texts]]:
    """Neighbouring texts of about ``CHUNK`` bytes (or one longer text) at a time, with the place of the first."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield at, Texts(texts[at:i], powers)
            at, size = i, 0
        size += len(t) + 1
    if size:
        yield at, Texts(texts[at:], powers)


def occurrences(rows: DataFrame, min_words: int = 20) -> DataFrame:
    """A row per paragraph; within a batch the first of equal paragraphs speaks for them.

    The others are certain to go, so they are settled, with the row and the first word of the first one (``lead``,
    ``lead0``): their key is made from their own place, and copies of a frequent line do not meet in one task.
    The same place of a repeated row is the same paragraph and says nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            docs = b.column("doc_id").fill_null(-(1 << 63)).to_numpy()
            ids, parts = b.column("row").to_numpy(), []
            for at, t in together(b.column("text").to_pylist(), powers):
                key, first, last, kind = t.units(min_words)
                if len(key):
                    own = t.text[first]
                    base, start = t.breaks[np.searchsorted(t.breaks, first, "right") - 1], t.offset[own]
                    parts.append((key, docs[at + own], ids[at + own], first - base, last - base,
                                  t.start[first] - start, t.after[last - 1] - start, kind))
            if not parts:
                continue
            key, doc, row, w0, w1, b0, b1, kind = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((w0, row, doc, key))
            same = np.r_[False, key[order][1:] == key[order][:-1]]
            place = np.r_[False, same[1:] & (np.diff(row[order]) == 0) & (np.diff(w0[order]) == 0)]
            later, leader = order[same], order[~same][np.cumsum(~same) - 1][same]
            lead, lead0 = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            lead[later], lead0[later] = row[leader], w0[leader]
            kind[later] |= SETTLED
            key[later] = mix(row[later].view(np.uint64) + w0[later].astype(np.uint64) * np.uint64(BASE))
            once = order[~place]
            yield _batch([c[once] for c in (key.view(np.int64), doc, row, w0, w1, b0, b1, kind, lead, lead0)], UNIT)
    return rows.mapInArrow(run, _sql(UNIT))


def classes(found: DataFrame) -> DataFrame:
    """The first occurrence of each line (kind 1), and each paragraph or short line that repeats an earlier one (settled)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # key and place of the last speaking row, and the place of the first of its key
        for b in batches:
            c = {n: b.column(n).to_numpy().copy() for n, _ in UNIT}
            if not b.num_rows:
                continue
            speaks = np.flatnonzero(c["kind"] & SETTLED == 0)
            same = np.zeros(b.num_rows, bool)
            if len(speaks):
                key, row, word = (c[n][speaks] for n in ("key", "row", "w0"))
                if before is None:
                    before = (~key[0], 0, 0, 0, 0)
                fresh = np.r_[key[0] != before[0], key[1:] != key[:-1]]
                group = np.cumsum(fresh)
                lead, lead0 = (np.r_[before[3 + i], x[fresh]][group] for i, x in enumerate((row, word)))
                same[speaks] = ~fresh & (row == np.r_[before[1], row[:-1]]) & (word == np.r_[before[2], word[:-1]])  # of a repeated row
                c["kind"][speaks[~fresh]] |= SETTLED
                c["lead"][speaks], c["lead0"][speaks] = lead, lead0
                before = tuple(x[-1] for x in (key, row, word, lead, lead0))
            keep = ((c["kind"] == LINE) | (c["kind"] & SETTLED != 0)) & ~same
            yield _batch([c[n][keep] for n, _ in UNIT], UNIT)
    return found.repartition("key").sortWithinPartitions("key", "doc_id", "row", "w0").mapInArrow(run, _sql(UNIT))


def band_keys(rows: DataFrame, min_words: int = 20) -> DataFrame:
    """``(band, key)``: MinHash bands over the shingles of every line of ``min_words`` words or more."""
    rng = np.random.default_rng(5)
    factor = rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    kinds = [("band", pa.int64()), ("key", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            out = []
            for _, t in together(b.column("text").to_pylist(), powers):
                first, last = t.bounds(t.lines)
                keep = last - first >= max(min_words, SHINGLE)
                first, last = first[keep], last[keep]
                if not len(first):
                    continue
                key = powers.spans(t.words, first, last) ^ np.uint64(LINE)
                _, one = np.unique(key, return_index=True)
                key, first, last = key[one], first[one], last[one]
                order = np.argsort(first)
                key, first, last = key[order], first[order], last[order]
                s = gram_hashes(t.words, SHINGLE)
                high = s ^ (s >> np.uint64(31))
                edge = np.column_stack([first, last - SHINGLE + 1]).ravel()
                edge = edge[:-1] if edge[-1] >= len(s) else edge
                low = [np.minimum.reduceat(high * f, edge)[::2] for f in factor]
                for i in range(BANDS):
                    band = low[i * ROWS] + np.uint64(i)
                    for j in range(1, ROWS):
                        band = mix(band) + low[i * ROWS + j]
                    out.append(np.column_stack([mix(band), key]))
            if out:
                pairs = np.unique(np.concatenate(out), axis=0).view(np.int64)
                yield _batch([pairs[:, 0], pairs[:, 1]], kinds)
    return rows.mapInArrow(run, _sql(kinds))


def jaccard_links(sets: list[set], similarity: float) -> list[tuple[int, int]]:
    """Links (member, first of its component) that join all sets chaining at ``similarity``.

    An inverted index of shingles gives the partners.  A set that was reached
    leaves the index, so a dense group yields one link for each member.
    """
    index: dict[int, set[int]] = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            index[x].add(i)
    left, out = set(range(len(sets))), []

    def leave(i: int) -> None:
        left.discard(i)
        for x in sets[i]:
            index[x].discard(i)

    for seed in range(len(sets)):
        if seed not in left:
            continue
        leave(seed)
        todo = [seed]
        while todo and left:
            i = todo.pop()
            shared: dict[int, int] = defaultdict(int)
            for x in sets[i]:
                for j in index[x]:
                    shared[j] += 1
            for j, n in shared.items():
                if n >= similarity * (len(sets[i]) + len(sets[j]) - n):
                    leave(j)
                    out.append((j, seed))
                    todo.append(j)
    return out


def near_lines(rows: DataFrame, lines: DataFrame, similarity: float, limit: int = BAND, min_words: int = 20) -> DataFrame:
    """``(a, b)`` links between different lines whose shingles have that Jaccard similarity.

    One task compares at most about ``2 * limit`` lines of a band at a time.
    """
    member = [("band", pa.int64()), ("key", pa.int64())]

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (band, key) that waits for a second key of its band
        open_band = None
        for b in batches:
            out_band, out_key = [], []
            band, key = b.column("band").to_numpy(), b.column("key").to_numpy()
            fresh = np.flatnonzero(np.r_[True, (np.diff(band) != 0) | (np.diff(key) != 0)]) if len(band) else []
            for x, k in zip(band[fresh].tolist(), key[fresh].tolist()):
                if held is not None and held[0] == x and held[1] != k:
                    if open_band != x:
                        out_band.append(x)
                        out_key.append(held[1])
                        open_band = x
                    out_band.append(x)
                    out_key.append(k)
                held = (x, k)
            yield _batch([out_band, out_key], member)

    shingled = [("key", pa.int64()), ("shingles", pa.list_(pa.int64()))]

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            keys, sets = [], []
            for text, want in zip(b.column("text").to_pylist(), b.column("want").to_pylist()):
                s = gram_hashes(Text(text, powers).words, SHINGLE).view(np.int64)
                for w in want:
                    keys.append(w["key"])
                    sets.append(np.unique(s[w["w0"]:w["w1"] - SHINGLE + 1]))
            yield _batch([keys, sets], shingled)

    link = [("a", pa.int64()), ("b", pa.int64())]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, keys, sets = None, [], []

        def links() -> pa.RecordBatch:
            found = jaccard_links(sets, similarity)
            return _batch([[keys[i] for i, _ in found], [keys[j] for _, j in found]], link)

        for b in batches:
            for x, k, s in zip(b.column("part").to_pylist(), b.column("key").to_pylist(), b.column("shingles")):
                if x != band:
                    if len(keys) > 1:
                        yield links()
                    band, keys, sets = x, [], []
                if not keys or keys[-1] != k:
                    keys.append(k)
                    sets.append(set(s.values.to_numpy().tolist()))
        if len(keys) > 1:
            yield links()

    members = cut(band_keys(rows.select("text"), min_words).repartition("band").sortWithinPartitions("band", "key").mapInArrow(collide, _sql(member)))
    wanted = (members.select("key").distinct().join(lines, "key").groupBy("row")
              .agg(F.collect_set(F.struct("key", "w0", "w1")).alias("want")))
    texts = rows.join(wanted, "row").select("text", "want").mapInArrow(shingles, _sql(shingled)).dropDuplicates(["key"])
    return (split_hot(members, "band", "key", limit).join(texts, "key").repartition("part").sortWithinPartitions("part", "key")
            .select("part", "key", "shingles").mapInArrow(verify, _sql(link)).distinct())


def joined(spots: list[tuple]) -> list[tuple[int, int, int, int]]:
    """Runs of sorted (first word, word after the last, first byte, byte after the last) that touch or overlap."""
    out: list[tuple[int, int, int, int]] = []
    for w0, w1, b0, b1 in spots:
        if out and w0 <= out[-1][1]:
            if w1 > out[-1][1]:
                out[-1] = (out[-1][0], w1, out[-1][2], b1)
        else:
            out.append((w0, w1, b0, b1))
    return out


def carried(own: int, b: list[int], a: list[int], similarity: float, near: bool) -> int:
    """How many words of ``b`` go on a passage of ``own`` equal words that goes on as ``a`` in its first occurrence.

    Equal words go on it, and with ``near`` further rows of ``SHINGLE`` equal words or more behind at most ``GAP``
    other words on each side, while the shingles of both passages have that Jaccard similarity.
    """
    def equal(i: int, j: int) -> int:
        n, most = 0, min(len(b) - i, len(a) - j)
        while n < most and b[i + n] == a[j + n]:
            n += 1
        return n

    i = j = equal(0, 0)
    shared = max(own + i - SHINGLE + 1, 0)
    while near and i < len(b) and j < len(a):
        steps = sorted(((x, y) for x in range(GAP + 1) for y in range(GAP + 1) if x or y), key=lambda s: (sum(s), abs(s[0] - s[1])))
        step = next(((x, y, n) for x, y in steps if (n := equal(i + x, j + y)) >= SHINGLE), None)
        if step is None:
            break
        x, y, n = step
        both = shared + n - SHINGLE + 1
        if both < similarity * (2 * (own - SHINGLE + 1) + i + x + j + y + 2 * n - both):
            break
        i, j, shared = i + x + n, j + y + n, both
    return i


def seed_runs(spots: list[dict]) -> list[list[dict]]:
    """Rows of repeated stretches that touch."""
    out: list[list[dict]] = []
    for s in sorted((s for s in spots if s["kind"] == SETTLED), key=lambda s: s["w0"]):
        if out and out[-1][-1]["w1"] == s["w0"]:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def contexts(rows: DataFrame, spots: DataFrame) -> DataFrame:
    """``(row, around)``: words before (side 0) and behind (side 1) the first occurrences of a row's seeds, nearest first.

    A first occurrence that many rows follow is copied to at most ``SALTS`` parts, and its followers are dealt to them.
    """
    ask = [("row", pa.int64()), ("side", pa.int32()), ("word", pa.int32()), ("lead", pa.int64()), ("at", pa.int32()), ("salt", pa.int32())]
    tell = [("lead", pa.int64()), ("at", pa.int32()), ("side", pa.int32()), ("salt", pa.int32()), ("words", pa.list_(pa.int32()))]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, found in zip(b.column("row").to_pylist(), b.column("spots").to_pylist()):
                for r in seed_runs(found):
                    first, last = r[0], r[-1]
                    if first["w0"] and first["lead0"]:
                        out.append((row, 0, first["w0"], first["lead"], first["lead0"], row % SALTS))
                    out.append((row, 1, last["w1"], last["lead"], last["lead0"] + last["w1"] - last["w0"], row % SALTS))
            if out:
                yield _batch([list(c) for c in zip(*out)], ask)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            out = []
            for text, lead, wanted in zip(b.column("text").to_pylist(), b.column("lead").to_pylist(), b.column("wanted").to_pylist()):
                w = Text(text, powers).words.astype(np.uint32).view(np.int32)
                out += [(lead, x["at"], x["side"], x["salt"], w[x["at"]:x["at"] + CONTEXT] if x["side"] else
                         w[max(x["at"] - CONTEXT, 0):x["at"]][::-1].copy()) for x in wanted]
            if out:
                yield _batch([list(c) for c in zip(*out)], tell)

    place = ["lead", "at", "side", "salt"]
    asked = cut(spots.mapInArrow(ends, _sql(ask)))
    wanted = asked.select(*place).distinct().groupBy("lead").agg(F.collect_list(F.struct("at", "side", "salt")).alias("wanted"))
    told = (rows.join(wanted, F.col("row") == F.col("lead")).select("text", "lead", "wanted")
            .mapInArrow(words, _sql(tell)).dropDuplicates(place))
    return (asked.join(told, place).groupBy("row")
            .agg(F.collect_list(F.struct("side", "word", "words", (F.col("lead") != F.col("row")).alias("near"))).alias("around")))


def removals(rows: DataFrame, similarity: float, min_words: int) -> DataFrame:
    """``(row, spots, around)``: repeated paragraphs of the rows that have any, and the words around their seeds."""
    found = cut(classes(occurrences(rows, min_words)))
    lines = found.where(F.col("kind") == LINE)
    linked = connected_components(near_lines(rows, lines.select("key", "row", "w0", "w1"), similarity, min_words=min_words))
    members = cut(lines.join(linked.withColumnRenamed("node", "key"), "key"))
    place = F.struct("doc_id", "row", "w0")
    leader = members.groupBy("component").agg(F.min(place).alias("first"))
    near = members.join(leader, "component").where(place != F.col("first")).withColumn("kind", F.lit(LINE | SETTLED))
    spot = ["w0", "w1", "b0", "b1", "kind", "lead", "lead0"]
    gone = found.where(F.col("kind").bitwiseAND(SETTLED) != 0).select("row", *spot).unionByName(near.select("row", *spot))
    spots = cut(gone.groupBy("row").agg(F.collect_set(F.struct(*spot)).alias("spots")))
    return spots.join(contexts(rows, spots), "row", "left")


def judge(text: bytes, spots: list[dict], around: list[dict] | None, similarity: float, min_words: int,
          powers: Powers) -> tuple[list[dict], list[dict]]:
    """(spans that go, repeated short lines that stay) of one text."""
    go = [(s["w0"], s["w1"], s["b0"], s["b1"]) for s in spots if s["kind"] in (LINE | SETTLED, RUN | SETTLED)]
    ends = {(x["side"], x["word"]): x for x in around or []}
    t = words = None
    for r in seed_runs(spots):
        w0, w1, b0, b1 = r[0]["w0"], r[-1]["w1"], r[0]["b0"], r[-1]["b1"]
        sides = []
        for x in (ends.get((0, w0)), ends.get((1, w1))):
            if x is None or not x["words"]:
                sides.append(([], [], False))
                continue
            if t is None:
                t = Text(text, powers)
                words = t.words.astype(np.uint32).view(np.int32).tolist()
            reach = len(x["words"]) + GAP
            sides.append((words[w1:w1 + reach] if x["side"] else words[max(w0 - reach, 0):w0][::-1], x["words"], x["near"]))
        equal = [carried(0, b, a, similarity, False) for b, a, _ in sides]
        more = [carried(w1 - w0 + other, b, a, similarity, near) for (b, a, near), other in zip(sides, equal[::-1])]
        if more[0]:
            w0, b0 = w0 - more[0], int(t.start[w0 - more[0]])
        if more[1]:
            w1, b1 = w1 + more[1], int(t.after[w1 + more[1] - 1])
        go.append((w0, w1, b0, b1))
    gone = [s for s in joined(sorted(go)) if s[1] - s[0] >= min_words]
    short = [s for s in spots if s["kind"] == SHORT | SETTLED and not any(g[0] <= s["w0"] and s["w1"] <= g[1] for g in gone)]
    return ([{"start": s[2], "end": s[3], "words": s[1] - s[0]} for s in gone],
            [{"start": s["b0"], "end": s["b1"], "words": s["w1"] - s["w0"]} for s in sorted(short, key=lambda s: s["w0"])])


def dedup(docs: DataFrame, similarity: float = 0.8, min_words: int = 20, short: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with repeated paragraphs cut out of ``text``, and ``removed_spans``.

    ``removed_spans`` lists (start, end, words) in bytes of the input text; it
    is empty where nothing goes, and then the text is unchanged (null stays null).
    Nothing of fewer than ``min_words`` words goes (with 20, no common sentence by itself).  A shorter line goes where the lines before it or behind it, up to
    that many words, repeat with it; else it stays, and the column named ``short`` (if any) lists it where its words repeat an
    earlier line's.  Among equal or near paragraphs the one with the
    smallest (doc_id, hash of the row, place) stays; null ids come first.  Rows that
    repeat both id and text count as one document, as do equal texts with null ids: all of
    them keep what the first occurrence keeps.  An empty table gives no rows.
    """
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = docs.where(F.length("text") > 0).select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                                                   F.col("text").cast("string").cast("binary").alias("text"))
    span = "array<struct<start:int,end:int,words:int>>"
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))

    @F.arrow_udf(f"gone {span}, short {span}")
    def judged(text: pa.Array, spots: pa.Array, around: pa.Array) -> pa.Array:
        powers, out = Powers(), []
        for t, s, a in zip(text.to_pylist(), spots.to_pylist(), around.to_pylist()):
            out.append(judge(t, s, a, similarity, min_words, powers) if s else ([], []))
        return pa.StructArray.from_arrays([pa.array([x[i] for x in out], spans) for i in range(2)], ["gone", "short"])

    found = removals(rows, similarity, min_words).select(F.col("row").alias("__row"), F.col("spots").alias("__spots"), F.col("around").alias("__around"))
    raw = F.col("text").cast("binary")
    whole = docs.join(found, row == F.col("__row"), "left").withColumn(
        "__judged", judged(F.when(F.col("__spots").isNotNull(), raw), "__spots", "__around"))
    gone = F.col("__judged.gone")
    starts = F.concat(F.array(F.lit(0)), gone["end"])
    ends = F.concat(gone["start"], F.array(F.octet_length("text")))
    kept = F.array_join(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")),
                                    lambda x: F.substring(raw, x["s"] + 1, x["e"] - x["s"]).cast("string")), "")
    columns = [F.when(F.size(gone) > 0, kept).otherwise(F.col("text")).alias("text") if c == "text" else whole[c]
               for c in docs.columns if c not in ("removed_spans", short)]
    more = [F.col("__judged.short").alias(short)] if short else []
    return whole.select(*columns, gone.alias("removed_spans"), *more)
