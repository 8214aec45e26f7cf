"""Exact removal of repeated byte strings, by a sparse distributed suffix sort.

A string of ``length`` bytes has one anchor: the place of its least ``gram``-byte
hash.  Equal strings have equal anchors, so only suffixes that begin at anchors
are sorted, and all strings with the same anchor travel as one *span* (the text
from the first such string to the end of the last).

1. Spans go to the tasks by their anchor's leading bytes (hashed).  A span found
   twice (equal anchor and digest, 128 bits of hash) is a repeat as a whole; only different spans on equal anchors are left.
2. One copy of each of those is fetched, range-partitioned by its anchor's leading
   bytes with sampled splitters, and sorted locally by multikey quicksort, eight
   bytes to a character.  Splitters fall between anchors, so no run of equal
   suffixes crosses a boundary.  Anchors of very many spans go by string hashes instead.
3. Repeated strings are merged to removed runs of each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplesmith.llm.common import cut, id_and_bytes
from samplesmith.llm.winnow import BASE, gram_hashes, minimizers, mix

SORT_WINDOWS = 1 << 18  # strings that one local sort takes at a time, unless one anchor has more

SPAN = [("anchor", pa.int64()), ("digest", pa.int64()), ("row", pa.int64()), ("start", pa.int64()),
        ("run", pa.int32()), ("at", pa.int32()), ("kind", pa.int32())]
ANCHOR = 20_000  # different spans of one anchor that one local sort takes
ONE, SEVERAL, SETTLED = 0, 1, 2
FOUND = [("row", pa.int64()), ("start", pa.int64()), ("run", pa.int32()), ("at", pa.int32()), ("anchor", pa.int64()),
         ("open", pa.bool_())]
RUN = [("row", pa.int64()), ("start", pa.int64()), ("run", pa.int32())]


def _sql(kinds: list[tuple[str, pa.DataType]]) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{n} {names[t]}" for n, t in kinds)


def _batch(columns: list, kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches of rows sorted by ``key``, cut anew so that no value of it is in two."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        k = t[key].to_numpy()
        same = np.flatnonzero(k != k[-1])
        last = int(same[-1]) + 1 if len(same) else 0
        if last:
            yield t.slice(0, last)
        rest = t.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def text_spans(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, anchor's hash, anchor's place) for every span of a text."""
    if len(text) < length:
        return (np.empty(0, np.int64),) * 4
    h = gram_hashes(np.frombuffer(text, np.uint8), gram)
    first, run, place = (np.concatenate(x) for x in zip(*minimizers(h, length - gram + 1)))
    return first, run, h[place].view(np.int64), place


def spans(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """A row per span.  Of equal spans in a batch one speaks for the group; the others are settled.

    A settled row carries an anchor made from its own place, so copies of one
    passage, however many, do not meet in one task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, digests = [], []
            for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist()):
                first, count, anchor, place = text_spans(text, length, gram)
                if len(first):
                    ends = (first + count + (length - 1)).tolist()
                    digests += [xxhash.xxh3_64_intdigest(text[x:y]) for x, y in zip(first.tolist(), ends)]
                    parts.append((anchor, np.full(len(first), row, np.int64), first, count, place - first))
            if not parts:
                continue
            anchor, row, first, count, at = (np.concatenate(x) for x in zip(*parts))
            digest = np.array(digests, np.uint64).view(np.int64)
            order = np.lexsort((digest, anchor))
            same = np.flatnonzero((anchor[order[1:]] == anchor[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]]))
            kind = np.full(len(order), ONE)
            kind[order[same]] = SEVERAL
            kind[order[same + 1]] = SETTLED
            own = mix(row.view(np.uint64) + first.astype(np.uint64) * np.uint64(BASE)).view(np.int64)
            yield _batch([np.where(kind == SETTLED, own, anchor), digest, row, first, count, at, kind], SPAN)
    return rows.mapInArrow(run, _sql(SPAN))


def match_spans(found: DataFrame) -> DataFrame:
    """Repeated spans (``open`` false), and one of each span that meets another on its anchor (``open``).

    The sorted rows pass as a stream.  Between batches only two are held: the last row, whose next row tells
    whether it is repeated, and the first row of its anchor, which is open once a second span comes.
    """
    names = [n for n, _ in FOUND[:-1]]

    def chosen(c: dict[str, np.ndarray], pick: np.ndarray, is_open: bool) -> pa.RecordBatch:
        some = [c[n][pick] for n in names]
        return _batch([*some, np.full(len(some[0]), is_open)], FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, np.ndarray] | None = None  # one row, and whether it repeats the row before it
        lead: dict[str, np.ndarray] = {}
        again = lead_open = False
        for b in batches:
            given = {n: b.column(n).to_numpy() for n, _ in SPAN}
            settled = given["kind"] == SETTLED
            yield chosen(given, settled, False)
            c = {n: x[~settled] for n, x in given.items()}
            if not len(c["row"]):
                continue
            held = 0 if last is None else 1
            if held:
                c = {n: np.r_[last[n], x] for n, x in c.items()}
            new_anchor = np.r_[not held, np.diff(c["anchor"]) != 0]
            new_span = new_anchor | np.r_[not again, np.diff(c["digest"]) != 0]
            twice = (c["kind"] == SEVERAL) | ~new_span | np.r_[~new_span[1:], False]
            yield chosen(c, np.flatnonzero(twice[:-1]), False)
            further = np.flatnonzero(new_span & ~new_anchor)
            further = further[further >= held]
            first = np.maximum.accumulate(np.where(new_anchor, np.arange(len(new_anchor)), -1))
            opened = np.unique(np.r_[further, first[further]])
            if len(opened) and opened[0] < 0:
                if not lead_open:
                    yield chosen(lead, np.zeros(1, np.int64), True)
                    lead_open = True
                opened = opened[1:]
            yield chosen(c, opened, True)
            if first[-1] >= 0:
                lead, lead_open = {n: x[first[-1]:first[-1] + 1].copy() for n, x in c.items()}, first[-1] in opened
            last, again = {n: x[-1:].copy() for n, x in c.items()}, not new_span[-1]
        if last is not None and (again or last["kind"][0] == SEVERAL):
            yield chosen(last, np.zeros(1, np.int64), False)
    return (found.repartition("anchor").sortWithinPartitions("anchor", "digest", "row", "start").mapInArrow(run, _sql(FOUND)))


def equal_strings(buf: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings at ``at`` have an equal in their ``group``: multikey sort, eight bytes to a character."""
    padded = np.r_[buf, np.zeros(8, np.uint8)].astype(np.uint64)
    word = np.zeros(len(buf), np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i:i + len(buf)]
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    live = np.arange(len(at))
    for step in [None, *steps]:
        character = word[at[live] + step] if step is not None else np.zeros(len(live), np.uint64)
        order = np.lexsort((character, group))
        new = np.r_[True, (np.diff(group[order]) != 0) | (character[order[1:]] != character[order[:-1]])]
        number = np.cumsum(new) - 1
        many = (np.bincount(number) > 1)[number]
        live, group = live[order[many]], number[many]
        if not len(live):
            break
    return live


def sort_spans(texts: DataFrame, length: int) -> DataFrame:
    """``(row, start, run)``: the strings of different spans that are equal, as runs of starts."""
    def solve(t: pa.Table) -> pa.RecordBatch:
        text = t["text"].to_pylist()
        size, run, at = np.array([len(x) for x in text]), t["run"].to_numpy(), t["at"].to_numpy()
        anchor = np.cumsum(np.r_[True, np.diff(t["anchor"].to_numpy()) != 0])
        base = np.cumsum(size) - size
        span = np.repeat(np.arange(len(run)), run)
        step = np.arange(len(span)) - np.repeat(np.cumsum(run) - run, run)
        offset = at[span] - step  # equal strings have their anchor at the same place
        group = anchor[span].astype(np.int64) * (1 << 32) + offset
        hit = np.zeros(len(span), bool)
        hit[equal_strings(np.frombuffer(b"".join(text), np.uint8), base[span] + step, group, length)] = True
        edge = np.flatnonzero(np.r_[True, (span[1:] != span[:-1]) | (hit[1:] != hit[:-1])])
        n = np.diff(np.r_[edge, len(span)])
        edge, n = edge[hit[edge]], n[hit[edge]]
        return _batch([t["row"].to_numpy()[span[edge]], t["start"].to_numpy()[span[edge]] + step[edge], n], RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, "anchor"):
            anchor, total = t["anchor"].to_numpy(), np.cumsum(t["run"].to_numpy())
            edges = [*np.flatnonzero(np.diff(anchor) != 0).tolist(), t.num_rows - 1]
            first, done = 0, 0
            for e in edges:
                if total[e] - done >= SORT_WINDOWS or e == t.num_rows - 1:
                    yield solve(t.slice(first, e + 1 - first))
                    first, done = e + 1, int(total[e])
    parted = texts.repartitionByRange("lead", "anchor").sortWithinPartitions("lead", "anchor", "row", "start")
    return parted.mapInArrow(run, _sql(RUN))


def hash_spans(texts: DataFrame, length: int) -> DataFrame:
    """What ``sort_spans`` returns, for anchors with too many spans for one task: each string goes by its own hash (128 bits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, start, n, text in zip(*(b.column(x).to_pylist() for x in ("row", "start", "run", "text"))):
                whole = memoryview(text)
                yield _batch([[xxhash.xxh3_128_digest(whole[i:i + length]) for i in range(n)], np.full(n, row, np.int64),
                              np.arange(start, start + n), np.ones(n, np.int32)], [("string", pa.binary()), *RUN])
    strings = texts.mapInArrow(run, f"string binary, {_sql(RUN)}")
    twice = strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("string")
    return strings.join(twice, "string", "left_semi").select("row", "start", "run")


def fetch(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted spans' bytes, with the first eight bytes at their anchor."""
    kinds = [("lead", pa.int64()), ("anchor", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("run", pa.int32()),
             ("at", pa.int32()), ("text", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, text, want in zip(*(b.column(n).to_pylist() for n in ("row", "text", "want"))):
                for w in want:
                    place = w["start"] + w["at"]
                    lead = int.from_bytes(text[place:place + 8].ljust(8, b"\0"), "big", signed=True)
                    out.append((lead, w["anchor"], row, w["start"], w["run"], w["at"],
                                text[w["start"]:w["start"] + w["run"] + length - 1]))
            yield _batch(list(zip(*out)) or [[]] * len(kinds), kinds)
    of_row = wanted.groupBy("row").agg(F.collect_set(F.struct("anchor", "start", "run", "at")).alias("want"))
    return rows.join(of_row, "row").select("row", "text", "want").mapInArrow(run, _sql(kinds))


def merged(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal covered byte runs of strings that start in ``(first, number)`` runs."""
    out: list[tuple[int, int]] = []
    for start, n in sorted(starts):
        end = start + n - 1 + length
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def dedup(docs: DataFrame, length: int = 200, gram: int = 64, limit: int = ANCHOR) -> DataFrame:
    """``(doc_id, n_bytes, removed, kept)`` per row: removed byte runs, and the bytes left.

    Removes each byte covered by a ``length``-byte string that also starts
    anywhere else, in the same text or another; strings are judged on the input.
    Null texts are empty; texts shorter than ``length`` stay whole; copies of a
    longer text lose everything, the first copy too, and repeated rows are copies.
    An anchor with over ``limit`` different spans is not sorted in one task: its
    strings go by their own hashes.
    An empty table gives no rows; other columns are never read.
    """
    rows = id_and_bytes(docs).select("doc_id", F.coalesce("text", F.lit(b"")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    found = cut(match_spans(spans(rows.select("row", "text"), length, gram)))
    texts = cut(fetch(rows, found.where("open"), length))
    hot = cut(found.where("open").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("anchor"))
    runs = (found.where("not open").select("row", "start", "run")
            .unionByName(sort_spans(texts.join(hot, "anchor", "left_anti"), length))
            .unionByName(hash_spans(texts.join(hot, "anchor", "left_semi"), length)))
    # rows that repeat id and text share a hash and say the same; a set is bounded by one text, however many they are
    of_row = runs.groupBy("row").agg(F.collect_set(F.struct("start", "run")).alias("runs"))
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64())]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone, kept = [], []
            for text, starts in zip(b.column("text").to_pylist(), b.column("runs").to_pylist()):
                gone.append(merged([(x["start"], x["run"]) for x in starts or []], length))
                edges = [0, *(e for g in gone[-1] for e in g), len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t) for t in b.column("text").to_pylist()], pa.int64()),
                 pa.array([[{"start": x, "end": y} for x, y in g] for g in gone],
                          pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                [*(k for k, _ in kinds), "removed", "kept"])
    return (rows.join(of_row, "row", "left").select("doc_id", "text", "runs")
            .mapInArrow(remove, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"))
