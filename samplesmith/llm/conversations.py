"""Conversation repair: the cheapest edits, by min-plus matrices over a grammar.

Each row of a conversation is a letter (role initial and fault), each conversation
a string of letters, in blocks of at most ``BLOCK`` rows.  Re-Pair rounds over the
distinct strings replace the most frequent neighbours by new letters; the grammar
has at most ``ROUNDS * RULES`` rules.  A letter's transfer matrix holds, for each pair of
states of the legal role sequence, the least cost; a rule's matrix is the
min-plus product of its two letters', computed once and shared by all conversations.

Audits are ropes: an entry remembers the state between its two halves, so its
audit is the left half's followed by the right half's.  Ties need no text: audits
from one state to different states differ before the shorter one ends (each ends
with its last row's action, and equal edits lead to equal states), so the smaller left half
decides, else the smaller right half, and a matrix carries the rank of its audits.
Blocks of a conversation are joined in the same way, by their costs and ranks alone.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplesmith.llm.common import cut

BLOCK = 16  # bits: blocks of 65,536 rows
ROUNDS, RULES = 6, 32
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLED, DELETED, INSERTED, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 60
SPACE = " \t\n\x0b\x0c\r"
OTHER = "o"
INITIALS = "sua" + OTHER
FAULTS = {"": "", "truncated": "t", "gone": "x"}
#: States: nothing yet, after a system row, after a user row, after an assistant row.
FIRST, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {FIRST: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (FIRST, ASSISTANT)
ROLE = {"u": "user", "a": "assistant"}
#: One letter for each initial and fault; rows that must go are alike whatever their role.
LETTERS = {(i, f): chr(ord("A") + 4 * k + j) for k, f in enumerate(["", "truncated"]) for j, i in enumerate(INITIALS)} | {
    (i, "gone"): "X" for i in INITIALS}
NEW = 0xE000  # first code point of the rules' letters


class Matrix:
    """Least costs between states, ranks of the least audits from each state, and the way to spell them."""

    __slots__ = ("cost", "rank", "middle", "parts", "base")

    def __init__(self, cost: list[list[int]], rank: list[list[int]], middle: list | None, parts: tuple | None, base: list | None) -> None:
        self.cost, self.rank, self.middle, self.parts, self.base = cost, rank, middle, parts, base

    def spell(self, start: int, end: int) -> str:
        """The audit from ``start`` to ``end``, read off the rope without recursion."""
        out, todo = [], [(self, start, end)]
        while todo:
            m, i, j = todo.pop()
            if m.parts is None:
                out.append(m.base[i][j])
            else:
                k = m.middle[i][j]
                todo += [(m.parts[1], k, j), (m.parts[0], i, k)]
        return "".join(out)


def inserts(state: int) -> Iterator[tuple[int, str]]:
    """States reachable by inserts, with the inserts' letters."""
    seen, path = {state}, ""
    yield state, path
    while (n := FOLLOWS[state].get("u", FOLLOWS[state].get("a"))) not in seen:
        state, path = n, path + INSERT
        seen.add(state)
        yield state, path


def actions(initial: str, fault: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(action, cost, next state) of one row in a state."""
    yield DELETE, DELETED, state
    if fault != "gone":
        more = TRUNCATED if fault == "truncated" else 0
        if initial in FOLLOWS[state]:
            yield KEEP, more, FOLLOWS[state][initial]
        for role in ROLE:
            if role in FOLLOWS[state]:
                yield REROLE, REROLED + more, FOLLOWS[state][role]


def letter_matrix(initial: str, fault: str) -> Matrix:
    """Inserts and then the action of one row."""
    best = [[(NEVER, "")] * 4 for _ in range(4)]
    for start in range(4):
        for between, path in inserts(start):
            for action, cost, end in actions(initial, fault, between):
                best[start][end] = min(best[start][end], (INSERTED * len(path) + cost, path + action))
    rank = []
    for row in best:
        spelled = sorted({text for cost, text in row if cost < NEVER})
        rank.append([spelled.index(text) if cost < NEVER else 0 for cost, text in row])
    return Matrix([[c for c, _ in row] for row in best], rank, None, None, [[t for _, t in row] for row in best])


def product(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product; ties go to the smaller audit."""
    cost, rank, middle = [], [], []
    for i in range(4):
        c, m = [], []
        for j in range(4):
            least, _, k = min((min(a.cost[i][k] + b.cost[k][j], NEVER), a.rank[i][k], k) for k in range(4))
            c.append(least)
            m.append(k)
        order = {key: n for n, key in enumerate(sorted({(a.rank[i][m[j]], b.rank[m[j]][j]) for j in range(4) if c[j] < NEVER}))}
        cost.append(c)
        middle.append(m)
        rank.append([order.get((a.rank[i][m[j]], b.rank[m[j]][j]), 0) for j in range(4)])
    return Matrix(cost, rank, middle, (a, b), None)


class Grammar:
    """Re-Pair rules in the order they were made, and each letter's matrix, bottom-up."""

    def __init__(self, rules: list[str]) -> None:
        self.rules = rules
        self.matrix = {letter: letter_matrix(*key) for key, letter in LETTERS.items()}
        for n, pair in enumerate(rules):
            self.matrix[chr(NEW + n)] = product(self.matrix[pair[0]], self.matrix[pair[1]])

    def compress(self, text: str) -> str:
        for n, pair in enumerate(self.rules):
            if pair in text:
                text = text.replace(pair, chr(NEW + n))
        return text

    def evaluate(self, text: str) -> Matrix:
        """The matrix of a whole string, by halves, so its rope is shallow."""
        row = [self.matrix[c] for c in self.compress(text)]
        while len(row) > 1:
            row = [product(*row[i:i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        return row[0]


def repair_grammar(strings: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> list[str]:
    """Re-Pair over all distinct strings ``(text)``: each round makes rules of the most frequent pairs of letters.

    A round counts all pairs on Spark; only its ``rules`` most frequent ones reach the driver.
    """
    made: list[str] = []
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], so_far: tuple = tuple(made)) -> Iterator[pa.RecordBatch]:
            grammar, pairs = Grammar(list(so_far)), Counter()
            for b in batches:
                for text in b.column("text").to_pylist():
                    text = grammar.compress(text)
                    pairs.update(map("".join, zip(text, text[1:])))
            yield pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.string()), pa.array(list(pairs.values()), pa.int64())], ["pair", "n"])
        counts = strings.mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        top = [r["pair"] for r in counts.orderBy(F.desc("n"), "pair").limit(rules).collect()]
        if not top:
            break
        made += top
    return made


def damage(rows: DataFrame) -> DataFrame:
    """The rows after damage by the remainder of crc32(`conv_id:turn`) by 20; nulls are one space, a null turn stays null."""
    one = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce(F.col("text").cast("string"), one), F.coalesce(F.col("role").cast("string"), one)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"),
                                         F.explode(copies).alias("copy")).drop("copy"))


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pos``, which rises in the order (conv_id, turn, role, text); written, so it stays.

    Ranges cut inside a conversation too, so none is held by one task.
    """
    keys = ["conv_id", "turn", "role"]
    ranged = rows.repartitionByRange(*keys, F.substring("text", 1, 32)).sortWithinPartitions(*keys, "text")
    return cut(ranged.withColumn("pos", F.monotonically_increasing_id()))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, pos) as ``(conv_id, pos, turn, initial, fault)``."""
    said = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    letter = F.col("role").substr(1, 1)
    # the last character that is no white space: what is left in front of it does not matter
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    light = rows.select("conv_id", "pos", "turn", F.when(letter.isin("s", "u", "a"), letter).otherwise(OTHER).alias("initial"),
                        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"), said.alias("said"))
    seen = light.groupBy(F.col("conv_id").alias("__c"), F.col("said").alias("__said")).agg(F.min("pos").alias("earliest"))
    on = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("said") == F.col("__said"))
    fault = (F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("earliest"), "duplicate")
             .when(F.col("truncated"), "truncated").otherwise(""))
    return light.join(seen, on).select("conv_id", "pos", "turn", "initial", fault.alias("fault"))


def _block() -> Column:
    return F.shiftright("pos", BLOCK)


def blocks(rows: DataFrame) -> DataFrame:
    """``(conv_id, block, pos, text, initials, blank, duplicate, truncated)``: a string of letters per block of rows."""
    gone = F.when(F.col("fault").isin("blank", "duplicate"), "gone").otherwise(F.col("fault"))
    letter = F.create_map(*[F.lit(x) for (i, f), c in LETTERS.items() for x in (i + f, c)])[F.concat("initial", gone)]
    listed = F.sort_array(F.collect_list(F.struct("pos", letter.alias("letter"), "initial")))
    count = {f: F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")}
    return (rows.groupBy("conv_id", _block().alias("block")).agg(F.min("pos").alias("pos"), listed.alias("l"), *count.values())
            .select("conv_id", "block", "pos", F.array_join("l.letter", "").alias("text"), F.array_join("l.initial", "").alias("initials"),
                    *count))


def matrices(strings: DataFrame, rules: list[str]) -> DataFrame:
    """``(text, cost, rank, audit)``: the matrix of every distinct string, row by row, and its audits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [grammar.evaluate(t) for t in texts]
            flat = [[[x for row in part for x in row] for part in (m.cost, m.rank)] for m in found]
            audit = [[m.spell(i, j) if m.cost[i][j] < NEVER else "" for i in range(4) for j in range(4)] for m in found]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([f[0] for f in flat], pa.list_(pa.int64())),
                                              pa.array([f[1] for f in flat], pa.list_(pa.int32())), pa.array(audit, pa.list_(pa.string()))],
                                             ["text", "cost", "rank", "audit"])
    return strings.mapInArrow(run, "text string, cost array<long>, rank array<int>, audit array<string>")


@lru_cache(maxsize=1 << 16)
def best_path(costs: tuple, ranks: tuple) -> tuple[int, tuple[int, ...], str]:
    """(cost, states at the blocks' bounds, inserts at the end) of the cheapest edits, ASCII-least on ties."""
    here, back = {FIRST: (0, 0)}, []  # state -> cost, rank
    for cost, rank in zip(costs, ranks):
        options = {j: min((c + cost[4 * i + j], r, i) for i, (c, r) in here.items() if cost[4 * i + j] < NEVER)
                   for j in range(4) if any(cost[4 * i + j] < NEVER for i in here)}
        order = sorted((r, rank[4 * i + j], j) for j, (_, r, i) in options.items())
        place = {j: n for n, (_, _, j) in enumerate(order)}
        back.append({j: i for j, (_, _, i) in options.items()})
        here = {j: (c, place[j]) for j, (c, _, _) in options.items()}
    least, _, _, end, path = min((c + INSERTED * len(p), r, p, s, p) for s, (c, r) in here.items() for e, p in inserts(s) if e in ENDS)
    states = [end]
    for step in reversed(back):
        states.append(step[states[-1]])
    return least, tuple(states[::-1]), path


ILLEGAL = {"su", "ua", "au"}


def decisions(found: DataFrame) -> DataFrame:
    """Per block of ``found`` (blocks with cost, rank): states at its bounds, inserts after it, and its conversation's cost and adjacent faults.

    Only numbers of blocks meet here, a few for each 65,536 rows.
    """
    ends = F.struct("block", "cost", "rank", "initials")
    per = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(ends)).alias("b"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
                                       F.sum("within").alias("within"))
    kind = ("conv_id {}, block long, start int, end int, tail string, last boolean, cost long, blank long, duplicate long, truncated long, "
            "illegal long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for n, b in enumerate(batch.column("b").to_pylist()):
                cost, states, tail = best_path(tuple(tuple(x["cost"]) for x in b), tuple(tuple(x["rank"]) for x in b))
                counts = [batch.column(c)[n].as_py() for c in ("blank", "duplicate", "truncated")]
                illegal = batch.column("within")[n].as_py() + sum(x["initials"][-1] + y["initials"][0] not in ILLEGAL for x, y in zip(b, b[1:]))
                for k, x in enumerate(b):
                    last = k == len(b) - 1
                    ids.append(n)
                    out.append((x["block"], states[k], states[k + 1], tail if last else "", last, cost, *counts, illegal))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(ids, pa.int64())),
                                              *[pa.array([o[c] for o in out], t) for c, t in enumerate(types)]],
                                             ["conv_id", "block", "start", "end", "tail", "last", "cost", "blank", "duplicate", "truncated", "illegal"])
    return per.mapInArrow(run, kind.format(found.schema["conv_id"].dataType.simpleString()))


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``(conv_id, audit, repaired_sha256)``: one stream per conversation through its edits and its rows, in order.

    A digest has to be taken in order, so one task reads a conversation's rows; it holds one row and the
    audit at a time.  ``edits`` has (conv_id, pos, start, audit) per block.
    """
    both = (rows.select("conv_id", "pos", F.lit(1).alias("kind"), F.lit(0).alias("start"), "role", "text")
            .unionByName(edits.select("conv_id", "pos", F.lit(0).alias("kind"), "start", F.lit("").alias("role"), F.col("audit").alias("text"))))
    type_ = rows.schema["conv_id"].dataType.simpleString()
    columns = ["conv_id", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, open_, digest, empty, audits, audit, at, state = None, False, None, True, [], "", 0, FIRST
        arrow = None

        def say(role: str, text: str) -> None:
            nonlocal empty
            digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
            empty = False

        def insert_run() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == INSERT:
                role = next(r for r in ROLE if r in FOLLOWS[state])
                say(ROLE[role], "")
                state, at = FOLLOWS[state][role], at + 1

        def done() -> tuple:
            insert_run()
            return conv, "".join(audits), digest.hexdigest()

        for b in batches:
            arrow, out = b.column("conv_id").type, []
            for c, kind, start, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "kind", "start", "role", "text"))):
                if not open_ or c != conv:
                    if open_:
                        out.append(done())
                    conv, open_, digest, empty, audits, audit, at = c, True, hashlib.sha256(), True, [], "", 0
                if kind == 0:
                    audit, at, state = text, 0, start
                    audits.append(text)
                    continue
                insert_run()
                action, at = audit[at], at + 1
                if action == KEEP:
                    say(role, text)
                    state = FOLLOWS[state][role[0]]
                elif action == REROLE:
                    new = next(r for r in ROLE if r in FOLLOWS[state])
                    say(ROLE[new], text)
                    state = FOLLOWS[state][new]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], arrow), *[pa.array([o[k] for o in out], pa.string()) for k in (1, 2)]], columns)
        if open_:
            last = done()
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], arrow), pa.array([last[1]]), pa.array([last[2]])], columns)
    streamed = both.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind")
    return streamed.mapInArrow(run, f"conv_id {type_}, audit string, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``conversations`` (conv_id, turn, role, text), whose rows are repaired as they are.

    Columns: gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.  Rows
    go by (turn, role, text), nulls first; null roles and texts are one space; null ids are one
    conversation; repeated rows are duplicates.  An empty table gives no rows; other columns are ignored.
    """
    one = F.lit(" ")
    rows = ordered(conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), one).alias("role"),
                                        F.coalesce(F.col("text").cast("string"), one).alias("text")))
    found = cut(blocks(faults(rows)))
    strings = cut(found.select("text").distinct())
    evaluated = cut(matrices(strings, repair_grammar(strings)))
    pair = F.transform(F.sequence(F.lit(1), F.length("initials") - 1), lambda i: F.substring("initials", i, F.lit(2)))
    within = F.when(F.length("initials") > 1, F.size(F.filter(pair, lambda p: ~p.isin(*ILLEGAL)))).otherwise(0).cast("long")
    brief = found.withColumn("within", within).withColumn("initials", F.concat(F.left("initials", F.lit(1)), F.right("initials", F.lit(1))))
    decided = cut(decisions(brief.join(evaluated.drop("audit"), "text")))
    bounds = decided.select(F.col("conv_id").alias("__c"), F.col("block").alias("__b"), "start", "end", "tail")
    on = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("block") == F.col("__b"))
    audit = F.concat(F.element_at("audit", F.col("start") * 4 + F.col("end") + 1), F.col("tail"))
    edits = (found.select("conv_id", "block", "pos", "text").join(bounds, on).join(evaluated.select("text", "audit"), "text")
             .select("conv_id", "pos", "start", audit.alias("audit")))
    # turns in a row may be many: distinct ones are counted by a partial aggregate of their own
    turns = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    totals = decided.where("last").select("conv_id", "cost", "blank", "duplicate", "truncated", "illegal")
    told = repaired(rows, edits)
    parts = turns.withColumnRenamed("conv_id", "c1")
    out = totals.join(parts, F.col("conv_id").eqNullSafe(F.col("c1"))).drop("c1").join(
        told.withColumnRenamed("conv_id", "c2"), F.col("conv_id").eqNullSafe(F.col("c2"))).drop("c2")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged_repair(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows for every original ``conv_id``.

    A conversation without rows after damage has zeros, an empty audit and the empty text's digest.
    """
    found = repair(damage(conversations)).withColumnRenamed("conv_id", "c")
    ids = conversations.select("conv_id").distinct()
    zero = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    none = zero | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return (ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
            .select("conv_id", *[F.coalesce(c, v).alias(c) for c, v in none.items()]))
