"""MinHash near-dedup, conversation repair and spelling variants against brute force, and on awkward inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplesmith.llm import conversations as C
from samplesmith.llm import minhash, queries, spelling, suffix_dedup
from tests.conftest import SF
from tests.llm.test_operators import components_of

WIDE = "doc_id long, text string, n int, node string, key string, word string, component long, kept string"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, 1, "n", "k", "w", 7, "x") for i, t in rows], WIDE)


# --- MinHash ---------------------------------------------------------------------------

def shingles(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < k else (tuple(words[i:i + k]) for i in range(len(words) - k + 1)))


def near_by_hand(rows, percent=85):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}

    def near(a, b):
        x, y = sets[a], sets[b]
        return bool(x) and bool(y) and 100 * len(x & y) >= percent * len(x | y)
    of = components_of(list(sets), near)
    return {i: (len(s), of[i]) for i, s in sets.items()}


def edited(rnd, words, n):
    words = list(words)
    for at in rnd.sample(range(len(words)), n):
        words[at] = f"new{rnd.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_rows():
    """A dense group around the similarity, pairs on either side of it, chains, and texts that share a long passage only."""
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(4000)]
    base = [rnd.choice(words) for _ in range(120)]
    out = [edited(rnd, base, rnd.choice([0, 1, 2, 3, 4, 6, 9])) for _ in range(90)]
    for n in range(1, 40):
        text = [rnd.choice(words) for _ in range(rnd.randint(3, 90))]
        out += [" ".join(text).upper() if n % 2 else " ".join(text), edited(rnd, text, min(len(text), n % 5))]
    step = [rnd.choice(words) for _ in range(100)]
    for _ in range(8):
        step = edited(rnd, step, 2).split()
        out.append(" ".join(step))
    out += [" ".join(base[:80] + [rnd.choice(words) for _ in range(60)]) for _ in range(20)]
    return [(3 * k + 1, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("chunk", [minhash.CHUNK, 4])
def test_minhash_links(spark, near_rows, chunk):
    found = minhash.near_dedup(wide(spark, near_rows).repartition(5), chunk=chunk).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == near_by_hand(near_rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_minhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op11_minhash(spark, SF).collect()}
    assert found == near_by_hand(rows)


def test_minhash_awkward(spark):
    long_text = " ".join(f"x{i % 5000} y{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (4, "one"), (5, "one two"), (6, "ONE\ttwo"), (None, "a b c d"), (9, "a b c d"),
            (None, "alone here"), (10, long_text), (11, long_text + " z"), (12, "one")]
    found = minhash.near_dedup(wide(spark, rows)).collect()
    assert len(found) == len(rows)
    by = defaultdict(set)
    for r in found:
        by[r.doc_id].add((r.component_id, r.kept))
    assert by[1] == {(1, True)} and by[2] == {(2, True)} and by[3] == {(3, True)}
    assert by[4] == {(4, True)} and by[12] == {(4, False)} and by[6] == {(5, False)} and by[11] == {(10, False)}
    assert by[None] == {(9, False), (None, True)}
    assert minhash.near_dedup(wide(spark, [])).collect() == []


def test_match_threshold():
    rnd = np.random.default_rng(0)
    t = minhash.match_threshold(0.85)
    assert (rnd.binomial(minhash.COORDINATES, 0.85, 100_000) >= t).all() and t > minhash.COORDINATES / 2


def test_parities_bound_the_difference():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
    for n in (0, 3, 50, 400):
        y = np.r_[x[n:], rnd.integers(0, 1 << 63, n // 2, dtype=np.uint64)]
        assert np.bitwise_count(minhash.parities(x) ^ minhash.parities(y)).sum() <= len(np.setxor1d(x, y))


# --- repeated rows of the suffix dedup ---------------------------------------------------

def test_suffix_dedup_of_one_row_repeated(spark):
    """The spans gathered for equal rows are those of one text, however many rows there are."""
    text = " ".join(f"w{k * 7919 % 4001}" for k in range(700))
    for n in (2, 60):
        rows = spark.createDataFrame([(7, text)] * n + [(None, text + " z")] * n, "doc_id long, text string").repartition(8)
        found = suffix_dedup.dedup(rows, length=200)
        sizes = found.select(F.size("removed").alias("runs"), F.length("kept").alias("kept"), "n_bytes").distinct().collect()
        assert all(r.runs == 1 and r.kept == 0 for r in sizes)
    runs = suffix_dedup.dedup(spark.createDataFrame([(7, text)] * 300, "doc_id long, text string"), length=200)
    assert runs.where(F.size("removed") == 1).count() == 300


# --- conversations --------------------------------------------------------------------------

KEYS = [(i, f) for i in C.INITIALS for f in ("", "truncated", "gone")]


def all_edits(rows):
    """The least (cost, audit) over every sequence of edits with at most two inserts in a row."""
    found = []

    def go(i, state, cost, audit, inserted):
        if i == len(rows) and state in C.ENDS:
            found.append((cost, audit))
        if inserted < 2:
            for role in "ua":
                if role in C.FOLLOWS[state]:
                    go(i, C.FOLLOWS[state][role], cost + 3, audit + "I", inserted + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, state, cost + 4, audit + "D", 0)
            if fault != "gone":
                more = 3 if fault else 0
                if initial in C.FOLLOWS[state]:
                    go(i + 1, C.FOLLOWS[state][initial], cost + more, audit + "K", 0)
                for role in "ua":
                    if role in C.FOLLOWS[state]:
                        go(i + 1, C.FOLLOWS[state][role], cost + 3 + more, audit + "R", 0)
    go(0, C.FIRST, 0, "", 0)
    return min(found)


def by_grammar(rows, rules, cuts):
    text = "".join(C.LETTERS[k] for k in rows)
    found = [C.Grammar(rules).evaluate(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
    cost, states, tail = C.best_path(*(tuple(tuple(itertools.chain(*getattr(m, what))) for m in found) for what in ("cost", "rank")))
    return cost, "".join(m.spell(states[i], states[i + 1]) for i, m in enumerate(found)) + tail


def test_grammar_against_all_edits():
    rnd = random.Random(3)
    letters = sorted(set(C.LETTERS.values()))
    for _ in range(400):
        rows = [rnd.choice(KEYS) for _ in range(rnd.randint(1, 5))]
        rules = []
        for n in range(rnd.randint(0, 6)):
            pool = letters + [chr(C.NEW + i) for i in range(n)]
            rules.append(rnd.choice(pool) + rnd.choice(pool))
        cuts = sorted(rnd.sample(range(1, len(rows)), rnd.randint(0, len(rows) - 1)))
        assert by_grammar(rows, rules, cuts) == all_edits(rows)


def repaired_by_hand(rows):
    """conv_id -> the contract's columns, by a plain dynamic program that keeps whole audits and lines."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, v in groups.items():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, _, _ in v if t is not None}
        counts, seen, faults = Counter(), set(), []
        for _, role, text in v:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        counts.update(faults)

        def inserted(best):
            for _ in range(3):
                for s, (cost, audit, lines) in list(best.items()):
                    for r in "ua":
                        if r in C.FOLLOWS[s]:
                            e, new = C.FOLLOWS[s][r], (cost + 3, audit + "I", (lines, C.ROLE[r] + ":"))
                            if e not in best or new[:2] < best[e][:2]:
                                best[e] = new
            return best
        best = inserted({C.FIRST: (0, "", ())})
        for (_, role, text), fault in zip(v, faults):
            after = {}
            for s, (cost, audit, lines) in best.items():
                options = [(cost + 4, audit + "D", lines, s)]
                if fault not in ("blank", "duplicate"):
                    cost += 3 if fault else 0
                    if role[:1] in C.FOLLOWS[s]:
                        options.append((cost, audit + "K", (lines, f"{role}:{text}"), C.FOLLOWS[s][role[:1]]))
                    options += [(cost + 3, audit + "R", (lines, f"{C.ROLE[r]}:{text}"), C.FOLLOWS[s][r]) for r in "ua" if r in C.FOLLOWS[s]]
                for *new, e in options:
                    if e not in after or tuple(new[:2]) < after[e][:2]:
                        after[e] = tuple(new)
            best = inserted(after)
        cost, audit, lines = min((best[s] for s in C.ENDS if s in best), key=lambda b: b[:2])
        said = []
        while lines:
            lines, line = lines
            said.append(line)
        illegal = sum(a[1][:1] + b[1][:1] not in C.ILLEGAL for a, b in zip(v, v[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal,
                     cost, audit, hashlib.sha256("\n".join(said[::-1]).encode()).hexdigest())
    return out


def damaged(spark, rows):
    kind = "conv_id long, turn long, role string, text string, pos string, block int, initial string, audit string"
    table = spark.createDataFrame([(*r, "p", 1, "i", "a") for r in rows], kind)
    return {r[0]: tuple(r[1:]) for r in C.damaged_repair(table.repartition(3)).collect()}


def test_conversations_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: tuple(r)[1:] for r in queries.op12_conversations(spark, SF).collect()}
    assert found == repaired_by_hand(rows)


def test_conversations_awkward_and_blocks(spark, monkeypatch):
    """Nulls, repeated rows, odd roles, ties of turns; a long conversation over many blocks."""
    rnd = random.Random(2)
    roles = ["user", "assistant", "system", None, "", "tool", "ux"]
    rows = [(c, rnd.choice([None, *range(9)]), rnd.choice(roles), rnd.choice(["Hi.", "yes", "", " ", None, "ok! \n", "é…", "a\nb?", "x" * 50_000]))
            for c in [None, *range(25)] for _ in range(rnd.choice([1, 2, 3, 9, 20]))]
    rows += rows[:20] + [(777, i, rnd.choice(["user", "assistant"]), rnd.choice([f"Hi {i}.", "no"])) for i in range(600)]
    rows += [(888, None, "user", "Hi.")] * 30
    monkeypatch.setattr(C, "BLOCK", 5)
    assert damaged(spark, rows) == repaired_by_hand(rows)


def test_conversations_empty(spark):
    assert damaged(spark, []) == {}
    dropped = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    assert damaged(spark, [(dropped, 0, "user", "Hi.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repair_grammar_shortens(spark):
    strings = spark.createDataFrame([("BC" * 20,), ("ABCBC",), ("X",)], "text string")
    rules = C.repair_grammar(strings, rounds=3, rules=2)
    assert "BC" in rules and len(C.Grammar(rules).compress("BC" * 20)) <= 10


# --- spelling -----------------------------------------------------------------------------------

def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def spelling_by_hand(rows, min_length=6, min_count=5, ratio=5):
    total = Counter()
    for doc, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), word)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            total[word] += 1
    n = {w: k for w, k in total.items() if len(w) >= min_length and k >= min_count}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def variants(found):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()}


@pytest.mark.parametrize("hot", [spelling.HOT, 3])
def test_spelling_chains(spark, hot):
    """Edits at every place, chains of forms, ties, letters beyond ASCII, and blocks posted again."""
    rnd = random.Random(4)
    rows, words = [], ["abcdef", "aabbcc", "éabcdeé", "zzzzzz", "pineapple", "ÀÉabcd"]
    for _ in range(60):
        w = rnd.choice(words)
        at, c = rnd.randrange(len(w) + 1), rnd.choice("abzé")
        words.append(rnd.choice([w[:at] + c + w[at:], w[:at] + c + w[at + 1:], (w[:at] + w[at + 1:]) if len(w) > 6 else w + c]))
    for k, w in enumerate(dict.fromkeys(words)):
        rows += [(k % 7, " ".join([w.upper() if k % 3 else w] * rnd.choice([4, 5, 6, 30, 160])))]
    assert variants(spelling.variants(wide(spark, rows), hot=hot)) == spelling_by_hand(rows)


def test_spelling_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert variants(queries.op13_spelling(spark, SF)) == spelling_by_hand(rows)


def test_spelling_awkward(spark):
    rows = [(1, None), (2, ""), (None, "letters " * 6), (3, "letters letter1 " * 9), (3, "letters letter1 " * 9), (4, "q" * 3000 + " "), (5, "12 34"),
            *[(k, "w" * 200 + "é ×÷×÷×÷") for k in range(10, 17)], *[(k, "w" * 201) for k in range(20, 60)]]
    assert variants(spelling.variants(wide(spark, rows))) == spelling_by_hand(rows)
    assert spelling.variants(wide(spark, [])).collect() == []


def test_one_edit_lists():
    rnd = random.Random(3)
    for _ in range(60):
        words = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 40))})
        block = np.sort([rnd.randint(0, 2) for _ in words])
        size = np.array([len(w) for w in words])
        letters = np.zeros((len(words), size.max()), np.uint32)
        for i, w in enumerate(words):
            letters[i, :len(w)] = [ord(c) for c in w]
        a, b = spelling.one_edit(letters, size, block)
        assert sorted(zip(a.tolist(), b.tolist())) == [(i, j) for i, x in enumerate(words) for j, y in enumerate(words)
                                                       if block[i] == block[j] and one_edit(x, y)]
