"""The training-data operators against brute force, and on awkward inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as PT
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import __spark_entry__ as E
from samplesmith.llm import (common, components, decontaminate, langid, lempel_ziv, license_scan, packing, paragraph_dedup, queries,
                             simhash, suffix_dedup, token_count, toxicity)
from tests.conftest import SF

KIND = "doc_id long, text string, lang string, source string, n_chars long, fp string, row string, start int, score string"
PASSAGE = " ".join(f"word{i} and" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, an equal text under two ids, a long text, clashing columns."""
    long_text = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta", "öl", "日本"]) + str(i % 97) for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (4, "one"), (5, "A B c D e"), (None, PASSAGE), (6, PASSAGE), (7, "x " + PASSAGE),
            (8, long_text), (9, "12 34 5"), (10, "zero \x00 byte"), (11, "You are an idiot. He said: not an idiot!"), (None, None)]
    return spark.createDataFrame([(i, t, "en", None, None, "f", "r", 3, "s") for i, t in rows], KIND)


def components_of(ids, near):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def simhash_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_matches_brute_force(docs, texts):
    fp = {i: simhash_by_hand(t) for i, t in texts.items()}
    want = components_of(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(docs.sparkSession, SF).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_bk_links_lose_no_component():
    rng = random.Random(4)
    for _ in range(40):
        base = rng.getrandbits(64)
        points = list({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 7))) for _ in range(60)})
        want = components_of(sorted(points), lambda a, b: (a ^ b).bit_count() <= 4)
        links = simhash.star_links(points, 4)
        ends = {p: p for p in points} | {a: b for a, b in links}
        assert len({ends[p] for p in points}) == len(set(want.values()))
        assert all(want[a] == want[b] for a, b in links)


def test_hot_shards_and_bands_are_split_without_loss(spark):
    rng = random.Random(12)
    points = sorted({rng.getrandbits(3) << 60 | sum(1 << rng.randrange(64) for _ in range(4)) for _ in range(160)})
    near = {p: simhash._signed(p) for p in points}
    want = components_of(points, lambda a, b: (a ^ b).bit_count() <= 4)
    rows = spark.createDataFrame([(x,) for x in near.values()], "fp long")
    groups = defaultdict(set)
    for p, c in want.items():
        groups[c].add(near[p])
    for limit in (3, 40, 1000):
        got = defaultdict(set)
        for r in components.connected_components(simhash.links(rows, 4, limit)).collect():
            got[r.component].add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)

    keyed = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7), (2, 8), (None, 1)], "k long, m long")
    parts = defaultdict(set)
    for r in common.split_hot(keyed, "k", "m", 10).collect():
        parts[r.k, r.part].add(r.m)
    for k, members in ((1, range(50)), (2, (7, 8))):
        met = {(a, b) for (key, _), p in parts.items() if key == k for a in p for b in p}
        assert met == {(a, b) for a in members for b in members}
    assert max(map(len, parts.values())) < 40

    words = [f"w{i}" for i in range(60)]
    lines = [" ".join([*words[:i % 50], f"x{i}", *words[i % 50 + 1:]]) for i in range(30)]
    d = spark.createDataFrame([(i, t.encode(), i) for i, t in enumerate(lines)], "row long, text binary, doc_id long")
    first = paragraph_dedup.classes(paragraph_dedup.occurrences(d)).where("kind = 1").select("key", "row", "w0", "w1")
    found = [{(r.node, r.component) for r in components.connected_components(
        paragraph_dedup.near_lines(d, first, 0.8, limit)).collect()} for limit in (4, 1000)]
    assert found[0] == found[1] and len(found[0]) == 30


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (8, 7), (3, 1), (2, 1), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(41)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_leave_one(spark, odd):
    kept = simhash.keep_first(odd)
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert kept.columns == odd.columns
    assert 2 not in ids and 3 not in ids and ids.count(4) == 1 and ids.count(1) == 1


def removed_by_hand(texts, length):
    seen = Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        out.append(bytes(x for x, g in zip(b, gone) if not g))
    return out


def test_suffix_dedup_matches_brute_force(docs, texts):
    ids = sorted(texts)
    want = dict(zip(ids, removed_by_hand([texts[i].encode() for i in ids], 200)))
    got = {r.doc_id: r for r in queries.op8_suffix_dedup(docs.sparkSession, SF).collect()}
    assert {i: r.kept_sha256 for i, r in got.items()} == {i: hashlib.sha256(b).hexdigest() for i, b in want.items()}
    assert all(r.n_removed == len(texts[i].encode()) - len(want[i]) for i, r in got.items())


def test_suffix_dedup_on_repetitive_texts(spark):
    rng = random.Random(2)
    cases = ["ab" * 60, "a" * 90, "".join(rng.choice("ab") for _ in range(300)), "x" * 23, "x" * 24, "x" * 25]
    for _ in range(12):
        s = "".join(rng.choice("abc") for _ in range(rng.randint(0, 80)))
        cases += [s + cases[0][:rng.randint(0, 40)], "".join(rng.choice("abc") for _ in range(10)) + s[5:]]
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for length, gram, limit in ((24, 8, 1000), (24, 8, 2), (19, 19, 1000)):
        got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(rows, length, gram, limit).collect()}
        assert [got[i] for i in range(len(cases))] == removed_by_hand([c.encode() for c in cases], length)


def test_spans_match_across_batches(spark):
    """Any cut of the sorted spans into batches gives the same repeated and open spans."""
    rng = random.Random(5)
    rows = [(a, d, i, i * 7, 1, 0, rng.choice([0, 0, 0, 1, 2])) for i, (a, d) in
            enumerate((rng.randrange(12), rng.randrange(3)) for _ in range(300))]
    found = spark.createDataFrame(rows, suffix_dedup._sql(suffix_dedup.SPAN)).repartition(5)
    live = [r for r in rows if r[6] != 2]
    size, spans = Counter(), defaultdict(set)
    for r in live:
        size[r[:2]] += r[6] + 1
        spans[r[0]].add(r[1])
    repeated = {r[2] for r in rows if r[6] == 2} | {r[2] for r in live if size[r[:2]] > 1}
    open_spans = sorted({r[:2] for r in live if len(spans[r[0]]) > 1})
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for n in (1, 2, 3, 7, 10000):
            spark.conf.set(name, str(n))
            got = suffix_dedup.match_spans(found).collect()
            assert sorted(r.row for r in got if not r.open) == sorted(repeated)
            assert sorted(rows[r.row][:2] for r in got if r.open) == open_spans
    finally:
        spark.conf.set(name, before)


def test_lempel_ziv_contract(docs, texts):
    rows = sorted(texts.items())
    got = {r.doc_id: r for r in lempel_ziv.fingerprints(docs, rows=17).collect()}
    by_text = defaultdict(set)
    for k, (i, text) in enumerate(rows):
        nxt_id, nxt = rows[(k + 1) % len(rows)]
        n = len(text)
        edited = text[:n - n // 2] + nxt[:n // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        by_text[text].add(got[i].fingerprint)
        p = lempel_ziv.Phrases()
        p.feed(edited)
        assert lempel_ziv.text_of(p.signature()) == got[i].edited_fingerprint
    assert all(len(x) == 1 for x in by_text.values())
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9


def test_phrases_match_plain_parse():
    rng = random.Random(3)
    for _ in range(200):
        s = "".join(rng.choice("abé") for _ in range(rng.randint(0, 60)))
        known, cur = set(), ""
        for c in s:
            cur += c
            if cur not in known:
                known.add(cur)
                cur = ""
        p, k = lempel_ziv.Phrases(), rng.randint(0, 60)
        p.feed(s[:k])
        p.signature_with("aab" * 5)
        p.feed(s[k:])
        assert p.known == known


def test_packing_contract(docs, texts):
    exact = Tokenizer.from_file(PT.path("byte_bpe_50k.json"))
    ids = {i: exact.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}
    got = queries.op3_packing(docs.sparkSession, SF).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        import zlib
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())
    for i, p in pieces.items():
        p.sort(key=lambda r: r.piece)
        assert [r.piece for r in p] == list(range(len(p)))
        assert p[0].start == 0 and all(a.start + a.length == b.start and b.length == 1024 for a, b in zip(p, p[1:]))
        assert sum(r.length for r in p) == len(ids[i])
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(pieces) == len(texts)


def test_bin_completion_is_valid_and_no_worse_than_best_fit():
    rng = random.Random(6)
    for _ in range(60):
        counts = Counter(rng.randint(1, 60) for _ in range(rng.randint(0, 80)))
        plan = packing.complete_bins(dict(counts), 60)
        used = Counter()
        for filling, times in plan:
            assert sum(k * n for k, n in filling) <= 60
            for k, n in filling:
                used[k] += n * times
        assert used == counts
        assert sum(t for _, t in plan) <= sum(t for _, t in packing.best_fit(dict(counts), 60))


def test_special_token_text_goes_through_the_tokenizer():
    exact = Tokenizer.from_file(PT.path("byte_bpe_50k.json"))
    ids = packing.Ids(PT.path("byte_bpe_50k.json"), PT.path("byte_bpe_50k.tiktoken"), PT.PATTERN)
    for t in ("a <|endoftext|> b", "", "  a\n b 日本", "it's 12345 ..."):
        assert ids(t) == np.array(exact.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def unigram(vocabulary, byte_fallback):
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return t


def test_token_counts_follow_the_tokenizer(docs, texts):
    vocabulary = token_count.sentencepiece_vocabulary(PT.path("piece_bpe_32k.model"))
    exact = unigram(vocabulary, True)
    got = {r.doc_id: r.n_tokens for r in queries.op10_token_counts(docs.sparkSession, SF).collect()}
    assert got == {i: len(exact.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_token_ties_and_unknowns():
    rng = random.Random(3)
    for _ in range(1500):
        vocabulary = {"".join(rng.choice("ab▁c") for _ in range(rng.randint(1, 3))): float(-rng.randint(0, 3)) for _ in range(rng.randint(1, 9))}
        fallback = rng.random() < 0.5
        if fallback:
            vocabulary |= {f"<0x{i:02X}>": 0.0 for i in range(256)}
        text = "".join(rng.choice("ab c☃") for _ in range(rng.randint(0, 9)))
        want = len(unigram(list(vocabulary.items()), fallback).encode(text, add_special_tokens=False).ids) if text else 0
        assert token_count.Counter(list(vocabulary.items()))(text)[0] == want


def test_tokens_of_long_words_without_spaces():
    """A word of 100,000 characters that no piece joins, alone and among others, against the whole path."""
    vocabulary = token_count.sentencepiece_vocabulary(PT.path("piece_bpe_32k.model"))
    count = token_count.Counter(vocabulary)
    for c in "°€":
        assert c * 2 not in count.pairs and count(c * 100_000)[0] == 100_000
    assert sum(map(len, count.known)) < 1000  # no prefixes are kept
    exact = unigram(vocabulary, True)
    for text in ("°" * 3000 + "word", "a°°b" * 900, "日本°語" * 700 + " and°°°more" + "€" * 1200):
        marked = token_count.SPACE + text.replace(" ", token_count.SPACE)
        assert count(text) == token_count.Counter(vocabulary)._solve(marked)[1::-1]
        assert count(text)[0] == len(exact.encode(text, add_special_tokens=False).ids)


def test_language_on_the_held_out_fold(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(d)
    got = langid.predict(d, model, keep=["doc_id", "lang"]).where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    en, de = (d.where(F.col("lang") == x).orderBy(F.length("text").desc()).first().text[:2000] for x in ("en", "de"))
    mixed = dict(langid.infer((en + " " + de).encode(), model))
    assert set(mixed) == {"en", "de"} and min(mixed.values()) > 0.3


def test_language_of_odd_texts(spark, odd):
    got = sorted((r.lang_pred, r.score) for r in langid.predict(odd, langid.learn(odd)).collect())
    assert got.count(("und", 0.0)) == 5 and len(got) == 14  # two nulls, empty, blank, digits
    empty = langid.learn(odd.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}


def test_toxicity_held_out_by_language(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.learn(d, labels)
    got = (toxicity.score(d, grammar).join(labels, "doc_id").join(d.select("doc_id", "lang"), "doc_id")
           .where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect())
    for lang, least in {"en": 0.9, "de": 0.9, "fr": 0.9, "es": 0.7}.items():
        hit = [r.score >= 0.3 for r in got if r.toxic and r.lang == lang]
        flagged = [r.score >= 0.3 for r in got if r.toxic == 0 and r.lang == lang]
        assert np.mean(hit) > least and np.mean(flagged) < 0.03, lang


def test_toxicity_grammar_order_and_scope():
    g = toxicity.Grammar(word={"idiot": 4.0})

    def rate(text):
        return [round(x, 6) for x in toxicity.sentence_scores(toxicity.TOKEN.findall(text), g)]
    assert {t: rate(t) for t in ("the idiot", "you idiot", "idiot that you are", "not the idiot", "you idiot not")} == {
        "the idiot": [4.0], "you idiot": [6.0], "idiot that you are": [6.0], "not the idiot": [1.6], "you idiot not": [2.4]}
    # a negation denies the next words of its clause only
    assert rate("never in his whole long life was that idiot") == [4.0] and rate("not here, idiot") == [0.0, 4.0]
    assert rate("an idiot not at all here") == [4.0]
    # reported speech before and after, also over a clause break; the speaker is no target
    assert rate("she said idiot") == rate("an idiot he said") == [2.4]
    assert rate("he said: you are an idiot") == [0.0, 3.6] and rate("you are an idiot, he said") == [3.6, 0.0]
    assert rate("you are an idiot, as all the neighbours said") == [6.0, 0.0]
    assert rate("he said so, idiot") == [0.0, 4.0]
    # a threat needs an object
    assert rate("i will kill you") == rate("je te frapper") == [4.5] and rate("kill the lights") == rate("you kill the lights") == [0.0]
    assert rate("i will never kill you") == [1.8] and rate("he said i will kill you") == [2.7]
    assert toxicity.clause_score("you idiot".split(), g) == 6.0 and rate("") == [0.0]


def test_toxicity_composed_machines_mark_as_their_parts():
    rng = random.Random(4)
    for whole, parts in ((toxicity.FROM_LEFT, [(0, toxicity._negation), ("none", toxicity._report), (False, toxicity._target),
                                               (0, toxicity._clitic)]),
                         (toxicity.FROM_RIGHT, [(-1, toxicity._final_negation), ("end", toxicity._final_report),
                                                ("none", toxicity._following_target)])):
        for _ in range(300):
            tape = rng.choices(toxicity.SYMBOLS, k=rng.randrange(12))
            want = [0] * len(tape)
            for state, step in parts:
                for i, symbol in enumerate(tape):
                    state, mark = step(state, symbol)
                    want[i] |= mark
            assert whole.marks(tape) == want


def test_toxicity_of_odd_texts(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.learn(odd, labels)).collect()
    assert len(got) == 14 and all(0 <= r.score <= 1 for r in got)


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "If Anna buys 3 apples and 5 pears for 12 km of road then Anna has 3 apples left today"),
                                   (3, None), (4, "...")], "item_id int, text string")
    asked = "If {0} buys {1} apples and {2} pears for {3} km of road then {4} has {5} apples left today"
    rows = [(1, "xx. " + asked.format("Bob", 7, 9, 40, "Bob", 7) + " zz"), (2, asked.format("Bob", 7, 9, 40, "Carl", 8)),
            (8, asked.format("Anna", 3, 5, 12, "Anna", 3)), (3, "nothing"), (4, None), (5, ""), (1, "xx. " + asked.format("Bob", 7, 9, 40, "Bob", 7) + " zz")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("item_id", F.lit(9))
    got = {r.doc_id: r.reparameterised for r in decontaminate.contamination(d, items).collect()}
    assert got == {1: True, 8: False}  # inconsistent values are another question
    assert sorted(r.doc_id for r in decontaminate.clean(d, items).collect()) == [2, 3, 4, 5]
    assert decontaminate.contamination(d.limit(0), items).count() == 0 == decontaminate.contamination(d, items.limit(0)).count()


def test_decontamination_of_repeated_windows(spark):
    """Verbatim items whose templates repeat, also twice in a document, are held; a scrambled copy is not."""
    choice = "Which city is the capital of France? A Paris B London C Berlin D Madrid"
    clauses = "Tom has 3 apples and 4 pears. Ann has 5 apples and 6 pears. Bob has 7 apples and 8 pears. How many pears are there?"
    train = "A train travels 60 km in 2 hours and 90 km in 3 hours and 150 km in 4 hours so how fast is it?"
    items = spark.createDataFrame([(1, choice), (2, clauses), (3, train)], "item_id int, text string")
    other = train.replace("60", "61").replace("90", "95").replace("150", "170")
    rows = [(1, choice), (2, clauses), (3, train), (4, f"Intro. {train} Then again: {other} End."), (5, f"{other} or {train}"),
            (6, clauses.replace("Ann", "Zoe")), (7, "so " + train.replace("in 3 hours", "in about 3 hours")),
            (8, clauses.replace("Ann", "Tom").replace("Bob", "Tom").replace("5", "3").replace("7", "3").replace("6", "4"))]
    got = {(r.doc_id, r.item_id): (r.slot_consistency, r.reparameterised)
           for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert {k: got.get(k) for k in [(1, 1), (2, 2), (3, 3), (4, 3), (5, 3)]} == dict.fromkeys([(1, 1), (2, 2), (3, 3), (4, 3), (5, 3)], (1.0, False))
    assert got[6, 2] == (1.0, True) and (8, 2) not in got


def test_decontamination_matches_brute_force(spark):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    items = con.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    rows = con.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()

    def grams(text):
        words = re.sub(r"[\W_]+", " ", text).strip().split(" ")
        c = ["<name>" if w[0].isupper() else w.lower() for w in words]
        c = ["<num>" if w[0].isnumeric() else w for w in c]
        return {tuple(c[i:i + 5]) for i in range(max(1, len(c) - 4))}
    asked = {i: grams(t) for i, t in items}
    want = set()
    for d, t in rows:
        have = grams(t)
        want |= {(d, i) for i, g in asked.items() if len(g & have) >= 0.8 * len(g)}
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontamination(spark, sf).collect()}
    assert got == want and got


def test_paragraph_dedup_finds_passages_and_near_lines(spark):
    rng = random.Random(8)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passage, line = prose(55), prose(80)
    near = line.split(" ")
    near[40] = "changed"
    clean = prose(200)
    rows = [(1, f"{prose(30)} {passage} {prose(20)}"), (2, f"{prose(11)} {passage} {prose(35)}"), (3, prose(9) + "\n" + line + "\n" + prose(7)),
            (4, " ".join(near)), (5, clean), (6, None), (7, ""), (8, prose(3))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed_spans", F.lit("x"))
    got = {r.doc_id: r for r in paragraph_dedup.dedup(d).collect()}
    text = dict(rows)
    assert [got[i].text for i in (1, 3, 5, 6, 7, 8)] == [text[i] for i in (1, 3, 5, 6, 7, 8)]
    assert got[4].text == "" and [text[2].encode()[s.start:s.end].decode().strip() for s in got[2].removed_spans] == [passage]
    assert paragraph_dedup.dedup(d.limit(0)).count() == 0


def test_repeated_rows_keep_their_text_in_paragraph_dedup(spark):
    """Rows that repeat id and text, or a text with null ids, are one document: in one batch and in several."""
    rng = random.Random(21)
    once, null, twice = (" ".join(f"{w}{rng.randrange(10 ** 6)}" for _ in range(60)) for w in "abc")
    rows = [(1, once), (1, once), (None, null), (None, null), (None, null), (2, f"{twice}\n{once}\n{twice}"), (2, f"{twice}\n{once}\n{twice}")]
    for parts in (1, 7):
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted((r.doc_id or 0, r.text) for r in paragraph_dedup.dedup(d).collect())
        assert got == [(0, null)] * 3 + [(1, once)] * 2 + [(2, twice + "\n")] * 2


def test_short_lines_go_only_with_their_neighbours(spark):
    short, word = "nine little words that stand on this one line", "les."
    verse = "one short line\nand another line of some more words here\n}\nthen the last line of it all, with ten more words"
    rows = [(1, f"alpha beta\n{short}\n{word}\nend one"), (2, f"{word}\ngamma delta\n  {short.upper()}\nend two\n{word}"),
            (3, f"before it\n{verse}\nbehind it"), (4, f"others\n{verse}\n}}\nand more"), (5, "only words of its own stay here\nles. petits")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("short", F.lit(1))
    got = {r.doc_id: r for r in paragraph_dedup.dedup(d, min_words=12, short="short").collect()}
    assert [got[i].text for i in (1, 2, 3, 5)] == [rows[i - 1][1] for i in (1, 2, 3, 5)]
    assert got[4].text == "others\n}\nand more" and [s.words for s in got[4].removed_spans] == [len(verse.split())]
    assert [s.words for s in got[2].short] == [1, 9, 1] and [s.words for s in got[4].short] == [1] and got[1].short == []
    assert [r.text for r in paragraph_dedup.dedup(d, min_words=100).orderBy("doc_id").collect()] == [r[1] for r in rows]


def test_paragraph_dedup_against_plain_search(spark):
    """Passages of 50 words or more that repeat an earlier place go whole; what goes repeats an earlier place."""
    rng = random.Random(77)

    def prose(n):
        return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    shared = [prose(n) for n in (6, 11, 25, 50, 51, 70, 140)]
    docs = []
    for _ in range(40):
        words = prose(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            words += p + prose(rng.randint(0, 40))
        docs.append(words)
    rows = [(i, "".join(w + rng.choice([" ", " ", " ", "\n"]) for w in words)) for i, words in enumerate(docs)]
    got = {r.doc_id: r.removed_spans for r in paragraph_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}

    def repeats(n):
        """Word places of each document that lie in ``n`` words which occur at an earlier place."""
        seen, out = set(), []
        for words in docs:
            at = set()
            for i in range(len(words) - n + 1):
                gram = tuple(words[i:i + n])
                if gram in seen:
                    at |= set(range(i, i + n))
                seen.add(gram)
            out.append(at)
        return out
    must, may = repeats(50), repeats(5)
    for i, text in rows:
        place, gone = [], set()
        for m in re.finditer(r"\S+", text):
            place.append(len(text[:m.start()].encode()))
        for s in got[i]:
            inside = {k for k, b in enumerate(place) if s.start <= b < s.end}
            assert s.words == len(inside) >= 20
            gone |= inside
        assert must[i] <= gone and len(gone - may[i]) <= 4 * len(got[i]), i  # changed words inside a near passage


def test_near_passages_inside_lines_go_whole(spark):
    """60 words with one changed, 100 with two, an added and a left out word: 95 % on average, and nothing of the surroundings."""
    rng = random.Random(31)

    def prose(n):
        return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    rows, size = [], {}
    for k, changes in enumerate([1] * 25 + [2] * 25):
        p = prose(60 if changes == 1 else 100)
        q = list(p)
        for c in range(changes):
            at = rng.randrange(len(q))
            q[at:at + (c + k) % 2] = prose((k // 2) % 2 + (c + k) % 2 if (k // 2) % 2 or (c + k) % 2 else 1)
        rows += [(2 * k, " ".join(prose(60) + p + prose(60))), (2 * k + 1, " ".join(prose(60) + q + prose(60)))]
        size[2 * k + 1] = len(q)
    got = {r.doc_id: [s.words for s in r.removed_spans] for r in paragraph_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = [sum(got[i]) / n for i, n in size.items()]
    assert not any(got[2 * k] for k in range(50)) and max(share) <= 1 and np.mean(share) > 0.95


def test_jaccard_links_lose_no_component():
    rng = random.Random(9)
    for _ in range(60):
        base = list(range(20))
        sets = [set(rng.sample(base, rng.randint(16, 20))) | {rng.randint(50, 53)} for _ in range(25)]
        want = components_of(list(range(25)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
        links = paragraph_dedup.jaccard_links(sets, 0.8)
        ends = {i: i for i in range(25)} | dict(links)
        assert len(set(ends.values())) == len(set(want.values())) and all(want[a] == want[b] for a, b in links)


def test_license_alignment_matches_brute_force():
    """With a band as wide as the texts, alignment is the longest common subsequence; edited templates are found whole."""
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(row[j] + 1 if x == y else 0, row[j + 1], new[-1]))
            row = new
        return row[-1]
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        n, first, last = license_scan.align(a, b, 0, 20)
        assert n == lcs(a, b) and (n == 0 or n <= last - first + 1)
    index = license_scan.Index(license_scan.TEMPLATES)
    for name in ("MIT-text", "BSD-2-Clause", "BSD-3-Clause", "ISC-text", "Zlib", "0BSD", "LGPL-3.0-header", "AGPL-3.0-header",
                 "Apache-2.0-header", "GPL-2.0-header", "EPL-2.0"):
        words = license_scan.TEMPLATES[name].split()
        for i in rng.sample(range(2, len(words) - 2), len(words) // 30):
            words[i] = rng.choice(["changed", "", words[i] + " more"])
        noise = " ".join(f"foreign{i}" for i in range(30))
        text = " ".join(words)
        (found, coverage, n, start, end), = license_scan.scan_text(f"{noise} {text} {noise}".encode(), index, 0.75, 6)
        fold = [w.encode() for w in re.findall("[a-z0-9]+", text.lower())]
        t = index.names.index(name)
        assert found == name and n == lcs(index.words[t], fold) and coverage == n / len(index.words[t])
        assert start >= len(noise) and end <= len(noise) + 2 + len(text) and end - start > 0.9 * len(text)


def test_license_scan_of_repeated_rows_and_many_notices(spark):
    notice = "Released under the MIT License."
    many = " ".join(f"é{i} {notice} filler text number {i}." for i in range(3000))
    rows = [(1, many), (2, notice), (2, notice)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.doc_id == 2 for r in got) == 2 and sum(r.doc_id == 1 for r in got) == 3000
    assert {many[r.start:r.end] for r in got if r.doc_id == 1} == {notice[:-1]}


def test_license_scan(spark, odd):
    mit = license_scan.TEMPLATES["MIT"]
    rows = [(1, "Intro.\n" + mit.replace("to deal in", "to trade in") + "\nEnd."), (2, "x\nLicensed  under CC BY-NC 4.0.\nö"),
            (3, "The license of this work is unclear."), (4, None), (5, "")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2} and got[1].license == "MIT" and 0.95 < got[1].coverage < 1
    assert rows[1][1][got[2].start:got[2].end] == "Licensed  under CC BY-NC 4.0" and got[2].coverage == 1.0
    assert license_scan.scan(odd).count() == 0


@pytest.mark.parametrize("run", [
    lambda d: simhash.near_dedup(d), lambda d: suffix_dedup.dedup(d), lambda d: lempel_ziv.fingerprints(d),
    lambda d: token_count.token_counts(d, [("a", -1.0), ("▁", -2.0)]), lambda d: paragraph_dedup.dedup(d)])
def test_a_row_for_each_row(odd, run):
    assert run(odd).count() == 14
    assert run(odd.limit(0)).count() == 0


def test_packing_of_odd_texts(odd):
    got = queries.packed(odd)
    assert got.where("piece = 0").count() == 14 and queries.packed(odd.limit(0)).count() == 0


def test_repeated_texts_lose_all(odd):
    got = {r.doc_id: len(r.kept) for r in suffix_dedup.dedup(odd).collect() if r.doc_id in (4, 6, 7)}
    assert got == {4: 3, 6: 0, 7: 2}


def test_pipeline(spark):
    import corpus_pipeline as P
    from samplesmith.llm.common import cut
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fp = {i: simhash_by_hand(t) for i, t in texts.items()}
    lead = components_of(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    step = {}
    for name, stage in P.STAGES:
        docs = step[name] = cut(stage(spark, docs, SF))
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in list(step.values())[:-1])
    assert {r.doc_id for r in step["language ID"].collect()} == {i for i, t in texts.items() if any(c.isalpha() for c in t)}
    assert {r.doc_id for r in step["SimHash near-dedup"].collect()} == {i for i, r in lead.items() if i == r}
    cut_texts = {r.doc_id: r.text for r in step["substring dedup"].collect()}
    assert all(len(t) <= len(texts[i]) for i, t in cut_texts.items()) and set(cut_texts) == {i for i, r in lead.items() if i == r}
    left = {r.doc_id for r in step["benchmark decontamination"].collect()}
    assert left <= set(cut_texts)
    assert {r.doc_id for r in docs.collect()} == left
    assert P.run(spark, SF).count() == docs.count()


def test_pipeline_stages_on_odd_rows_and_clashing_names(spark, odd):
    import corpus_pipeline as P
    from samplesmith.llm.common import cut
    docs = odd.withColumns({c: F.lit("mine") for c in ("lang_pred", "languages", "removed_spans", "component_id", "item_id", "a b")})
    for given in (docs, docs.limit(0)):
        at = given
        for name, stage in P.STAGES[:-1]:
            at = cut(stage(spark, at, SF))
            assert at.columns == docs.columns and at.dtypes == docs.dtypes, name
            assert {(r.score, r.lang_pred, r.removed_spans, r["a b"]) for r in at.collect()} <= {("s", "mine", "mine", "mine")}
        ids = [r.doc_id for r in at.collect()]
        # no letter: 1, 2, 3, 9 and one null id go; 4 repeats; 7 and the other null id are near copies or hold the passage of 6
        assert {4, 5, 8, 10, 11} <= set(ids) if given is docs else ids == []
        assert not {1, 2, 3, 9} & set(ids) and ids.count(4) <= 1
        P.STAGES[-1][1](spark, at, SF).collect()


def test_decontamination_sql_on_short_items_units_and_slots(spark):
    con = duckdb.connect()
    items = [(1, "If Anna buys 3 apples and 5 pears for 12 km of road then Anna has 3 apples left today"), (2, "Two words"), (3, None),
             (4, "..."), (5, "It weighs 4 kg 5 km 6 m and 7 miles or 8 milestones in all")]
    asked = "If {0} buys {1} apples and {2} pears for {3} km of road then {4} has {5} apples left today"
    rows = [(1, "xx. " + asked.format("Bob", 7, 9, 40, "Bob", 7) + " zz"), (2, asked.format("Bob", 7, 9, 40, "Carl", 8)),
            (3, "two words"), (4, None), (5, ""), (6, "Two words"), (7, "It weighs 9 kg 5 km 6 m and 7 miles or 8 milestones in all"),
            (8, asked.format("Anna", 3, 5, 12, "Anna", 3) + " It weighs 4 lb 5 oz 6 m and 7 mile or 8 milestones in all")]
    for name, kind, table in (("benchmark", "item_id bigint, text string", items), ("documents", "doc_id bigint, text string", rows)):
        con.execute(f"create table {name} ({kind.replace('string', 'varchar')})")
        con.executemany(f"insert into {name} values (?, ?)", table)
    want = con.execute(queries.ORACLE["op2_decontamination"]).fetchall()
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(d, b).drop("row").collect()
    assert sorted(map(tuple, got)) == sorted(want) and {(r.doc_id, r.item_id) for r in got} >= {(1, 1), (6, 2), (8, 1)}


def test_registered():
    assert {*queries.QUERIES, "pipeline"} <= set(E.queries())
