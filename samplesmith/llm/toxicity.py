"""Toxicity by a weighted finite-state grammar over clauses.

A sentence is a tape of word classes (insult, threat, target, negation, reported
speech, any other word) with a symbol for each clause break.  Small transducers
read it from the left and from the right and mark words: negation marks the words
it reaches, reported speech what is told, targets the words aimed at them.  The
machines of one direction are composed into one.  Insult and threat machines then
turn the marks into weights, and each clause adds up its own.

Insult arcs are induced from labelled documents: whole words and word beginnings
whose document frequency separates the classes.  The other arcs are closed word
lists.  The clause scores of a document feed a logistic curve fitted on the
training fold.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplesmith.llm.common import cut, held_out, id_and_bytes

WORD = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"[.!?\n\r|]+")
TOKEN = re.compile(r"[^\W\d_]+|[;:,()\[\]]+")  # words and clause breaks
STEMS = range(3, 12)  # lengths of word beginnings tried besides whole words

# Closed classes in the four languages of the corpus: word -> class.
THREATS = ("kill hurt destroy beat burn attack hang shoot stab murder punish crush strangle smash "
           "töten umbringen schlagen zerstören verbrennen erschießen tuer frapper détruire brûler "
           "matar golpear destruir quemar").split()
TARGETS = ("you your yours yourself he she him her they them their these those people "
           "du dich dir euch ihr sie er ihn tu toi te vous votre il elle ils elles lui "
           "tú ti usted ustedes vosotros él ella ellos ellas").split()
CLITICS = "dich dir euch ihn te vous lui".split()  # targets that can be the object of a verb behind them
NEGATIONS = ("not no never neither nor without cannot nicht kein keine nie niemals "
             "pas jamais aucun aucune nunca jamás ningún ninguna").split()
REPORTS = ("said says say told claimed claims reported quoted quote wrote writes according "
           "sagte sagt behauptet schrieb dit disait déclaré écrit dijo dice afirmó escribió").split()
CLASSES = {w: c for c, words in (("threat", THREATS), ("target", TARGETS), ("clitic", CLITICS), ("negation", NEGATIONS),
                               ("report", REPORTS))
           for w in words}
SYMBOLS = ("word", "insult", "threat", "target", "clitic", "negation", "report", "break")
DENIED, TOLD, AIMED, OBJECT = 1, 2, 4, 8
NEGATION_REACH = 4   # words after a negation that it denies
FINAL_REACH = 2      # words that a negation at the end of a clause denies
CLITIC_REACH = 2     # words within which an object pronoun before a threat is its object
SPEAKER = 2          # words that a clause may hold beside its word of speech to report the one before
FACTORS = {DENIED: 0.4, TOLD: 0.6, AIMED: 1.5}
THREAT_WEIGHT = 3.0
KNOWN_WORDS = 200_000  # words whose arcs a task remembers

Step = Callable[[Hashable, str], tuple[Hashable, int]]


@dataclass(frozen=True)
class Machine:
    """Sequential transducer: ``arcs[state, symbol]`` is the next state and the marks written on the symbol."""

    start: Hashable
    arcs: dict[tuple[Hashable, str], tuple[Hashable, int]]

    def marks(self, tape: list[str]) -> list[int]:
        state, out = self.start, []
        for symbol in tape:
            state, mark = self.arcs[state, symbol]
            out.append(mark)
        return out


def machine(start: Hashable, step: Step) -> Machine:
    """The machine of all states that ``step`` reaches from ``start``."""
    arcs, todo, known = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in SYMBOLS:
            arcs[state, symbol] = step(state, symbol)
            if arcs[state, symbol][0] not in known:
                known.add(arcs[state, symbol][0])
                todo.append(arcs[state, symbol][0])
    return Machine(start, arcs)


def compose(*parts: Machine) -> Machine:
    """One machine that reads the tape as all ``parts`` do and writes the marks of each."""
    def step(states: Hashable, symbol: str) -> tuple[Hashable, int]:
        moves = [p.arcs[s, symbol] for p, s in zip(parts, states)]
        mark = 0
        for _, m in moves:
            mark |= m
        return tuple(s for s, _ in moves), mark
    return machine(tuple(p.start for p in parts), step)


def _negation(left: int, symbol: str) -> tuple[int, int]:
    """From the left: a negation denies the next words of its clause; the state is how many are left."""
    if symbol in ("negation", "break"):
        return (NEGATION_REACH if symbol == "negation" else 0), 0
    return max(left - 1, 0), DENIED if left else 0


def _final_negation(state: int, symbol: str) -> tuple[int, int]:
    """From the right: a negation that ends a clause denies the words before it (-1: at the end, 0: out of reach)."""
    if symbol == "break":
        return -1, 0
    if state == -1:
        return (FINAL_REACH if symbol == "negation" else 0), 0
    return max(state - 1, 0), DENIED if state else 0


def _report(state: str, symbol: str) -> tuple[str, int]:
    """From the left: what follows a word of speech is told, also the next clause if none follows in its own."""
    if symbol == "report":
        return "bare", 0
    if symbol == "break":
        return ("told" if state == "bare" else "none"), 0
    if state == "bare" and symbol in ("target", "clitic"):
        return "bare", TOLD
    return ("none", 0) if state == "none" else ("told", TOLD)


def _final_report(state: Hashable, symbol: str) -> tuple[Hashable, int]:
    """From the right: a word of speech that ends a clause tells what is before it, and a clause of little else
    (``he said``; the state is how many other words it may still hold) the whole clause before."""
    if symbol == "break":
        return ("carried" if isinstance(state, int) else "end"), 0
    if state == "end":
        return (SPEAKER, 0) if symbol == "report" else ("end", 0) if symbol in ("target", "clitic") else ("in", 0)
    if state == "in":
        return "in", 0
    if isinstance(state, int):
        return (state - 1 if state and symbol not in ("insult", "threat") else "told"), TOLD
    return state, TOLD


def _target(state: bool, symbol: str) -> tuple[bool, int]:
    """From the left: words after a target are aimed at it; one that speaks is none."""
    if symbol in ("target", "clitic", "break", "report"):
        return symbol in ("target", "clitic"), 0
    return state, AIMED if state else 0


def _clitic(left: int, symbol: str) -> tuple[int, int]:
    """From the left: an object pronoun just before a word is its object (``je te frappe``)."""
    if symbol in ("clitic", "break", "report"):
        return (CLITIC_REACH if symbol == "clitic" else 0), 0
    return max(left - 1, 0), OBJECT if left else 0


def _following_target(state: str, symbol: str) -> tuple[str, int]:
    """From the right: words before a target are aimed at it, and it is their object; the one before a word of speech speaks."""
    if symbol == "break":
        return "none", 0
    if symbol == "report":
        return "speech", 0
    if symbol in ("target", "clitic"):
        return ("none" if state == "speech" else "aim"), 0
    return ("aim", AIMED | OBJECT) if state == "aim" else ("none", 0)


FROM_LEFT = compose(machine(0, _negation), machine("none", _report), machine(False, _target), machine(0, _clitic))
FROM_RIGHT = compose(machine(-1, _final_negation), machine("end", _final_report), machine("none", _following_target))
#: Output of the insult machine for each set of marks; the threat machine writes nothing without an object.
INSULT = [float(np.prod([f for m, f in FACTORS.items() if marks & m])) for marks in range(16)]
THREAT = [THREAT_WEIGHT * INSULT[marks | AIMED] if marks & OBJECT else 0.0 for marks in range(16)]


@dataclass
class Grammar:
    """Insult arcs (``word`` whole, ``stem`` as word beginning) and the fitted curve."""

    word: dict[str, float] = field(default_factory=dict)
    stem: dict[str, float] = field(default_factory=dict)
    curve: np.ndarray = field(default_factory=lambda: np.array([-2.0, 1.0, 0.0, 0.0]))
    known: dict[str, tuple[str, float]] = field(default_factory=dict, repr=False)

    def finder(self) -> ahocorasick.Automaton:
        """Automaton that tells whether a lower-cased text can hold an insult or threat at all."""
        a = ahocorasick.Automaton()
        for w in [*self.word, *self.stem, *THREATS]:
            a.add_word(w, w)
        a.make_automaton()
        return a

    def insult(self, word: str) -> float:
        best = self.word.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                best = max(best, self.stem.get(word[:n], 0.0))
        return best

    def arc(self, token: str) -> tuple[str, float]:
        """Symbol of a token on the tape, and its weight as an insult."""
        found = self.known.get(token)
        if found is None:
            weight = self.insult(token)
            found = ("break" if not token[0].isalpha() else CLASSES.get(token, "insult" if weight else "word")), weight
            if len(self.known) < KNOWN_WORDS:
                self.known[token] = found
        return found


def sentence_scores(tokens: list[str], grammar: Grammar) -> list[float]:
    """Weight of each clause of a sentence's tokens (lower-cased words and clause breaks)."""
    read = [grammar.arc(t) for t in tokens]
    if not any(w or s == "threat" for s, w in read):
        return [0.0] * (1 + sum(s == "break" for s, _ in read))
    tape = [s for s, _ in read]
    scores = [0.0]
    for (symbol, weight), left, right in zip(read, FROM_LEFT.marks(tape), reversed(FROM_RIGHT.marks(tape[::-1]))):
        if symbol == "break":
            scores.append(0.0)
            continue
        scores[-1] += weight * INSULT[left | right]
        if symbol == "threat":
            scores[-1] += THREAT[left | right]
    return scores


def clause_score(words: list[str], grammar: Grammar) -> float:
    """Weight of one clause's words; 0 without insult or threat."""
    return sum(sentence_scores(words, grammar))


def features(text: str, grammar: Grammar, finder: ahocorasick.Automaton) -> tuple[float, float, float]:
    """(log of summed, highest, share of) clause scores of a whole text."""
    low = text.lower()
    if not len(finder) or next(finder.iter(low), None) is None:
        return 0.0, 0.0, 0.0
    scores, clauses = [], 0
    for sentence in SENTENCE_END.split(low):
        tokens = TOKEN.findall(sentence)
        if tokens:
            found = sentence_scores(tokens, grammar)
            clauses += len(found)
            scores += [s for s in found if s]
    if not scores:
        return 0.0, 0.0, 0.0
    return float(np.log1p(sum(scores))), float(np.log1p(max(scores))), len(scores) / clauses


def _training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold, those whose id hashes lowest."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return id_and_bytes(docs).where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id")  # at most ``rows`` pairs of numbers


def learn(docs: DataFrame, labels: DataFrame, rows: int = 20_000, support: int = 5, ratio: float = 30.0) -> Grammar:
    """Induce the insult arcs and fit the curve on at most ``rows`` labelled documents.

    An arc needs ``support`` toxic documents, a document frequency among toxic
    ones ``ratio`` times that among the others, and a log-likelihood ratio beyond
    what the best of as many words would reach by chance.  A stem has to hold
    more toxic documents than the commonest learned word under it; of stems that
    begin with another, the shortest stays.  Without labels of both kinds the default
    curve stays, on threats alone.
    """
    train = cut(_training_rows(docs, labels, rows))
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    grammar = Grammar()
    if len(sizes) < 2:
        return grammar

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out_t, out_k = [], []
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                words = set(WORD.findall(text.decode("utf-8", "replace").lower()))
                found = words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
                out_t += found
                out_k += [toxic] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(out_t, pa.string()), pa.array(out_k, pa.int32())], ["term", "toxic"])

    smooth = 0.5
    yes, no, all_ = F.col("yes"), F.col("no"), F.col("yes") + F.col("no")
    chance = sizes[1] / (sizes[0] + sizes[1])
    found = cut(train.mapInArrow(terms, "term string, toxic int").groupBy("term")
                .agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no")).where(all_ >= support)
                .withColumn("lift", (yes + smooth) / sizes[1] / ((no + smooth) / sizes[0]))
                .withColumn("gain", yes * F.log(yes / all_ / chance)
                            + F.when(no > 0, no * F.log(no / all_ / (1 - chance))).otherwise(0.0)))
    words = found.where(~F.col("term").endswith("*")).count()
    arcs = (found.where((yes >= support) & (F.col("lift") >= ratio) & (F.col("gain") >= float(np.log(max(words, 1)))))
            .collect())  # bounded: terms of ``rows`` documents
    alone: dict[str, int] = {}  # toxic documents of the commonest learned word under a beginning
    for r in arcs:
        if not r["term"].endswith("*"):
            grammar.word[r["term"]] = float(np.log(r["lift"]))
            for n in STEMS:
                alone[r["term"][:n]] = max(alone.get(r["term"][:n], 0), r["yes"])
    for r in sorted(arcs, key=lambda r: r["term"]):
        stem = r["term"][:-1]
        if (r["term"].endswith("*") and r["yes"] > alone.get(stem, 0)
                and not any(stem[:n] in grammar.stem for n in STEMS if n < len(stem))):
            grammar.stem[stem] = float(np.log(r["lift"]))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = grammar.finder()
        for b in batches:
            f = [features(t.decode("utf-8", "replace"), grammar, finder) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in f], pa.float64()) for i in range(3)), b.column("toxic")],
                                             ["total", "highest", "share", "toxic"])

    rated = train.mapInArrow(rate, "total double, highest double, share double, toxic int").toArrow()  # at most ``rows``
    x = np.column_stack([np.ones(rated.num_rows), *(rated[c].to_numpy() for c in ("total", "highest", "share"))])
    grammar.curve = fit(x, rated["toxic"].to_numpy())
    return grammar


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    pull = ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``(doc_id, score, clause_total, clause_highest)`` per row: probability that label 1 fits.

    Null and empty texts have no clause and get the curve's base value.
    Repeated rows come back repeated; an empty table gives no rows; other
    columns are never read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = grammar.finder()
        for b in batches:
            f = np.array([features((t or b"").decode("utf-8", "replace"), grammar, finder)
                          for t in b.column("text").to_pylist()]).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(grammar.curve[0] + f @ grammar.curve[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(f[:, 0]), pa.array(f[:, 1])],
                                             ["doc_id", "score", "clause_total", "clause_highest"])
    return id_and_bytes(docs).mapInArrow(run, "doc_id long, score double, clause_total double, clause_highest double")
