"""Count-only Viterbi for unigram vocabularies.

An Aho-Corasick automaton enumerates the vocabulary matches of a piece of text;
a dynamic programme over its characters carries the best score and the number of
tokens on that path.  No token strings are built.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from samplesmith.llm.common import id_and_bytes

SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # an unknown character scores the lowest piece less this
CACHE = 400_000  # parts of text whose result a task remembers; forgetting them costs time only
SHORT = 40  # longer words that fall into parts are not remembered as a whole
NONE = float("-inf")

Part = tuple[float, int, int]  # score, tokens, unknown characters


class Counter:
    """Tokens of a text under a unigram vocabulary of (piece, score).

    Ties: a path replaces another that ends at the same character only if its
    score is strictly greater, and paths come in order of where their last piece
    starts, so the longest last piece wins.  A character that no single-character
    piece covers may be unknown; it counts as its UTF-8 bytes if all byte pieces
    exist, else a run of unknowns is one token.

    No piece holds a space mark after another character, so the best path breaks
    before each word, and around characters that no piece holds; the parts are
    solved once each.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        pieces = [(p, s) for p, s in vocabulary if p]
        self.bytes = all(f"<0x{i:02X}>" in {p for p, _ in pieces} for i in range(256))
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            if not self.automaton.exists(p):  # the first of repeated pieces counts
                self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.split = not any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        self.pairs = {p[i:i + 2] for p, _ in pieces for i in range(len(p) - 1)}
        self.singles = {p for p, _ in pieces if len(p) == 1}
        known = "".join(sorted({c for p, _ in pieces for c in p}))
        self.outside = re.compile(f"[^{re.escape(known)}]+") if known else re.compile(r"[\s\S]+")
        self.known: dict[str, Part] = {}

    def _unknowns(self, text: str) -> Part:
        return self.unknown * len(text), len(text.encode()) if self.bytes else 0, 0 if self.bytes else 1

    def _path(self, text: str) -> Part:
        """Best path of a text whose characters all occur in the vocabulary."""
        if self.singles.issuperset(text):
            return self._plain_path(text)
        n = len(text)
        score, count, back = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)  # back: 1 if the last token is unknown
        at, best, tokens, single = 0, NONE, 0, False

        def close(end: int, best: float, tokens: int, single: bool) -> None:
            """Settle the path to ``end``, whose matches have all been seen."""
            if not single and score[end - 1] + self.unknown > best:
                best, back[end] = score[end - 1] + self.unknown, 1
                tokens = count[end - 1] + (len(text[end - 1].encode()) if self.bytes else 1 - back[end - 1])
            score[end], count[end] = best, tokens

        for last, (length, gain) in self.automaton.iter(text):  # by end, the longest match of an end first
            last += 1
            while at < last:  # the ends before have no more matches
                if at:
                    if single:
                        score[at], count[at] = best, tokens
                    else:
                        close(at, best, tokens, False)
                at, best, tokens, single = at + 1, NONE, 0, False
            to = score[last - length] + gain
            if to > best:
                best, tokens = to, count[last - length] + 1
            if length == 1:
                single = True
        while at < n + 1:
            if at:
                close(at, best, tokens, single)
            at, best, tokens, single = at + 1, NONE, 0, False
        return score[n], count[n], 0

    def _plain_path(self, text: str) -> Part:
        """The same where each character is a piece: that match comes last and settles its end."""
        score, count, best, tokens = [0.0], [0], NONE, 0
        for end, (length, gain) in self.automaton.iter(text):
            start = end + 1 - length
            to = score[start] + gain
            if to > best:
                best, tokens = to, count[start] + 1
            if length == 1:
                score.append(best)
                count.append(tokens)
                best = NONE
        return score[-1], count[-1], 0

    def _part(self, text: str) -> Part:
        """Best path of a word, whose parts between neighbours that no piece joins are solved one by one."""
        found = self.known.get(text)
        if found is None:
            edges = [0, *(i for i in range(1, len(text)) if text[i - 1:i + 1] not in self.pairs), len(text)]
            if len(edges) == 2:
                return self._remember(text, self._solve(text))
            total, tokens = 0.0, 0
            for start, end in zip(edges, edges[1:]):
                part = text[start:end]
                s, n, _ = self.known.get(part) or self._remember(part, self._solve(part))
                total, tokens = total + s, tokens + n
            found = total, tokens, 0
            if len(text) <= SHORT:
                self._remember(text, found)
        return found

    def _remember(self, text: str, part: Part) -> Part:
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[text] = part
        return part

    def _solve(self, text: str) -> Part:
        if not self.bytes:
            return self._path(text)
        total, tokens, at = 0.0, 0, 0
        for gap in self.outside.finditer(text):
            if gap.start() > at:
                s, n, _ = self._path(text[at:gap.start()])
                total, tokens = total + s, tokens + n
            s, n, _ = self._unknowns(gap.group())
            total, tokens, at = total + s, tokens + n, gap.end()
        if at < len(text):
            s, n, _ = self._path(text[at:])
            total, tokens = total + s, tokens + n
        return total, tokens, 0

    def __call__(self, text: str) -> tuple[int, float]:
        """(tokens, score of the best path); an empty text has none."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", SPACE)
        marked = marked if marked[0] == SPACE else SPACE + marked
        if not self.split or not self.bytes:
            s, n, _ = self._solve(marked)
            return n, s
        total, tokens, part = 0.0, 0, self._part
        for stretch in self.outside.split(marked):
            for word in words(stretch):
                s, n, _ = part(word)
                total, tokens = total + s, tokens + n
        for gap in self.outside.finditer(marked):
            s, n, _ = self._unknowns(gap.group())
            total, tokens = total + s, tokens + n
        return tokens, total


def words(marked: str) -> list[str]:
    """The text cut before each run of space marks."""
    parts = marked.split(SPACE)
    if "" not in parts[1:]:
        return [p for p in parts[:1] if p] + [SPACE + p for p in parts[1:]]
    return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", marked)


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a published vocabulary file, without control pieces."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
            if not model.is_control(i) and not model.is_unknown(i)]


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """``(doc_id, n_tokens, score)`` per row: tokens of the whole text, and the best path's score.

    Spaces are marks, and one leads a text that does not start with one.  A null or empty text has no
    tokens and score 0.  Repeated rows come back repeated; an empty table gives
    no rows; other columns are never read.  The vocabulary is sent to the tasks;
    its size does not depend on the corpus.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocabulary)
        for b in batches:
            got = [count((t or b"").decode("utf-8", "replace")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in got], pa.int64()),
                                              pa.array([s for _, s in got], pa.float64())], ["doc_id", "n_tokens", "score"])
    return id_and_bytes(docs).mapInArrow(run, "doc_id long, n_tokens long, score double")
