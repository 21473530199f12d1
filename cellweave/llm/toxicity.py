"""Toxicity: a learned lexicon, Levenshtein automata over its trie, and context windows.

The lexicon is learned from labelled rows: words, and word beginnings of four to six letters,
that occur in far more toxic than other documents. A lazily determinised automaton, the
intersection of the Levenshtein automata with the lexicon's trie, reads each distinct word
of a text and says which term it is, spelled right or with an edit (two in long terms).
Around each hit a window of characters decides whether the term is quoted or reported or
used; the counts of both, and of misspelled hits, go into a logistic score.

Cases: a null or empty text scores as one without hits; repeated rows give a row each and, if
labelled, count once in the lexicon; of conflicting labels of a doc_id the largest counts;
without labelled rows the lexicon is empty and every score is 0.5 or less; an empty table
gives an empty result; other columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import buffers, grams, lower_ascii, run_hashes, slices, words
from .quality import labelled

#: At most so many labelled rows are used to fit, those of the smallest hashes of doc_id.
SAMPLE_ROWS = 10000
WORD = re.compile(r"[^\W_]+(?:[@$*!][^\W_]+)*")
#: Characters before and after a hit that its context takes in.
WINDOW = 40
REPORT = re.compile(r"\b(said|says|called|quote[sd]?|wrote|word|term|phrase|insult|slur|dit|dijo|sagte|mot|palabra|wort)\b", re.I)
OPEN, CLOSE = "\"'“‘«„‹`", "\"'”’»“›`"
#: Starting weights of the score: used terms, misspelled terms, quoted terms, intercept.
PRIOR = np.array([4.0, 2.5, 0.3, -4.0])


class Lexicon:
    """Terms with strengths; a term that ends in * stands for all words that begin so."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.trie: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        for term in sorted(terms):
            at = 0
            for c in term.rstrip("*"):
                at = self.trie[at].setdefault(c, len(self.trie))
                if at == len(self.trie):
                    self.trie.append({})
            self.ends[at] = term
        self.reach = [0] * len(self.trie)
        for term in terms:
            at, k = 0, self.edits(term)
            self.reach[0] = max(self.reach[0], k)
            for c in term.rstrip("*"):
                at = self.trie[at][c]
                self.reach[at] = max(self.reach[at], k)
        self.start = self._closed({(0, 0)})
        self.moves: dict[frozenset, dict[str, frozenset]] = {}
        self.memo: dict[str, tuple[str, int] | None] = {}

    def __getstate__(self):
        return {"terms": self.terms}

    def __setstate__(self, state):
        self.__init__(state["terms"])

    @staticmethod
    def edits(term: str) -> int:
        """Edits allowed: none in short terms and in word beginnings, two from nine letters."""
        return 0 if term.endswith("*") or len(term) < 5 else 1 if len(term) < 9 else 2

    def _closed(self, states: set) -> frozenset:
        """Add what leaving out letters of a term reaches; of each node keep the fewest edits."""
        best: dict[int, int] = {}
        stack = list(states)
        while stack:
            node, k = stack.pop()
            if k > self.reach[node] or best.get(node, 9) <= k:
                continue
            best[node] = k
            stack += [(to, k + 1) for to in self.trie[node].values()]
        return frozenset(best.items())

    def _step(self, states: frozenset, c: str) -> frozenset:
        out = set()
        for node, k in states:
            for d, to in self.trie[node].items():
                out.add((to, k + (d != c)))
            out.add((node, k + 1))
        return self._closed(out)

    def find(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the best match of a lower-case word, or None."""
        if word in self.memo:
            return self.memo[word]
        states, found = self.start, None
        for i, c in enumerate(word):
            moves = self.moves.setdefault(states, {})
            if c not in moves:
                moves[c] = self._step(states, c)
            states = moves[c]
            if not states:
                break
            begun = [self.ends[n] for n, k in states if not k and n in self.ends and self.ends[n].endswith("*")]
            if begun and i + 1 < len(word):
                found = (begun[0], 0)
        if states:
            ended = sorted((k, self.ends[n]) for n, k in states if n in self.ends and k <= self.edits(self.ends[n]))
            if ended and (not found or not ended[0][0]):
                found = (ended[0][1], ended[0][0])
        if len(self.memo) > 500_000:
            self.memo.clear()
        self.memo[word] = found
        return found


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around text[start:end] quotes or reports it rather than uses it."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    if before and after and any(c in before for c in OPEN) and any(c in after for c in CLOSE):
        opens, closes = max(before.rfind(c) for c in OPEN), min(after.find(c) for c in CLOSE if c in after)
        # an apostrophe inside a word is no quotation mark
        if (opens == 0 or not before[opens - 1].isalnum()) and (closes + 1 >= len(after) or not after[closes + 1].isalnum()):
            return True
    return bool(REPORT.search(before[-WINDOW // 2 :])) and bool(before) and before.rstrip()[-1:] in {":", *OPEN}


def evidence(text: str, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logarithmic weights of used, misspelled and quoted terms."""
    low = text.lower()
    names = Counter(WORD.findall(low))
    found = {w: f for w in names if (f := lexicon.find(w))}
    if not found:
        return 0.0, 0.0, 0.0
    used, bent, cited = 0.0, 0.0, 0.0
    for m in WORD.finditer(low):
        if hit := found.get(m.group()):
            strength = lexicon.terms[hit[0]]
            if quoted(text if len(text) == len(low) else low, m.start(), m.end()):
                cited += strength
            elif hit[1]:
                bent += strength
            else:
                used += strength
    return math.log1p(used), math.log1p(bent), math.log1p(cited)


def learn_lexicon(sample: DataFrame, least_docs: int = 5, least_share: float = 0.012, least_odds: float = 20.0, most: int = 2000) -> Lexicon:
    """From sample(doc_id, text, label), near copies counted once."""

    def counted(batches):
        for batch in batches:
            for part in slices(batch):
                data, at = buffers(part.column(1))
                data = lower_ascii(data)
                starts, ends, first = words(data, at)
                g, i = grams(run_hashes(data, starts, ends), first, 3)
                owner = np.searchsorted(first, i, "right") - 1
                low = np.full(part.num_rows, 2**63 - 1, np.int64)
                np.minimum.at(low, owner, (g >> np.uint64(1)).astype(np.int64))
                raw = data.tobytes()
                for t in np.flatnonzero(np.diff(first) < 3).tolist():
                    own = b" ".join(raw[starts[k] : ends[k]] for k in range(first[t], first[t + 1]))
                    low[t] = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "big") >> 1
                table = defaultdict(set)
                for text, key, label in zip(part.column(1).to_pylist(), low.tolist(), part.column(2).to_pylist()):
                    table[label, key].add("")  # stands for the text itself
                    for w in set(WORD.findall((text or "").lower())):
                        table[label, key].add(w)
                        table[label, key].update(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)
                rows = [(t, key, label) for (label, key), terms in table.items() for t in terms]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], ["term", "key", "label"])

    seen = sample.select("doc_id", "text", "label").mapInArrow(counted, "term string, key long, label int").distinct()
    sizes = {r.label: r.n for r in seen.where("term = ''").groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    by = seen.where("term != ''").groupBy("term").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    odds = F.col("a") / pos / ((F.col("b") + 0.5) / neg)
    rows = by.where((F.col("a") >= max(least_docs, math.ceil(least_share * pos))) & (odds >= least_odds)).select("term", "a", odds.alias("odds")).orderBy(F.desc("a"), "term").limit(most).collect()
    stems = [r for r in rows if r.term.endswith("*")]
    # A beginning says no more than the longer one, or the word, that makes up nearly all of it.
    vague = {r.term for r in stems if any(x.term != r.term and x.term.startswith(r.term[:-1]) and x.a >= 0.9 * r.a for x in rows)}
    terms: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r.term.rstrip("*")), r.term)):
        name = r.term.rstrip("*")
        if r.term not in vague and not any(name[:k] + "*" in terms for k in range(4, len(name) + (not r.term.endswith("*")))):
            terms[r.term] = min(3.0, max(0.5, math.log10(r.odds)))
    return Lexicon(terms)


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, pull: float = 1.0, steps: int = 60) -> np.ndarray:
    """Newton's method; weights are drawn to the prior with the strength `pull`."""
    x, w = np.column_stack([x, np.ones(len(x))]), prior.copy()
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + pull * (w - prior)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _evidence_of(batches, lexicon: Lexicon):
    for batch in batches:
        for part in slices(batch):
            yield part, np.array([evidence(t or "", lexicon) for t in part.column(1).to_pylist()]).reshape(-1, 3)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep: Column | None = None, most: int = SAMPLE_ROWS) -> tuple[Lexicon, np.ndarray]:
    """Learn the lexicon and the weights of the score from labels(doc_id, label) that pass keep."""
    sample = labelled(docs, labels, label, F.lit(True) if keep is None else keep, most)
    lexicon = learn_lexicon(sample)

    def made(batches):
        for part, e in _evidence_of(batches, lexicon):
            yield pa.record_batch([part.column(2).cast(pa.int32()), *[pa.array(e[:, k]) for k in range(3)]], ["label", "a", "b", "c"])

    rows = sample.select("doc_id", "text", "label").mapInArrow(made, "label int, a double, b double, c double").collect()
    x = np.array([(r.a, r.b, r.c) for r in rows]).reshape(-1, 3)
    weights = logistic(x, np.array([r.label for r in rows], float))
    return lexicon, np.append(np.maximum(weights[:3], 0), weights[3])


def score(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, weights))  # at most 2,000 terms

    def scored(batches):
        own, w = shared.value
        for part, e in _evidence_of(batches, own):
            yield pa.record_batch([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(e @ w[:3] + w[3], -35, 35))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")
