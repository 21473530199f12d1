"""Benchmark decontamination: counts of rare words, then Smith-Waterman alignment.

Words are runs of letters, digits and bytes above ASCII, all letters lower-cased. The score of
a document and an item is that of their best local alignment divided by the item's with
itself, so edited and paraphrased copies score by how much of the item they keep.

No pair is left out before alignment that could reach the least score. An alignment of score s
matches s / 2 words of the item or more, and spans a bounded number of the text's words. Of
the item's rarest words, so many are watched that any such alignment matches `quorum` of them
at least; a document is aligned around each place where a span holds that many. How rare a
word is, by its count over all documents, decides the work and never the result.

Items are taken in portions of bounded size; each portion's words are small enough to be
sent to all executors, and the documents are read again for each further portion.

Cases: null and empty texts and items hit nothing; an item of fewer than SEED_WORDS words hits
the texts that consist of it, and no alignment that scores less than SEED_WORDS words in a row is
a hit of any other; rows without an item_id are no items; rows without a doc_id are searched like
all, and `drop_leaks` judges each row by its own text; repeated rows give a row each; empty tables
give an empty result; other columns are ignored (and preserved by `drop_leaks`). Whole texts are
read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import SIGNS, buffers, ranges, run_hashes, slices, words

SEED_WORDS = 3
#: Least share of an item's own score.
LEAST_SCORE = 0.5
#: One in so many of the words that an alignment matches at least is asked of the watched ones.
QUORUM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of benchmark text in a portion at most.
PORTION_WORDS = 500_000
#: Watched words by item that are held at a time; a single text may have more.
HELD = 2_000_000
#: Words of texts that are aligned with an item at a time; a single span may have more.
CELLS = 1 << 17


def coded(column) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text)."""
    try:
        column = pc.utf8_lower(column)
    except pa.ArrowInvalid:  # bytes that are not UTF-8
        column = pc.utf8_lower(pa.array([None if v is None else v.decode("utf-8", "replace") for v in column.cast(pa.binary()).to_pylist()], pa.string()))
    data, at = buffers(column)
    starts, ends, first = words(data, at, SIGNS)
    return run_hashes(data, starts, ends), first


class Seeds:
    """Sorted hashes with a table of their leading bits for quick refusal."""

    BITS = 22

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[self.hashes >> np.uint64(64 - self.BITS)] = True

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in g, index of the seed there)."""
        at = np.flatnonzero(self.table[g >> np.uint64(64 - self.BITS)])
        k = np.searchsorted(self.hashes, g[at])
        ok = (k < len(self.hashes)) & (self.hashes[np.minimum(k, len(self.hashes) - 1)] == g[at]) if len(self.hashes) else np.zeros(len(at), bool)
        return at[ok], k[ok]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(score, end in text) of the best local alignment of two sequences of word hashes."""
    n = len(text)
    step = -GAP * np.arange(n + 1)
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for w in item:
        diagonal = row[:-1] + np.where(text == w, MATCH, MISMATCH)
        row = np.maximum(row + GAP, 0)
        row[1:] = np.maximum(row[1:], diagonal)
        row = np.maximum.accumulate(row + step) - step  # gaps in the item
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def align_many(item: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The score of the best local alignment of an item with each row of texts."""
    step = -GAP * np.arange(texts.shape[1] + 1, dtype=np.int32)
    row, best = np.zeros((len(texts), texts.shape[1] + 1), np.int32), np.zeros(len(texts), np.int32)
    for w in item:
        diagonal = row[:, :-1] + np.where(texts == w, np.int32(MATCH), np.int32(MISMATCH))
        row = np.maximum(row + np.int32(GAP), 0)
        np.maximum(row[:, 1:], diagonal, out=row[:, 1:])
        row += step
        np.maximum.accumulate(row, axis=1, out=row)
        row -= step
        np.maximum(best, row.max(1), out=best)
    return best


def scores(code: np.ndarray, item: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: float) -> np.ndarray:
    """The best score of an item in each span of code, or 0 where it is below least. Codes from 0; item's are less than the largest one that code has.

    An alignment gains MATCH at most for a word that the item has and loses 1 for another, so the
    best run of such gains bounds its score; spans that the bound refuses aren't aligned.
    """
    out, known = np.zeros(len(begins), np.int64), np.zeros(max(int(item.max()), int(code.max())) + 2, bool)
    known[item] = True
    other = len(known) - 1
    order = np.argsort(ends - begins, kind="stable")
    done = 0
    while done < len(order):
        rows = order[done : done + max(1, CELLS // max(1, int((ends - begins)[order[done]])))]
        width = int((ends - begins)[rows].max())
        if width * len(rows) > 2 * CELLS:
            rows = rows[: max(1, CELLS // width)]
            width = int((ends - begins)[rows].max())
        done += len(rows)
        at = begins[rows, None] + np.arange(width)
        texts = np.where(at < ends[rows, None], code[np.minimum(at, len(code) - 1)], other)
        run = np.cumsum(np.where(known[texts], MATCH, -1), axis=1, dtype=np.int32)
        low = np.minimum(np.minimum.accumulate(run, axis=1), 0)
        low = np.concatenate([np.zeros((len(rows), 1), np.int32), low[:, :-1]], axis=1)
        ok = np.flatnonzero((run - low).max(1, initial=0) >= least)
        if len(ok):
            found = align_many(item, texts[ok])
            out[rows[ok]] = np.where(found >= least, found, 0)
    return out


def _portions(benchmark: DataFrame):
    """Items as (item_id, word hashes), in portions of at most PORTION_WORDS words."""
    portion, n = [], 0
    for r in benchmark.select("item_id", "text").where("item_id is not null").orderBy("item_id", "text").toLocalIterator():
        hashes = coded(pa.array([r.text or ""], pa.string()))[0]
        if len(hashes):
            if portion and n + len(hashes) > PORTION_WORDS:
                yield portion
                portion, n = [], 0
            portion.append((r.item_id, hashes))
            n += len(hashes)
    if portion:
        yield portion


def _counts(docs: DataFrame, seeds) -> dict[int, int]:
    """How often each seed occurs in all documents, by its index."""

    def counted(batches):
        own = seeds.value
        for batch in batches:
            n = np.zeros(len(own.hashes), np.int64)
            for part in slices(batch, 0):
                n += np.bincount(own.find(coded(part.column(0))[0])[1], minlength=len(n))
            hit = np.flatnonzero(n)
            yield pa.record_batch([pa.array(hit, pa.int64()), pa.array(n[hit], pa.int64())], ["seed", "n"])

    return {r.seed: r.n for r in docs.select("text").mapInArrow(counted, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()}


class Watch:
    """The watched words of the items of a portion, and what an alignment of the least score has of them."""

    def __init__(self, sequences: list[np.ndarray], counts: list[np.ndarray], least: float):
        #: Items of fewer than SEED_WORDS words, by their words; nothing is watched for them.
        self.short: dict[tuple, list[int]] = {}
        for k, s in enumerate(sequences):
            if len(s) < SEED_WORDS:
                self.short.setdefault(tuple(s.tolist()), []).append(k)
        n = np.array([len(s) for s in sequences])
        self.score = np.maximum(least * MATCH * n, MATCH * SEED_WORDS)
        #: Words that such an alignment matches at least, and words of the text from its first to its last at most.
        matched = np.array([math.ceil(s / MATCH) for s in self.score])
        self.span = (n + MATCH * n - self.score).astype(np.int64)
        self.quorum = np.maximum(1, matched // QUORUM)
        watched = [np.unique(s[np.argsort(c, kind="stable")[: max(0, len(s) - m + q) if len(s) >= SEED_WORDS else 0]]) for s, c, m, q in zip(sequences, counts, matched.tolist(), self.quorum.tolist())]
        hashes, items = np.concatenate(watched), np.repeat(np.arange(len(n)), [len(w) for w in watched])
        order = np.argsort(hashes, kind="stable")
        self.seeds, self.items = Seeds(np.concatenate(sequences)), items[order].astype(np.uint16 if len(n) <= 1 << 16 else np.int64)
        self.codes = [np.searchsorted(self.seeds.hashes, s).astype(np.int32) for s in sequences]
        self.at = np.searchsorted(hashes[order], self.seeds.hashes, "left")
        self.often = np.diff(np.append(self.at, len(hashes)))

    def places(self, word: np.ndarray, k: np.ndarray, first: np.ndarray):
        """Yield (texts, items, words) where a span that starts at a word holds a quorum, by item and ascending; k has the seed of each word."""
        watched = np.flatnonzero(self.often[k])
        word, k = word[watched], k[watched]
        text, often = np.searchsorted(first, word, "right") - 1, self.often[k]
        total, cut, ends = np.cumsum(often), 0, np.flatnonzero(np.append(text[1:] != text[:-1], True)) + 1 if len(text) else []
        while cut < len(word):
            held = np.searchsorted(total, (total[cut - 1] if cut else 0) + HELD, "right")
            e = np.searchsorted(ends, held, "right") - 1
            end = int(ends[e]) if e >= 0 and ends[e] > cut else int(ends[np.searchsorted(ends, cut, "right")])
            item = self.items[ranges(self.at[k[cut:end]], often[cut:end])]
            order = np.argsort(item, kind="stable")
            item, row = item[order], np.repeat(np.arange(cut, end), often[cut:end])[order]
            last = np.arange(len(item)) + self.quorum[item] - 1
            at = np.flatnonzero(last < len(item))
            last = last[at]
            ok = (item[last] == item[at]) & (text[row[last]] == text[row[at]]) & (word[row[last]] - word[row[at]] < self.span[item[at]])
            at = at[ok]
            yield text[row[at]].tolist(), item[at].tolist(), word[row[at]].tolist()
            cut = end


def _watches(docs: DataFrame, benchmark: DataFrame, least: float):
    """Yield a broadcast of (Watch, item_ids) for each portion of the benchmark."""
    sc = docs.sparkSession.sparkContext
    for portion in _portions(benchmark):
        sequences = [hashes for _, hashes in portion]
        every = sc.broadcast(Seeds(np.concatenate(sequences)))  # at most PORTION_WORDS numbers
        often, index = _counts(docs, every), every.value
        counts = [np.array([often.get(k, 0) for k in np.searchsorted(index.hashes, s).tolist()]) for s in sequences]
        yield sc.broadcast((Watch(sequences, counts, least), [item for item, _ in portion]))


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score for every document and item that align with `least` or more of the item's own score."""
    found = None
    for shared in _watches(docs, benchmark, least):
        part = docs.select("doc_id", "text").mapInArrow(_aligned(shared), "doc_id long, item_id long, score double")
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double")
    return found


def _hits(column, watch: Watch) -> list[tuple[int, int, float]]:
    """(row, item's index, score) of all that a portion's items hit in a column of texts."""
    hashes, first = coded(column)
    word, k = watch.seeds.find(hashes)
    code = np.full(len(hashes), len(watch.seeds.hashes), np.int32)
    code[word] = k
    out = []
    for t in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SEED_WORDS)).tolist() if watch.short else ():
        out += [(t, item, 1.0) for item in watch.short.get(tuple(hashes[first[t] : first[t + 1]].tolist()), ())]
    for found in watch.places(word, k, first):
        spans: dict[int, list[list[int]]] = {}
        now, own = None, []
        for text, item, at in zip(*found):
            span = int(watch.span[item])
            if now == (text, item) and at - span <= own[2]:
                own[2] = at + span
                continue
            now, own = (text, item), [text, at - span, at + span]
            spans.setdefault(item, []).append(own)
        for item, own in spans.items():
            text, begins, ends = np.array(own).T
            best = scores(code, watch.codes[item], np.maximum(first[text], begins), np.minimum(first[text + 1], ends), watch.score[item])
            top: dict[int, int] = {}
            for x in np.flatnonzero(best).tolist():
                top[int(text[x])] = max(top.get(int(text[x]), 0), int(best[x]))
            out += [(x, item, score / (MATCH * len(watch.codes[item]))) for x, score in top.items()]
    return sorted(out)


def _aligned(shared):
    def aligned(batches):
        watch, ids = shared.value
        for batch in batches:
            for part in slices(batch):
                out = _hits(part.column(1), watch)
                docs = part.column(0).take(pa.array([x[0] for x in out], pa.int64()))
                yield pa.record_batch([docs, pa.array([ids[x[1]] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], ["doc_id", "item_id", "score"])

    return aligned


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose texts align with no item, with all their columns."""
    at, schema, left = docs.columns.index("text"), docs.schema, docs

    def kept(shared):
        def clean(batches):
            watch, _ = shared.value
            for batch in batches:
                for part in slices(batch, at):
                    ok = np.ones(part.num_rows, bool)
                    ok[[x[0] for x in _hits(part.column(at), watch)]] = False
                    yield part.filter(pa.array(ok))

        return clean

    for shared in _watches(docs, benchmark, least):
        left = left.mapInArrow(kept(shared), schema)
    return left
