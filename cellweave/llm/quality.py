"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader.

Every word gives its own hash and the hash of its shape (runs of letters of one kind and of
digits collapse, other characters stay); features are words, shapes, pairs of words and pairs
and triples of shapes, hashed to 2**BITS coordinates and weighted by their share of the text.
Training runs over a bounded sample of labelled rows; scores are sparse dot products over
whole texts, in NumPy on Arrow batches.

Cases: a null or empty text, or one of white space only, has no features and gets the score
of the intercept; repeated rows give a row each and, if labelled, train as often; of conflicting
labels of a doc_id the largest counts; labels that are null or rows without a document are ignored; without any labelled row every score is 0.5; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import buffers, grams, mix, run_hashes, slices, words

BITS = 18
#: At most so many labelled rows are used to fit, those of the smallest hashes of doc_id.
SAMPLE_ROWS = 8000
SCALE = 20.0

_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = 97
_KIND[128:] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48
_RUN = np.zeros(256, bool)
_RUN[[97, 65, 48]] = True


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the decimal digits of doc_id, modulo parts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coordinates, text of each, words of each text)."""
    starts, ends, first = words(data, at)
    count = np.diff(first)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), count
    kind = _KIND[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | ~_RUN[kind[1:]]
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    word, shape = run_hashes(data, starts, ends), run_hashes(kind[keep], place[starts], place[ends])
    text = np.repeat(np.arange(len(count)), count)
    found, owner = [], []
    for salt, (h, i) in enumerate([(word, None), (shape, None), grams(word, first, 2), grams(shape, first, 2), grams(shape, first, 3)]):
        found.append(mix(h + np.uint64(salt + 1)) >> np.uint64(64 - BITS))
        owner.append(text if i is None else text[i])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner), count


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        index, owner, count = features(data, at)
        total = np.bincount(owner, self.weights[index], len(count)) * (SCALE / np.maximum(count, 1))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.01, epochs: int = 4) -> Model:
    """Per-coordinate FTRL-proximal over rows of (coordinates, values, label)."""
    if not rows:
        return Model(np.zeros(1 << bits), 0.0)
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weight(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(1)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            index, value, label = rows[k]
            index, value = np.append(index, bias), np.append(value, 1.0)
            w = weight(index)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            z[index] += g - (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha * w
            n[index] += g * g
    w = weight(np.arange(len(z)))
    return Model(w[:bias], float(w[bias]))


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int) -> DataFrame:
    """(doc_id, text, label) of the documents of at most `most` labelled doc_ids for which keep holds."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `most` rows of two numbers


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None, most: int = SAMPLE_ROWS) -> Model:
    """Fit on labels(doc_id, label) that pass keep; features are made on executors."""

    def counted(batches):
        for batch in batches:
            for part in slices(batch):
                index, owner, count = features(*buffers(part.column(1)))
                key, times = np.unique(owner << BITS | index, return_counts=True)
                cut = np.searchsorted(key >> BITS, np.arange(len(count) + 1))
                value = (times * (SCALE / np.maximum(count, 1))[key >> BITS]).astype(np.float32)
                index = (key & ((1 << BITS) - 1)).astype(np.int32)
                pairs = list(zip(cut[:-1], cut[1:]))
                yield pa.record_batch([part.column(0), pa.array([index[a:b].tobytes() for a, b in pairs], pa.binary()), pa.array([value[a:b].tobytes() for a, b in pairs], pa.binary()), part.column(2).cast(pa.int32())], ["doc_id", "i", "v", "label"])

    sample = labelled(docs, labels, label, F.lit(True) if keep is None else keep, most).mapInArrow(counted, "doc_id long, i binary, v binary, label int")
    rows = sorted(sample.collect(), key=lambda r: (r.doc_id, r.i))
    return ftrl([(np.frombuffer(r.i, np.int32), np.frombuffer(r.v, np.float32), r.label) for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column ``score``; the text is read whole."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # 2**BITS numbers

    def scored(batches):
        own = Model(*shared.value)
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([part.column(0), pa.array(own.scores(*buffers(part.column(1))), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs whose text scores `least` or more, with all their columns; the text must be a string column named text."""
    names = docs.columns
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def kept(batches):
        own = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(own.scores(*buffers(part.column(at))) >= least))

    return docs.mapInArrow(kept, docs.schema)
