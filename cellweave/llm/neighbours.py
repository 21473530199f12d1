"""Approximate nearest neighbours by a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample of unit vectors; every vector is dealt to a leaf. A
query walks the tree with a priority queue of the branches it has passed by, nearest centre
first, and so ranks the leaves. How many leaves it visits is widened until the recall that a
bounded set of queries has against all vectors reaches the target. Leaves meet their queries
in groups of bounded size: a leaf with many rows, such as one of equal vectors, is dealt to
several groups, and its queries go to each of them.

A query goes on down its queue until the leaves it visits hold more than k rows. The tree has at
most SAMPLE_ROWS / 16 leaves; on more than LEAF_ROWS rows for each of them leaves grow with the
table, and a visit reads a fixed share of it.

Cosine is computed in double precision on the original vectors. Ties go to the smaller id.

Cases: vectors that are null, zero, or hold null or non-finite components, and such as have
another length than most, take no part; so do rows without an id. Rows that repeat an id are
candidates each, but never of a query with that id; as queries, each of their different vectors
is answered with ranks of its own. With fewer candidates than k all are
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import settle

#: Vectors that the tree is fitted on, and queries that calibrate it, at most.
SAMPLE_ROWS, CALIBRATION_QUERIES = 20_000, 200
BRANCHES, LEAF_ROWS, MOST_LEAVES = 8, 500, 2048
TARGET_RECALL = 0.98
#: Rows of a leaf that one group takes, about.
GROUP_ROWS = 16_000


def matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as doubles, their row numbers) of the usable vectors that have the length of most."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.array(pc.fill_null(pc.list_value_length(column), -1))
    known = sizes[sizes > 0]
    if not len(known):
        return np.zeros((0, 0)), np.zeros(0, int)
    names, times = np.unique(known, return_counts=True)
    d = int(names[times.argmax()])
    keep = np.flatnonzero(sizes == d)
    x = np.array(pc.fill_null(column.take(pa.array(keep)).flatten().cast(pa.float64()), float("nan"))).reshape(-1, d)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return x[ok], keep[ok]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(1, keepdims=True)) if len(x) else x


def cosines(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of one vector with each row of x; equal rows get equal values."""
    return np.clip((unit(x) * unit(query[None])).sum(1), -1, 1)


class Tree:
    def __init__(self, x: np.ndarray, leaves: int, branches: int = BRANCHES, seed: int = 3):
        self.centres: list[np.ndarray | None] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self.random = np.random.default_rng(seed)
        self._grow(x, leaves, branches)

    def _grow(self, x: np.ndarray, leaves: int, branches: int) -> int:
        node = len(self.children)
        self.centres.append(None)
        self.children.append([])
        self.leaf.append(-1)
        k = min(branches, leaves, len(x))
        label = self._means(x, k) if k > 1 else None
        if label is None or len(np.unique(label)) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return node
        centres, kids = [], []
        for c in np.unique(label):
            own = x[label == c]
            centres.append(unit(own.mean(0)[None] + 1e-12)[0])
            kids.append(self._grow(own, max(1, round(leaves * len(own) / len(x))), branches))
        self.centres[node], self.children[node] = np.array(centres), kids
        return node

    def _means(self, x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
        centres = x[self.random.choice(len(x), k, replace=False)]
        label = None
        for _ in range(rounds):
            now = (x @ centres.T).argmax(1)
            if label is not None and (now == label).all():
                break
            label = now
            sums = np.zeros((k, x.shape[1]))
            np.add.at(sums, label, x)
            full = np.bincount(label, minlength=k) > 0
            centres = np.where(full[:, None], unit(sums + 1e-12), centres)
        return label

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        out, stack = np.zeros(len(x), int), [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                way = (x[rows] @ self.centres[node].T).argmax(1)
                stack += [(child, rows[way == c]) for c, child in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray, most: int, rows: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first `most` leaves for a unit vector, best bin first, and more until they hold `least` rows."""
        out, heap, held = [], [(0.0, 0)], 0
        while heap and (len(out) < most or held < least):
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                held += rows.get(self.leaf[node], 0) if rows else 0
            else:
                for far, child in zip(-(self.centres[node] @ q), self.children[node]):
                    heapq.heappush(heap, (float(far), child))
        return out


def nearest(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query's index, row's id, cosine) of the k best rows of x for each query, rows of its own id excepted."""
    out = []
    if not len(x) or not len(q):
        return out
    rough = unit(q) @ unit(x).T
    for i in range(len(q)):
        row = np.where(ids == own[i], -np.inf, rough[i])
        least = np.partition(row, -k)[-k] if len(row) >= k else -np.inf
        near = np.flatnonzero((row >= least - 1e-9) & np.isfinite(row))
        exact = cosines(q[i], x[near])
        for j in np.lexsort((ids[near], -exact))[:k]:
            out.append((i, int(ids[near[j]]), float(exact[j])))
    return out


def _vectors(batch) -> tuple[np.ndarray, np.ndarray]:
    x, rows = matrix(batch.column(1))
    ids = batch.column(0).take(pa.array(rows, pa.int64())).to_pylist()
    ok = [i is not None for i in ids]
    return x[ok], np.array([i for i in ids if i is not None], np.int64)


def search(rows: DataFrame, is_query: Column, k: int = 5, target: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row(vec_id, embedding) for which is_query holds."""
    spark = rows.sparkSession
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    usable = rows.where("vec_id is not null and size(embedding) > 0")
    common = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    rows = usable.where(F.size("embedding") == common.d)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow()
    x, _ = matrix(sample.column(1))
    tree = Tree(unit(x), max(1, min(MOST_LEAVES, len(x) // 16, common["count"] // LEAF_ROWS)))
    shared = spark.sparkContext.broadcast(tree)  # at most SAMPLE_ROWS / 16 centres
    visits = _calibrate(rows, is_query, tree, shared, k, target)

    def dealt(batches):
        for batch in batches:
            x, ids = _vectors(batch)
            yield pa.record_batch([pa.array(ids), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(shared.value.assign(unit(x)), pa.int32())], ["vec_id", "embedding", "leaf"])

    placed = settle(rows.mapInArrow(dealt, "vec_id long, embedding array<double>, leaf int"))
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("parts"))
    held = {r.leaf: r.n for r in sizes.collect()}  # a number for each leaf
    spread = spark.sparkContext.broadcast(held)
    placed = placed.join(F.broadcast(sizes), "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("parts")).cast("int"))  # a row for each leaf
    own = rows.where(is_query).groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1  # rows that share a query's id

    def sent(batches):
        for batch in batches:
            x, ids = _vectors(batch)
            out = ([], [], [], [], [])
            for v, i, u, raw in zip(x.tolist(), ids.tolist(), unit(x), x):
                name = hashlib.sha256(raw.tobytes()).hexdigest()
                for leaf in shared.value.visits(u, visits, spread.value, k + own):
                    for part in range(-(-spread.value.get(leaf, 0) // GROUP_ROWS)):
                        for column, value in zip(out, (i, v, leaf, part, name)):
                            column.append(value)
            types = (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], ["vec_id", "embedding", "leaf", "part", "vector"])

    queries = rows.where(is_query).distinct().mapInArrow(sent, "vec_id long, embedding array<double>, leaf int, part int, vector string")

    def met(own: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and asked.num_rows:
            x, ids = matrix(own.column("embedding"))[0], np.array(own.column("vec_id"))
            q, names, vectors = matrix(asked.column("embedding"))[0], np.array(asked.column("vec_id")), asked.column("vector").to_pylist()
            for a in range(0, len(q), 500):
                found += [(int(names[a + i]), vectors[a + i], j, s) for i, j, s in nearest(q[a : a + 500], names[a : a + 500], x, ids, k)]
        types = {"query_id": pa.int64(), "vector": pa.string(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({c: pa.array([f[n] for f in found], t) for n, (c, t) in enumerate(types.items())})

    met_in = queries.select("vec_id", "embedding", "vector", "leaf", "part").groupBy("leaf", "part")
    found = placed.select("vec_id", "embedding", "leaf", "part").groupBy("leaf", "part").cogroup(met_in).applyInArrow(met, "query_id long, vector string, vec_id long, score double")
    order = W.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrate(rows: DataFrame, is_query: Column, tree: Tree, shared, k: int, target: float) -> int:
    """The fewest leaves that give the target's recall on a bounded set of queries, found by brute force over all rows."""
    asked = rows.where(is_query).orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(CALIBRATION_QUERIES).toArrow()
    q, at = matrix(asked.column(1))
    names = np.array(asked.column(0).take(pa.array(at, pa.int64())), np.int64)
    if not len(q):
        return 1
    known = rows.sparkSession.sparkContext.broadcast((q, names))

    def best(batches):
        for batch in batches:
            x, ids = _vectors(batch)
            leaf = shared.value.assign(unit(x))
            found = nearest(*known.value, x, ids, k)
            where = {int(i): int(f) for i, f in zip(ids, leaf)}
            yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array([where[f[1]] for f in found], pa.int32())], ["query", "vec_id", "score", "leaf"])

    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    truth = rows.mapInArrow(best, "query long, vec_id long, score double, leaf int").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).collect()
    rank = [{leaf: j for j, leaf in enumerate(tree.visits(u, tree.leaves))} for u in unit(q)]
    need = sorted(rank[t["query"]][t.leaf] + 1 for t in truth)
    return need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)] if need else 1
