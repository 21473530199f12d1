"""Connected components and the zeroth barcode."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..storage import settle as _cut
from . import blocks


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(cloud_id, v, root) for vertices(cloud_id, v) and edges(cloud_id, src, dst): root is the smallest vertex in reach.

    For graphs of any size: alternating large and small stars, in rounds of joins that halve
    depths, with a checkpoint a round.
    """
    e = _cut(edges.where("src <> dst").select("cloud_id", F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = None
    while True:
        both = e.union(e.select("cloud_id", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("cloud_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, ["cloud_id", "u"]).where("v > u").select("cloud_id", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("cloud_id", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["cloud_id", "u"]).select("cloud_id", F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("cloud_id", "e.u", "e.v").where("u <> v").distinct()
        e = _cut(small)
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("cloud_id", "u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == state:
            break
        state = now
    roots = e.select("cloud_id", F.col("u").alias("v"), F.col("v").alias("root"))
    return vertices.select("cloud_id", "v").join(roots, ["cloud_id", "v"], "left").withColumn("root", F.coalesce("root", "v"))


def of_points(points: DataFrame, cutoff: float) -> DataFrame:
    """`components` of the radius graph of every cloud, from links in place of all its pairs."""
    return components(points.select("cloud_id", F.col("point_id").alias("v")), blocks.links(points, cutoff))


def merge_tree(n: int, src: np.ndarray, dst: np.ndarray, birth: np.ndarray, born: np.ndarray) -> list[tuple[float, float]]:
    """Finite (birth, death) of components by the elder rule; edges are taken in order of birth."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in np.lexsort((dst, src, birth)):
        a, b = find(src[k]), find(dst[k])
        if a != b:
            young, old = (a, b) if (born[a], a) > (born[b], b) else (b, a)
            parent[young] = old
            out.append((float(born[young]), float(birth[k])))
    roots = {find(x) for x in range(n)}
    return out + [(float(born[r]), float("inf")) for r in sorted(roots)]


def h0_barcode(cells: DataFrame, include_zero: bool = False) -> DataFrame:
    """intervals(topology_id, dim, birth, death) of degree 0, a kernel for each topology over its vertices and edges."""
    rows = cells.where("dim <= 1").select("topology_id", "dim", F.element_at("cell", 1).alias("a"), F.element_at("cell", -1).alias("b"), "birth")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[pdf.dim == 0].sort_values("a")
        e = pdf[pdf.dim == 1]
        at = {x: i for i, x in enumerate(v.a)}
        bars = merge_tree(len(v), e.a.map(at).to_numpy(int), e.b.map(at).to_numpy(int), e.birth.to_numpy(float), v.birth.to_numpy(float))
        bars = [x for x in bars if include_zero or x[1] > x[0]]
        return pd.DataFrame({"topology_id": [pdf.topology_id.iloc[0]] * len(bars), "dim": 0, "birth": [x[0] for x in bars], "death": [x[1] for x in bars]})

    kind = dict(cells.dtypes)["topology_id"]
    return rows.groupBy("topology_id").applyInPandas(kernel, f"topology_id {kind}, dim int, birth double, death double")
