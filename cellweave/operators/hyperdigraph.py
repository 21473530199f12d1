"""Ordered hyperdigraphs: cells whose array is a sequence of distinct vertices, with births."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..errors import InputError
from ..storage import at_most

MAX_HYPEREDGES = 500_000
#: Cells that are sent to all tasks at most.
MOST_FORCED = 100_000


def orient(edges: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Each pair of edges(cloud_id, src, dst, birth) from its lower to its higher weight; equal weights keep both ways.

    Without weights(cloud_id, point_id, weight), edges are those of `points.pairs(weights=True)`: distinct pairs with w1 and w2.
    """
    both = edges
    if weights is not None:
        w = weights.select("cloud_id", F.col("point_id").alias("src"), F.col("weight").alias("w1"))
        both = edges.join(w, ["cloud_id", "src"]).join(w.select("cloud_id", F.col("src").alias("dst"), F.col("w1").alias("w2")), ["cloud_id", "dst"])
    turn = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    keep = F.struct("src", "dst")
    ways = F.when(F.col("w1") < F.col("w2"), F.array(keep)).when(F.col("w1") > F.col("w2"), F.array(turn)).otherwise(F.array(keep, turn))
    out = both.select("cloud_id", "birth", F.explode(ways).alias("e")).select("cloud_id", "e.src", "e.dst", "birth")
    return out if weights is None else out.groupBy("cloud_id", "src", "dst").agg(F.min("birth").alias("birth"))


def score_directed(points: DataFrame, edges: DataFrame) -> DataFrame:
    """edges of a support (complete or Delaunay), each from its lower to its higher score (the weight), in order of birth within a cloud; scores must differ.

    ordinal numbers a cloud's edges by birth, then ends.
    """
    tied = F.count("*").over(W.partitionBy("cloud_id", "weight")) > 1
    scored = points.select("cloud_id", "point_id", F.when(tied, F.raise_error(F.lit("two scores are equal")).cast("double")).otherwise(F.col("weight")).alias("weight"))
    order = W.partitionBy("cloud_id").orderBy("birth", "src", "dst")
    return orient(edges, scored).withColumn("ordinal", F.row_number().over(order) - 1)


def distance_matrix(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(cloud_id, row, distances array<double>): the directed matrix of edges, infinite where there is none and 0 on the diagonal; a row of the table for each point."""
    at = points.select("cloud_id", "point_id", "row")
    size = points.groupBy("cloud_id").agg(F.count("*").cast("int").alias("n"))
    to = edges.join(at.select("cloud_id", F.col("point_id").alias("dst"), F.col("row").alias("column")), ["cloud_id", "dst"])
    known = to.groupBy("cloud_id", F.col("src").alias("point_id")).agg(F.map_from_entries(F.collect_list(F.struct("column", "birth"))).alias("d"))
    entry = lambda j: F.when(j == F.col("row"), 0.0).otherwise(F.coalesce(F.try_element_at("d", j), F.lit(float("inf"))))
    return at.join(size, "cloud_id").join(known, ["cloud_id", "point_id"], "left").select("cloud_id", "row", F.transform(F.sequence(F.lit(0), F.col("n") - 1), entry).alias("distances"))


def consecutive(points: DataFrame) -> DataFrame:
    """Support pairs of clouds on a line: neighbours in order of the first coordinate, then of point_id."""
    from .points import distance

    w = W.partitionBy("cloud_id").orderBy("coords", "point_id")
    out = points.select("cloud_id", F.col("point_id").alias("src"), F.lead("point_id").over(w).alias("dst"), F.col("coords").alias("a"), F.lead("coords").over(w).alias("b")).where("dst is not null")
    return out.select("cloud_id", "src", "dst", distance().alias("birth"))


def path_complex(vertices: DataFrame, edges: DataFrame, max_dim: int, end: float | None = None, max_hyperedges: int | None = MAX_HYPEREDGES) -> DataFrame:
    """Vertices(cloud_id, v), directed edges and all paths of distinct vertices up to max_dim edges; a path is born with its longest edge.

    One equality join for each length; births after `end` are dropped before the next join.
    """
    e = edges if end is None else edges.where(F.col("birth") <= end)
    step = e.select("cloud_id", F.col("src").alias("s"), F.col("dst").alias("t"), F.col("birth").alias("b"))
    out = [vertices.select(F.col("cloud_id").alias("topology_id"), F.lit(0).alias("dim"), F.array("v").alias("cell"), F.lit(0.0).alias("birth"))]
    level = e.select("cloud_id", F.array("src", "dst").alias("cell"), "birth")
    for d in range(1, max_dim + 1):
        if d > 1:
            level = level.withColumn("s", F.element_at("cell", -1)).join(step, ["cloud_id", "s"]).where(~F.array_contains("cell", F.col("t")))
            level = level.select("cloud_id", F.concat("cell", F.array("t")).alias("cell"), F.greatest("birth", "b").alias("birth"))
            level = at_most(level, max_hyperedges, f"hyperedges of dimension {d}")
        out.append(level.select(F.col("cloud_id").alias("topology_id"), F.lit(d).alias("dim"), "cell", "birth"))
    return reduce(DataFrame.unionByName, out)


def masked(edges: DataFrame, minimum: DataFrame | None = None, maximum: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """Edges allowed by maximum(cloud_id, src, dst) and joined by those of minimum, which must be among the allowed.

    among: edges with all of the minimum's that are left, where few are known to have them; the edges are not exchanged then.
    """
    out = edges
    on = ["cloud_id", "src", "dst"]
    if minimum is not None and maximum is not None and minimum.join(maximum, on, "left_anti").limit(1).count():
        raise InputError("an edge of the minimum is not in the maximum")
    if maximum is not None:
        out = out.join(maximum.select(*on), on, "left_semi")
    if minimum is not None:
        out = out.unionByName(minimum.join(out if among is None else among, on, "left_anti").select(*on, F.lit(0.0).alias("birth")))
    return out


def bounded(cells: DataFrame, minimum: DataFrame | None = None, maximum: DataFrame | None = None, start: float = 0.0, among: DataFrame | None = None) -> DataFrame:
    """Hyperedges outside the maximum leave, vertices never; those of the minimum are there from start on.

    among: cells with all of the minimum's that are left, where few are known to have them. The cells are not
    exchanged then, and the minimum, of at most MOST_FORCED cells, is sent to all tasks.
    """
    on = ["topology_id", "cell"]
    out = cells
    if maximum is not None:
        inside = maximum.select(*on).distinct()
        out = out.where("dim = 0").unionByName(out.where("dim > 0").join(inside, on, "left_semi"))
    if minimum is not None:
        forced = minimum.select(*on).distinct().withColumn("forced", F.lit(True))
        if among is not None:
            forced = at_most(forced, MOST_FORCED, "cells of the minimum")
            new = forced.join(among, on, "left_anti").select("topology_id", (F.size("cell") - 1).alias("dim"), "cell", F.lit(float(start)).alias("birth"))
            known = out.join(F.broadcast(forced), on, "left")
            return known.select("topology_id", "dim", "cell", F.when(F.col("forced"), F.least("birth", F.lit(float(start)))).otherwise(F.col("birth")).alias("birth")).unionByName(new)
        out = out.join(forced, on, "full").select("topology_id", F.coalesce("dim", F.size("cell") - 1).alias("dim"), "cell", F.when(F.col("forced"), F.least("birth", F.lit(float(start)))).otherwise(F.col("birth")).alias("birth"))
    return out


def from_dimensions(rows: DataFrame) -> DataFrame:
    """cells from rows(topology_id, dim, hyperedges array<array>, births array): explicit cells by dimension."""
    out = rows.select("topology_id", "dim", F.explode(F.arrays_zip("hyperedges", "births")).alias("h")).select("topology_id", "dim", F.col("h.hyperedges").alias("cell"), F.col("h.births").cast("double").alias("birth"))
    bad = out.where((F.size("cell") != F.col("dim") + 1) | (F.size(F.array_distinct("cell")) != F.size("cell")) | F.col("birth").isNull())
    if bad.limit(1).count():
        raise InputError("a hyperedge has the wrong length, a repeated vertex or no birth")
    return out
