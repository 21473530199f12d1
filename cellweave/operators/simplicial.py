"""Filtered simplicial complexes: cells(topology_id, dim, cell, birth), cell a sorted array of vertices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..storage import at_most, settle, short_list
from . import blocks
from .points import GRID_DIMS, pairs

KEY = ["topology_id", "cell"]


def facets_of(cell: Column) -> Column:
    """array<struct<at, face>>: each face that leaves out one vertex; none of a single vertex."""
    face = lambda i: F.struct(i.alias("at"), F.filter(cell, lambda _, j: j != i).alias("face"))
    return F.when(F.size(cell) > 1, F.transform(F.sequence(F.lit(0), F.size(cell) - 1), face)).otherwise(F.array().cast("array<struct<at:int,face:array<bigint>>>"))


def facets(cells: DataFrame) -> DataFrame:
    """(topology_id, dim, cell, birth, at, face, sign) for every facet of every cell."""
    out = cells.where("dim > 0").select("topology_id", "dim", "cell", "birth", F.explode(F.transform(F.sequence(F.lit(0), F.size("cell") - 1), lambda i: F.struct(i.alias("at"), F.filter("cell", lambda _, j: j != i).alias("face")))).alias("f"))
    return out.select("topology_id", "dim", "cell", "birth", "f.at", "f.face", F.when(F.col("f.at") % 2 == 0, 1).otherwise(-1).alias("sign"))


def insert(cells: DataFrame, max_dim: int) -> DataFrame:
    """The closure of cells(topology_id, cell, birth) under faces: every face is born with its earliest coface."""
    level = cells.select("topology_id", F.array_sort("cell").alias("cell"), "birth").withColumn("dim", F.size("cell") - 1)
    out = []
    for d in range(max_dim, -1, -1):
        here = level.where(F.col("dim") == d).groupBy(*KEY).agg(F.min("birth").alias("birth")).withColumn("dim", F.lit(d))
        out.append(here.select("topology_id", "dim", "cell", "birth"))
        if d:
            faces = facets(here).select("topology_id", F.col("face").alias("cell"), "birth").withColumn("dim", F.lit(d - 1))
            level = level.where(F.col("dim") < d).unionByName(faces)
    return reduce(DataFrame.unionByName, out)


def vertices_of(points: DataFrame) -> DataFrame:
    return points.select(F.col("cloud_id").alias("topology_id"), F.lit(0).alias("dim"), F.array("point_id").alias("cell"), F.lit(0.0).alias("birth"))


def graph_complex(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices and edges(cloud_id, src, dst, birth); an edge is born with its latest end, a repeated one at its earliest."""
    # In a value that is aggregated, so that no filter can bring the error before the plan's own ones.
    loop = F.raise_error(F.lit("an edge joins a vertex to itself")).cast("double")
    checked = F.when(F.col("src") == F.col("dst"), loop).otherwise(F.col("birth"))
    births = vertices.select("topology_id", F.element_at("cell", 1).alias("v"), F.col("birth").alias("b"))
    once = edges.groupBy(F.col("cloud_id").alias("topology_id"), F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min(checked).alias("birth"))
    born = once.join(births.withColumnRenamed("v", "src").withColumnRenamed("b", "b1"), ["topology_id", "src"]).join(births.withColumnRenamed("v", "dst").withColumnRenamed("b", "b2"), ["topology_id", "dst"])
    return vertices.unionByName(born.select("topology_id", F.lit(1).alias("dim"), F.array("src", "dst").alias("cell"), F.greatest("birth", "b1", "b2").alias("birth")))


def flag_complex(graph: DataFrame, max_dim: int, max_cells: int | None = None) -> DataFrame:
    """All cliques of up to max_dim + 1 vertices; a clique is born with its last edge.

    A clique grows by the forward neighbours of its last vertex; each other vertex must be
    joined to the new one too, one equality join for each.
    """
    adj = graph.where("dim = 1").select("topology_id", F.element_at("cell", 1).alias("s"), F.element_at("cell", 2).alias("t"), F.col("birth").alias("b"))
    out, level = [graph], graph.where("dim = 1")
    for d in range(2, max_dim + 1):
        grown = level.select("topology_id", "cell", "birth", F.element_at("cell", -1).alias("s")).join(adj, ["topology_id", "s"]).select("topology_id", "cell", "t", F.greatest("birth", "b").alias("birth"))
        for k in range(d - 1):
            side = adj.select("topology_id", F.col("s").alias(f"v{k}"), "t", F.col("b").alias(f"b{k}"))
            grown = grown.withColumn(f"v{k}", F.element_at("cell", k + 1)).join(side, ["topology_id", f"v{k}", "t"]).withColumn("birth", F.greatest("birth", f"b{k}"))
        level = grown.select("topology_id", F.lit(d).alias("dim"), F.concat("cell", F.array("t")).alias("cell"), "birth")
        level = at_most(level, max_cells, f"cells of dimension {d}")
        out.append(level)
    return reduce(DataFrame.unionByName, out)


def rips_complex(points: DataFrame, max_dim: int = 2, cutoff: float | None = None, grid_dims: int = GRID_DIMS, max_cells: int | None = None) -> DataFrame:
    """The Rips complex of every cloud: cells born at their largest pairwise distance, up to the cutoff.

    Edges and triangles are sent by `blocks` as they are found; higher cells grow from edges that are written once.
    """
    graph = rips_graph(points, cutoff, grid_dims)
    if max_dim < 2:
        return graph
    if max_dim > 2:
        return flag_complex(settle(graph), max_dim, max_cells)
    return graph.unionByName(at_most(blocks.triangles(points, cutoff, grid_dims), max_cells, "cells of dimension 2"))


def rips_graph(points: DataFrame, cutoff: float | None = None, grid_dims: int = GRID_DIMS) -> DataFrame:
    """The points of every cloud and their pairs up to the cutoff, as cells; no exchange of pairs."""
    e = pairs(points, cutoff, grid_dims)
    birth = F.when(F.col("src") == F.col("dst"), F.raise_error(F.lit("an edge joins a vertex to itself")).cast("double")).otherwise(F.col("birth"))
    return vertices_of(points).unionByName(e.select(F.col("cloud_id").alias("topology_id"), F.lit(1).alias("dim"), F.array(F.least("src", "dst"), F.greatest("src", "dst")).alias("cell"), birth.alias("birth")))


def rips_counts(points: DataFrame, scales: list[float], max_dim: int = 2, grid_dims: int = GRID_DIMS) -> DataFrame:
    """(topology_id, scale, dim, n_cells) of the Rips complexes at each scale, counted and not listed; no row where there are no cells."""
    found = blocks.cell_counts(points, short_list(scales), max_dim, grid_dims)
    return found.select(F.col("cloud_id").alias("topology_id"), "scale", "dim", F.col("n").alias("n_cells"))


def from_distances(distances: DataFrame, max_dim: int = 2) -> DataFrame:
    """A Rips complex of distances(cloud_id, i, j, d), i < j; an infinite distance is no edge."""
    vertices = distances.select("cloud_id", F.col("i").alias("v")).union(distances.select("cloud_id", "j")).distinct()
    vertices = vertices.select(F.col("cloud_id").alias("topology_id"), F.lit(0).alias("dim"), F.array("v").alias("cell"), F.lit(0.0).alias("birth"))
    edges = distances.where(F.col("d") < F.lit(float("inf"))).select("cloud_id", F.col("i").alias("src"), F.col("j").alias("dst"), F.col("d").alias("birth"))
    return flag_complex(graph_complex(vertices, edges), max_dim)


def clamp(cells: DataFrame, start: float, end: float | None = None) -> DataFrame:
    """Births below start become start (raw_birth keeps them); cells born after end leave."""
    out = cells.withColumn("raw_birth", F.col("birth")).withColumn("birth", F.greatest(F.lit(float(start)), "birth"))
    return out if end is None else out.where(F.col("birth") <= end)


def snapshot(cells: DataFrame, scale: float) -> DataFrame:
    return cells.where(F.col("birth") <= scale)


def snapshots(cells: DataFrame, scales: list[float] | DataFrame) -> DataFrame:
    """cells alive at each scale; scales is a short list, and no join is needed."""
    every = F.array(*[F.lit(s) for s in sorted(short_list(scales))])
    return cells.withColumn("scale", F.explode(F.filter(every, lambda s: s >= F.col("birth"))))


def skeleton(cells: DataFrame, max_dim: int) -> DataFrame:
    return cells.where(F.col("dim") <= max_dim)


def cofaces(cells: DataFrame, codim: int = 1) -> DataFrame:
    """(topology_id, face, cell): cells of `codim` dimensions more that contain each face."""
    out = cells.where(F.col("dim") >= codim).select("topology_id", "cell", F.col("cell").alias("face"))
    for _ in range(codim):
        out = out.select("topology_id", "cell", F.explode(facets_of(F.col("face"))).alias("f")).select("topology_id", "cell", F.col("f.face").alias("face")).distinct()
    return out.select("topology_id", "face", "cell")


def violations(cells: DataFrame) -> DataFrame:
    """Facets that are missing or born after their coface: empty for a valid filtration."""
    known = cells.select("topology_id", F.col("cell").alias("face"), F.col("birth").alias("face_birth"))
    return facets(cells).join(known, ["topology_id", "face"], "left").where("face_birth is null or face_birth > birth").select("topology_id", "cell", "face", "birth", "face_birth")


def numbered(cells: DataFrame) -> DataFrame:
    """cells with cell_id: 0, 1, ... in order of birth and vertices within each topology and dimension."""
    return cells.withColumn("cell_id", F.row_number().over(W.partitionBy("topology_id", "dim").orderBy("birth", "cell")).cast("long") - 1)


def critical_scales(cells: DataFrame, start: float | None = None) -> DataFrame:
    """The distinct births of each topology, and its start if given."""
    out = cells.select("topology_id", F.col("birth").alias("scale"))
    if start is not None:
        out = out.where(F.col("scale") >= start).union(cells.select("topology_id", F.lit(float(start))))
    return out.distinct()


def f_vector(cells: DataFrame) -> DataFrame:
    return cells.groupBy("topology_id", "dim").agg(F.count("*").alias("n_cells"))


def euler(cells: DataFrame) -> DataFrame:
    return cells.groupBy("topology_id").agg(F.sum(F.when(F.col("dim") % 2 == 0, 1).otherwise(-1)).alias("euler"))
