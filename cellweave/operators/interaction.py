"""Interaction complexes of two factors: pairs of cells that share a vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..errors import InputError
from .simplicial import facets


def postings(cells: DataFrame, max_dim: int) -> DataFrame:
    """The inverted index: (topology_id, v, cell, dim, birth)."""
    return cells.where(F.col("dim") <= max_dim).select("topology_id", F.explode("cell").alias("v"), "cell", "dim", "birth")


def interaction_complex(a: DataFrame, b: DataFrame, max_degree: int) -> DataFrame:
    """icells(topology_id, degree, cell_a, cell_b, birth): cells with a common vertex, degrees up to max_degree.

    An equality join on the vertices of both inverted indexes; pairs that share several
    vertices meet at each of them, and the meeting at the first one counts.
    """
    left = postings(a, max_degree).select("topology_id", "v", F.col("cell").alias("cell_a"), F.col("dim").alias("dim_a"), F.col("birth").alias("birth_a"))
    right = postings(b, max_degree).select("topology_id", "v", F.col("cell").alias("cell_b"), F.col("dim").alias("dim_b"), F.col("birth").alias("birth_b"))
    met = left.join(right, ["topology_id", "v"]).where(F.col("dim_a") + F.col("dim_b") <= max_degree)
    once = met.where(F.element_at(F.array_intersect("cell_a", "cell_b"), 1) == F.col("v"))
    return once.select("topology_id", (F.col("dim_a") + F.col("dim_b")).alias("degree"), "cell_a", "cell_b", F.greatest("birth_a", "birth_b").alias("birth"))


def witness_bound(a: DataFrame, b: DataFrame, max_degree: int) -> DataFrame:
    """(topology_id, bound): an upper bound of the number of cells, from counts alone."""
    one = postings(a, max_degree).groupBy("topology_id", "v").agg(F.count("*").alias("n"))
    two = postings(b, max_degree).groupBy("topology_id", "v").agg(F.count("*").alias("m"))
    return one.join(two, ["topology_id", "v"]).groupBy("topology_id").agg(F.sum(F.col("n") * F.col("m")).alias("bound"))


def boundary(icells: DataFrame) -> DataFrame:
    """(topology_id, degree, row_a, row_b, col_a, col_b, sign); faces that share no vertex are zero.

    The second factor's faces carry the sign (-1)**(dimension of the first).
    """
    cols = icells.select("topology_id", "degree", "cell_a", "cell_b")
    first = facets(cols.select("topology_id", (F.size("cell_a") - 1).alias("dim"), F.col("cell_a").alias("cell"), F.lit(0.0).alias("birth")).distinct()).select("topology_id", F.col("cell").alias("cell_a"), F.col("face").alias("row_a"), "sign")
    second = facets(cols.select("topology_id", (F.size("cell_b") - 1).alias("dim"), F.col("cell_b").alias("cell"), F.lit(0.0).alias("birth")).distinct()).select("topology_id", F.col("cell").alias("cell_b"), F.col("face").alias("row_b"), "sign")
    turn = F.when(F.size("cell_a") % 2 == 1, 1).otherwise(-1)
    parts = cols.join(first, ["topology_id", "cell_a"]).select("topology_id", "degree", "row_a", F.col("cell_b").alias("row_b"), F.col("cell_a").alias("col_a"), F.col("cell_b").alias("col_b"), "sign").union(
        cols.join(second, ["topology_id", "cell_b"]).select("topology_id", "degree", F.col("cell_a").alias("row_a"), "row_b", F.col("cell_a").alias("col_a"), F.col("cell_b").alias("col_b"), (F.col("sign") * turn).alias("sign"))
    )
    known = cols.select("topology_id", F.col("cell_a").alias("row_a"), F.col("cell_b").alias("row_b"))
    return parts.join(known, ["topology_id", "row_a", "row_b"], "left_semi").groupBy("topology_id", "degree", "row_a", "row_b", "col_a", "col_b").agg(F.sum("sign").alias("sign")).where("sign <> 0")


def degree_zero_spectrum(icells: DataFrame, scale: float) -> DataFrame:
    """(topology_id, v, eigenvalue): L_0 is diagonal, with the live cells of degree 1 at each shared vertex."""
    live = icells.where(F.col("birth") <= scale)
    zero = live.where("degree = 0").select("topology_id", F.element_at("cell_a", 1).alias("v"))
    # A cell of degree 1 is an edge and one of its ends: it is at that end alone.
    one = live.where("degree = 1").select("topology_id", F.element_at(F.array_intersect("cell_a", "cell_b"), 1).alias("v")).groupBy("topology_id", "v").agg(F.count("*").alias("n"))
    return zero.join(one, ["topology_id", "v"], "left").select("topology_id", "v", F.coalesce("n", F.lit(0)).cast("double").alias("eigenvalue"))


def check_overlap(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(topology_id, cell_a, cell_b), after a check that every paired cell is one of its factor; cells are not restricted."""
    for df, c in ((a, "cell_a"), (b, "cell_b")):
        if pairs.join(df.select("topology_id", F.col("cell").alias(c)), ["topology_id", c], "left_anti").limit(1).count():
            raise InputError("a paired cell is unknown")
    return pairs


def overlap(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cloud_id, factor, point_id, vertex): common vertex numbers of two clouds that pairs(cloud_id, a_id, b_id) identify one to one."""
    for c in ("a_id", "b_id"):
        if pairs.groupBy("cloud_id", c).count().where("count > 1").limit(1).count():
            raise InputError("an id is paired twice")
    for df, c in ((a, "a_id"), (b, "b_id")):
        if pairs.join(df.select("cloud_id", F.col("point_id").alias(c)), ["cloud_id", c], "left_anti").limit(1).count():
            raise InputError("a paired id is unknown")
    left = a.select("cloud_id", F.col("point_id").alias("a_id"), F.col("row").alias("ra"))
    right = b.select("cloud_id", F.col("point_id").alias("b_id"), F.col("row").alias("rb"))
    all_ = left.join(pairs.select("cloud_id", "a_id", "b_id"), ["cloud_id", "a_id"], "left").join(right, ["cloud_id", "b_id"], "full")
    named = all_.withColumn("vertex", F.row_number().over(W.partitionBy("cloud_id").orderBy(F.col("ra").asc_nulls_last(), "rb")).cast("long") - 1)
    return named.where("a_id is not null").select("cloud_id", F.lit(0).alias("factor"), F.col("a_id").alias("point_id"), "vertex").union(named.where("b_id is not null").select("cloud_id", F.lit(1), "b_id", "vertex"))


def regrade(cells: DataFrame, schedule: list[float], progression: list[float] | None = None) -> DataFrame:
    """Births become the progression's value of the first threshold at or above them; later cells leave."""
    progression = [float(k) for k in range(len(schedule))] if progression is None else progression
    if any(x > y for x, y in zip(schedule, schedule[1:])) or any(x >= y for x, y in zip(progression, progression[1:])) or len(schedule) != len(progression):
        raise InputError("a schedule must not fall, and a progression must rise and be as long")
    stage = F.lit(None).cast("double")
    for threshold, value in list(zip(schedule, progression))[::-1]:
        stage = F.when(F.col("birth") <= threshold, F.lit(float(value))).otherwise(stage)
    return cells.withColumn("raw_birth", F.col("birth")).withColumn("birth", stage).where("birth is not null")
