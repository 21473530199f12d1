"""Point clouds: points(cloud_id, point_id, row, coords, weight), many clouds in one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..errors import InputError
from . import blocks
from .blocks import GRID_DIMS

NUMBERS = "array<double>"


def points(df: DataFrame, cloud: Column, point: Column, coords: Column, weight: Column | None = None) -> DataFrame:
    """A points table. row numbers the points of a cloud in order of point_id."""
    out = df.select(cloud.alias("cloud_id"), point.alias("point_id"), coords.cast(NUMBERS).alias("coords"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"))
    return out.withColumn("row", F.row_number().over(W.partitionBy("cloud_id").orderBy("point_id")) - 1).select("cloud_id", "point_id", "row", "coords", "weight")


def check(points: DataFrame) -> DataFrame:
    """points, after a check that coordinates are finite and of one length in a cloud, and ids unique and weights finite."""
    finite = F.forall("coords", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    bad = points.groupBy("cloud_id").agg(
        F.bool_or(~F.coalesce(finite, F.lit(False))).alias("a"), (F.min(F.size("coords")) != F.max(F.size("coords"))).alias("b"),
        (F.count("*") != F.count_distinct("point_id")).alias("c"), F.bool_or(F.isnan("weight") | F.col("weight").isNull() | (F.abs("weight") == float("inf"))).alias("d"),
    ).where("a or b or c or d").first()
    if bad:
        raise InputError(f"cloud {bad.cloud_id}: " + "; ".join(t for t, x in zip(("coordinates are not finite", "lengths of coordinates differ", "ids recur", "weights are not finite"), bad[1:]) if x))
    return points


def subset(points: DataFrame, ids: DataFrame) -> DataFrame:
    """The points named by ids(cloud_id, point_id, ordinal), numbered by ordinal."""
    chosen = points.drop("row").join(ids.select("cloud_id", "point_id", "ordinal"), ["cloud_id", "point_id"])
    return chosen.withColumn("row", F.row_number().over(W.partitionBy("cloud_id").orderBy("ordinal")) - 1).select("cloud_id", "point_id", "row", "coords", "weight")


def unique_coordinates(points: DataFrame) -> DataFrame:
    """points with the column ``kept_id``: the id of the first point of the cloud at the same place. -0.0 equals 0.0."""
    same = F.transform("coords", lambda x: x + 0.0)
    return points.withColumn("kept_id", F.first("point_id").over(W.partitionBy("cloud_id", same).orderBy("row")))


def distance(a: str = "a", b: str = "b") -> Column:
    """Euclidean distance of two coordinate arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cell_of(coords: str, width: float, dims: int = GRID_DIMS) -> Column:
    """The cell of a grid over the first `dims` coordinates, or as many as there are."""
    return F.transform(F.slice(coords, 1, dims), lambda x: F.floor(x / width))


def around(cell: Column) -> Column:
    """A cell and its neighbours: 3 cells on a line, 9 in the plane, 27 in space."""
    step = lambda found, x: F.flatten(F.transform(found, lambda c: F.array(*[F.concat(c, F.array(x + o)) for o in (-1, 0, 1)])))
    return F.aggregate(cell, F.array(F.array().cast("array<bigint>")), step)


def pairs(points: DataFrame, cutoff: float | None = None, dims: int = GRID_DIMS, weights: bool = False) -> DataFrame:
    """edges(cloud_id, src, dst, birth): pairs of a cloud, src in the earlier row, with their distance.

    With a cutoff, points meet only in neighbouring cells of a grid of that width over the
    first `dims` coordinates, block by block (`blocks`), however large the cloud; pairs at the
    cutoff's distance are included. Without one, all pairs of a cloud are asked for.
    weights: the ends' weights as w1 and w2.
    """
    return blocks.edges(points, cutoff, dims, weights)


def nearest(points: DataFrame, others: DataFrame, cutoff: float | None = None, dims: int = GRID_DIMS) -> DataFrame:
    """points with ``nearest``: the distance to the nearest of others in the same cloud.

    With a cutoff, distances beyond it are null and only points in neighbouring cells of a grid of
    that width meet. Without one, all of a cloud's blocks meet those of its others, and only those whose boxes
    are near enough are compared.
    """
    return points.join(blocks.nearest(points, others, cutoff, dims), ["cloud_id", "point_id"], "left")


def bonds_from_adjacency(entries: DataFrame, directed: bool = False) -> DataFrame:
    """edges(cloud_id, src, dst) from entries(cloud_id, i, j, v): 0 or 1, zero diagonal, symmetric unless directed."""
    if entries.where("v not in (0, 1) or v is null or (i = j and v <> 0)").limit(1).count():
        raise InputError("an adjacency entry is not 0 or 1, or the diagonal is not zero")
    ones = entries.where("v = 1")
    if not directed:
        mirror = ones.select("cloud_id", F.col("j").alias("i"), F.col("i").alias("j"))
        # Sums of hashes first: both halves agree in 120 bits and in number. Where they don't, entries may recur, and the rows decide.
        if not _halves_agree(ones) and ones.join(mirror, ["cloud_id", "i", "j"], "left_anti").limit(1).count():
            raise InputError("the adjacency is not symmetric")
        ones = ones.where("i < j")
    return ones.select("cloud_id", F.col("i").alias("src"), F.col("j").alias("dst"))


def _halves_agree(ones: DataFrame) -> bool:
    """Whether every cloud has the same entries above and below the diagonal, by sums of their hashes."""
    ends = (F.least("i", "j"), F.greatest("i", "j"))
    upper = F.when(F.col("i") < F.col("j"), 1).otherwise(-1)
    h = [F.xxhash64(F.lit(k), "cloud_id", *ends) for k in (0, 1)]
    bits = [F.shiftrightunsigned(x, n).bitwiseAND(F.lit((1 << 30) - 1)) for x in h for n in (0, 32)]
    sums = [F.try_sum(x * upper) for x in (F.lit(1).cast("long"), *bits)]
    differ = ~F.coalesce(F.forall(F.array(*sums), lambda x: x == 0), F.lit(False))
    return not ones.groupBy("cloud_id").agg(differ.alias("differ")).where("differ").limit(1).count()


def undirected(edges: DataFrame) -> DataFrame:
    """Each undirected pair once, with its earliest birth; loops are refused by leaving them to `graph_complex`."""
    return edges.groupBy("cloud_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("birth").alias("birth"))
