"""Features of intervals(topology_id, dim, birth, death): histograms, bin counts, Betti curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import InputError
from ..storage import short_list

INF = float("inf")


def betti_at(intervals: DataFrame, scales: list[float] | DataFrame) -> DataFrame:
    """(topology_id, dim, scale, betti): bars with birth <= scale < death at each of a short list of scales, zero included; one aggregate."""
    every = short_list(scales)
    live = [F.count_if((F.col("birth") <= s) & (F.col("death") > s)) for s in every]
    counts = intervals.groupBy("topology_id", "dim").agg(F.array(*[F.struct(F.lit(s).alias("scale"), n.alias("betti")) for s, n in zip(every, live)]).alias("b"))
    return counts.select("topology_id", "dim", F.explode("b").alias("b")).select("topology_id", "dim", "b.scale", "b.betti")


def persistent_betti(intervals: DataFrame, s: float, t: float) -> DataFrame:
    """Bars alive from s to t."""
    return intervals.groupBy("topology_id", "dim").agg(F.count_if((F.col("birth") <= s) & (F.col("death") > t)).alias("betti"))


def edges_of(low: float, high: float, step: float) -> list[float]:
    """low, low + step, ... with high as the last; the last bin may be shorter."""
    if not step > 0 or not high > low:
        raise InputError("bins need a positive step and a rising range")
    out, k = [], 0
    while low + k * step < high:
        out.append(low + k * step)
        k += 1
    return [*out, high]


def check_edges(edges: list[float]) -> list[float]:
    if len(edges) < 2 or any(not a < b for a, b in zip(edges, edges[1:])) or any(abs(e) == INF for e in edges):
        raise InputError("bin edges must be finite and rise")
    return [float(e) for e in edges]


def bin_of(x: Column, edges: list[float]) -> Column:
    """The bin of x, the last one closed on the right; null outside."""
    e = F.array(*[F.lit(v) for v in edges])
    at = F.size(F.filter(e, lambda v: v <= x)) - 1
    return F.when(x == edges[-1], len(edges) - 2).when((at >= 0) & (at <= len(edges) - 2), at)


def histogram(intervals: DataFrame, birth_edges: list[float], death_edges: list[float], dims: list[int], min_persistence: float = 0.0, normalize: bool = False) -> DataFrame:
    """features(topology_id, ordinal, value): for each degree the grid of finite bars, the births of essential ones, and both overflows.

    Values are dense: each topology has all ordinals.
    """
    birth_edges, death_edges = check_edges(birth_edges), check_edges(death_edges)
    nb, nd = len(birth_edges) - 1, len(death_edges) - 1
    size = nb * nd + nb + 2
    kept = intervals.where(F.col("dim").isin(dims) & (F.col("death") - F.col("birth") >= min_persistence))
    b, d, infinite = bin_of(F.col("birth"), birth_edges), bin_of(F.col("death"), death_edges), F.col("death") == INF
    place = F.when(infinite, F.when(b.isNull(), nb * nd + nb + 1).otherwise(nb * nd + b)).otherwise(F.when(b.isNull() | d.isNull(), nb * nd + nb).otherwise(b * nd + d))
    degree = F.coalesce(*[F.when(F.col("dim") == x, F.lit(k)) for k, x in enumerate(dims)])
    counts = kept.groupBy("topology_id", (degree * size + place).alias("ordinal"), "dim").agg(F.count("*").cast("double").alias("n"))
    if normalize:
        sums = kept.groupBy("topology_id", "dim").agg(F.count("*").alias("all"))
        counts = counts.join(sums, ["topology_id", "dim"]).withColumn("n", F.col("n") / F.col("all"))
    frame = intervals.select("topology_id").distinct().select("topology_id", F.explode(F.sequence(F.lit(0), F.lit(size * len(dims) - 1))).alias("ordinal"))
    return frame.join(counts, ["topology_id", "ordinal"], "left").select("topology_id", "ordinal", F.coalesce("n", F.lit(0.0)).alias("value"))


def bin_counts(intervals: DataFrame, edges: list[float], dims: list[int], mode: str = "overlap") -> DataFrame:
    """(topology_id, dim, bin, n): bars that overlap or cover each bin, or die in it; bars of no length count nowhere."""
    edges = check_edges(edges)
    last = len(edges) - 2
    birth, death = F.col("birth"), F.col("death")

    def hit(k: int) -> Column:
        low, high = edges[k], edges[k + 1]
        dies = (death < F.lit(INF)) & (death >= low) & ((death <= high) if k == last else (death < high))
        return {"overlap": (birth < high) & (death > low), "cover": (birth <= low) & (death >= high), "death": dies}[mode]

    # One pass: a count for each degree and bin, of which there are few.
    counts = [F.count_if((F.col("dim") == d) & (death > birth) & hit(k)).alias(f"n{d}_{k}") for d in dims for k in range(last + 1)]
    rows = F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(k).alias("bin"), F.col(f"n{d}_{k}").alias("n")) for d in dims for k in range(last + 1)])
    return intervals.groupBy("topology_id").agg(*counts).select("topology_id", F.explode(rows).alias("x")).select("topology_id", "x.dim", "x.bin", "x.n")


class BarcodeVectorizer:
    """Bins frozen at fit, never fitted again at transform."""

    def __init__(self, bins: int, dims: list[int], min_persistence: float = 0.0, normalize: bool = False):
        self.bins, self.dims, self.min_persistence, self.normalize, self.edges = bins, dims, min_persistence, normalize, None

    def fit(self, intervals: DataFrame, domain: tuple[float, float] | None = None) -> BarcodeVectorizer:
        """One aggregate: the largest finite birth or death (or the domain's end) closes the last bin."""
        finite = F.when(F.col("death") < F.lit(INF), F.col("death"))
        low, a, b = intervals.where(F.col("dim").isin(self.dims)).agg(F.min("birth"), F.max("birth"), F.max(finite)).first()
        high = max(x for x in (a, b, domain and domain[1], 0.0) if x is not None)
        low = min(domain[0] if domain else 0.0, low if low is not None else 0.0)
        high = high if high > low else low + 1.0
        self.edges = [low + (high - low) * k / self.bins for k in range(self.bins)] + [high]
        return self

    def transform(self, intervals: DataFrame) -> DataFrame:
        """(topology_id, features array<double>)."""
        if self.edges is None:
            raise InputError("fit comes first")
        rows = histogram(intervals, self.edges, self.edges, self.dims, self.min_persistence, self.normalize)
        return rows.groupBy("topology_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "value"))), lambda x: x.value).alias("features"))
