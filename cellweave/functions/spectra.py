"""Statistics of spectra(..., eigenvalues array<double>), as expressions on the array."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..errors import InputError

NAN = float("nan")
DEFAULT = ("mean", "max", "min", "std", "zero_count")


def total(x: Column, f: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v))


def _or_nan(x: Column, value: Column) -> Column:
    return F.when(F.size(x) > 0, value).otherwise(F.lit(NAN))


def mean(x: Column) -> Column:
    return _or_nan(x, total(x) / F.size(x))


def central_moment(x: Column, k: int) -> Column:
    m = total(x) / F.size(x)
    return _or_nan(x, F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(v - m, F.lit(float(k)))) / F.size(x))


def moment(x: Column, k: int) -> Column:
    return F.when(F.size(x) == 0, F.lit(NAN)).otherwise(F.lit(1.0) if k == 0 else total(x, lambda v: F.pow(v, F.lit(float(k)))) / F.size(x))


def quantile(x: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""
    s = F.array_sort(x)
    at = (F.size(x) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a = F.get(s, low)
    b = F.get(s, F.least(low + 1, F.size(x) - 1))
    return _or_nan(x, a + (b - a) * (at - low))


def entropy(x: Column, base: float | None = None) -> Column:
    """-sum p ln p of the shares of the positive values; 0 if there is none."""
    p = F.filter(x, lambda v: v > 0)
    s = total(p)
    h = F.aggregate(p, F.lit(0.0), lambda acc, v: acc - v / s * F.ln(v / s))
    if base is not None:
        import math

        h = h / math.log(base)
    return F.when(F.size(p) == 0, F.lit(0.0)).otherwise(h)


STATISTICS: dict[str, Callable[[Column], Column]] = {
    "min": lambda x: _or_nan(x, F.array_min(x)),
    "max": lambda x: _or_nan(x, F.array_max(x)),
    "mean": mean,
    "sum": lambda x: total(x),
    "count": lambda x: F.size(x).cast("double"),
    "std": lambda x: F.sqrt(central_moment(x, 2)),
    "variance": lambda x: central_moment(x, 2),
    "median": lambda x: quantile(x, 0.5),
    "energy": lambda x: total(x, F.abs),
    "entropy": entropy,
    **{f"moment_{k}": (lambda x, k=k: moment(x, k)) for k in (1, 2, 3, 4)},
}
#: Of the whole spectrum, whatever values the others take.
WHOLE = {"zero_count", "positive_count", "laplacian_energy"}


def _own(f: Callable):
    """A user's statistic of one list of values as a vectorised function."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f).astype(float)

    return run


def summarize(spectra: DataFrame, statistics=DEFAULT, positive_only: bool = True, atol: float = 1e-8, rtol: float = 1e-10, empty: str = "nan", partial: bool = False, custom: dict[str, Callable] | None = None) -> DataFrame:
    """spectra with a column for each statistic.

    Values up to max(atol, rtol * the largest) count as zero; more negative ones are an error.
    An empty spectrum gives NaN, or 0 with empty="zero". A partial spectrum
    (``complete`` false) is refused unless partial is set, and then has no zero_count.
    custom: names and functions of a pandas Series of value lists (a pandas UDF's body).
    """
    if unknown := [s for s in statistics if s not in STATISTICS and s not in WHOLE]:
        raise InputError(f"unknown statistics {unknown}")
    x = F.col("eigenvalues")
    tol = F.greatest(F.lit(atol), rtol * F.coalesce(F.array_max(F.transform(x, F.abs)), F.lit(0.0)))
    out = spectra.withColumn("_tol", tol)
    checked = F.when(F.exists(x, lambda v: v < -F.col("_tol")), F.raise_error(F.lit("a spectrum has a negative eigenvalue"))).otherwise(x)
    if "complete" in spectra.columns and not partial:
        checked = F.when(~F.col("complete"), F.raise_error(F.lit("a spectrum is partial"))).otherwise(checked)
    out = out.withColumn("_x", checked)
    whole = F.col("complete") if "complete" in spectra.columns else F.lit(True)
    out = out.withColumn("_s", F.filter("_x", lambda v: v > F.col("_tol")) if positive_only else F.transform("_x", lambda v: F.when(F.abs(v) <= F.col("_tol"), 0.0).otherwise(v)))
    columns = {}
    for s in statistics:
        if s == "zero_count":
            columns[s] = F.when(whole, F.size(F.filter("_x", lambda v: F.abs(v) <= F.col("_tol"))).cast("double")).otherwise(NAN)
        elif s == "positive_count":
            columns[s] = F.size(F.filter("_x", lambda v: v > F.col("_tol"))).cast("double")
        elif s == "laplacian_energy":
            m = total(F.col("_x")) / F.size("_x")
            columns[s] = F.when(~whole, F.lit(NAN)).when(F.size("_x") == 0, 0.0).otherwise(F.aggregate("_x", F.lit(0.0), lambda acc, v: acc + F.abs(v - m)))
        else:
            columns[s] = STATISTICS[s](F.col("_s"))
        if empty == "zero":
            columns[s] = F.when((F.size("_x") == 0) & whole, F.lit(0.0)).otherwise(columns[s])
    out = out.withColumns(columns)
    for name, f in (custom or {}).items():
        out = out.withColumn(name, _own(f)("_s"))
    return out.drop("_tol", "_x", "_s")


def ten_statistics(x: Column, atol: float = 1e-8) -> Column:
    """The ten numbers of the molecular recipe: size, zeros, then of the positive values mean, min/mean, mean absolute deviation/mean, max/mean, quartiles and entropy; zeros without a positive value."""
    p = F.filter(x, lambda v: v > atol)
    m = total(p) / F.size(p)
    zero = F.size(F.filter(x, lambda v: F.abs(v) <= atol)).cast("double")
    values = [m, F.array_min(p) / m, F.aggregate(p, F.lit(0.0), lambda s, v: s + F.abs(v - m)) / F.size(p) / m, F.array_max(p) / m, quantile(p, 0.25), quantile(p, 0.5), quantile(p, 0.75), entropy(p)]
    return F.array(F.size(x).cast("double"), zero, *[F.when(F.size(p) > 0, v).otherwise(0.0) for v in values])


def graph_entropy(spectra: DataFrame, base: float | None = None) -> DataFrame:
    """(topology_id, graph_entropy) of complete spectra of L_0; a partial one is an error."""
    x = F.col("eigenvalues")
    if "complete" in spectra.columns:
        x = F.when(F.col("complete"), x).otherwise(F.raise_error(F.lit("a spectrum is partial")).cast("array<double>"))
    return spectra.select("topology_id", entropy(x, base).alias("graph_entropy"))
