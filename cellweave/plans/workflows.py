"""Compositions: analyses of many topologies at once, as dictionaries of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import InputError, ResourceLimitError
from ..functions import barcodes, spectra
from ..operators import analysis, hyperdigraph, interaction, points as P, simplicial as X
from ..storage import MOST_SCALES

STATIONARY = ("min", "max", "mean", "zero_count", "energy")

BUILDERS: dict = {}


def register_builder(name: str, build, replace: bool = False) -> None:
    """A recipe from points to cells, under a name that `from_points` takes."""
    if name in BUILDERS and not replace:
        raise InputError(f"a builder {name} is registered")
    BUILDERS[name] = build


def from_points(points: DataFrame, kind: str = "rips", **options) -> DataFrame:
    if kind not in BUILDERS:
        raise InputError(f"unknown kind {kind}; there are {sorted(BUILDERS)}")
    cells = BUILDERS[kind](points, **options)
    if missing := {"topology_id", "birth"} - set(cells.columns):
        raise InputError(f"the builder's result lacks {sorted(missing)}")
    return cells


def _digraph(points: DataFrame, max_dim: int = 2, support: str = "complete", cutoff: float | None = None) -> DataFrame:
    edges = P.pairs(points, cutoff, weights=True) if support == "complete" else analysis.delaunay_edges(points)
    if support != "complete" and cutoff is not None:
        edges = edges.where(F.col("birth") <= cutoff)
    return hyperdigraph.path_complex(points.select("cloud_id", F.col("point_id").alias("v")), hyperdigraph.orient(edges, None if support == "complete" else points), max_dim)


register_builder("rips", X.rips_complex)
register_builder("alpha", analysis.alpha_complex)
register_builder("graph", lambda points, cutoff=None: X.rips_graph(points, cutoff))
register_builder("hyperdigraph", _digraph)


def analyze(cells: DataFrame, scales: list[float], max_dim: int = 1, kind: str = "simplicial", dims: list[int] | None = None) -> dict[str, DataFrame]:
    """intervals, betti at each scale and spectra at each scale."""
    bars = analysis.persistence(cells, max_dim, kind)
    return {"intervals": bars, "betti": barcodes.betti_at(bars, scales), "spectra": analysis.laplacian_spectra(cells, dims or list(range(max_dim + 1)), [(float(s), None) for s in scales], kind)}


def analyze_stationary(cells: DataFrame, scale: float, dims: tuple[int, ...] = (0, 1), statistics: tuple[str, ...] = STATIONARY, kind: str = "simplicial", positive_only: bool = False, atol: float = 1e-8) -> DataFrame:
    """(topology_id, dim, betti, statistics...) at one scale; degrees without cells have NaN."""
    s = spectra.summarize(analysis.laplacian_spectra(cells, list(dims), [(scale, None)], kind), statistics, positive_only, atol)
    b = analysis.homology(cells, max(dims), kind, scale=scale)
    return s.join(b, ["topology_id", "dim"], "left").select("topology_id", "dim", "betti", *statistics)


def laplacian_series(cells: DataFrame, dims: list[int], scales: list[float] | None = None, pairs: list[tuple[float, float]] | None = None, kind: str = "simplicial", statistics: tuple[str, ...] = spectra.DEFAULT) -> DataFrame:
    """Statistics of ordinary spectra at rising scales (all critical ones if none are given), or of two-scale ones at given pairs."""
    if pairs is not None:
        if scales is not None or len(set(pairs)) < len(pairs):
            raise InputError("give scales or distinct pairs")
        at = [(float(s), float(t)) for s, t in pairs]
    else:
        if scales is None:
            found = [r.birth for r in cells.select("birth").distinct().orderBy("birth").limit(MOST_SCALES + 1).collect()]
            scales = found
        if len(scales) > MOST_SCALES:
            raise ResourceLimitError(f"more than {MOST_SCALES} scales")
        if any(a >= b for a, b in zip(scales, scales[1:])):
            raise InputError("scales must rise")
        at = [(float(s), None) for s in scales]
    return spectra.summarize(analysis.laplacian_spectra(cells, dims, at, kind), statistics).drop("eigenvalues")


def interaction_at_pair(a: DataFrame, b: DataFrame, s: float, t: float, max_degree: int = 2) -> DataFrame:
    """The interaction complex of one factor at s and the other at t, all cells born at 0."""
    return interaction.interaction_complex(X.snapshot(a, s).withColumn("birth", F.lit(0.0)), X.snapshot(b, t).withColumn("birth", F.lit(0.0)), max_degree)


def interaction_along_pairs(a: DataFrame, b: DataFrame, pairs: list[tuple[float, float]], max_degree: int = 2) -> DataFrame:
    """The interaction complex along a path of pairs of scales, births the place on the path."""
    return interaction.interaction_complex(interaction.regrade(a, [s for s, _ in pairs]), interaction.regrade(b, [t for _, t in pairs]), max_degree)


def interaction_persistence(a: DataFrame, b: DataFrame, max_dim: int = 1, minimum: float = 0.0) -> DataFrame:
    """Bars of the interaction complex longer than `minimum`."""
    bars = analysis.persistence(interaction.interaction_complex(a, b, max_dim + 1), max_dim, "interaction")
    return bars.where(F.col("death") - F.col("birth") > minimum)


def interaction_laplacians(a: DataFrame, b: DataFrame, dims: list[int], s: tuple[float, float], t: tuple[float, float] | None = None) -> DataFrame:
    """Spectra at one pair of scales, or from one to another further on."""
    path = [s] if t is None else [s, t]
    cells = interaction_along_pairs(a, b, path, max(dims) + 1)
    return analysis.laplacian_spectra(cells, dims, [(0.0, None if t is None else 1.0)], "interaction")


def feature_matrix(features: DataFrame, schema: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(sample_id, features array) from features(sample_id, ordinal, name, value); every sample must have the same names."""
    names = [r.name for r in features.groupBy("ordinal", "name").agg(F.count_distinct("sample_id").alias("n")).orderBy("ordinal").collect()]
    if schema is not None and names != schema:
        raise InputError("the features are not those of the schema")
    rows = features.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "value"))).alias("f"))
    whole = rows.where((F.size("f") != len(names)) | F.exists("f", lambda x: F.isnan(x.value) | x.value.isNull()))
    if whole.limit(1).count():
        raise InputError("a sample lacks features or has one that is not finite")
    return rows.select("sample_id", F.transform("f", lambda x: x.value).alias("features")), names


def fit_features(matrix: DataFrame, targets: DataFrame, task: str = "regression", estimator=None, **options):
    """A fitted pyspark.ml model: gradient-boosted trees, or the estimator given. targets(sample_id, target)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    if estimator is not None and options:
        raise InputError("options are for the default estimator")
    joined = matrix.join(targets, "sample_id", "left").select(array_to_vector("features").alias("features"), F.col("target").cast("double").alias("label"))
    if joined.where("label is null").limit(1).count() or not joined.limit(1).count():
        raise InputError("a sample has no target, or there are none")
    return (estimator or {"regression": GBTRegressor, "classification": GBTClassifier}[task](seed=0, **options)).fit(joined)


def ensemble_mean(models: list, matrix: DataFrame) -> DataFrame:
    """(sample_id, prediction): the mean of the predictions of fitted models for each row of the matrix."""
    from pyspark.ml.functions import array_to_vector

    rows = matrix.select("sample_id", array_to_vector("features").alias("features"))
    for k, model in enumerate(models):
        rows = model.transform(rows).withColumnRenamed("prediction", f"prediction_{k}").select("sample_id", "features", *[f"prediction_{j}" for j in range(k + 1)])
    total = sum((F.col(f"prediction_{k}") for k in range(1, len(models))), F.col("prediction_0"))
    return rows.select("sample_id", (total / len(models)).alias("prediction"))
