"""Homology, persistence and spectra of many topologies in one plan: one kernel call for each topology."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..errors import InputError
from ..kernels import alpha, homology as H, spectra as S

KINDS = ("simplicial", "hyperdigraph", "interaction")


def _kind(kind: str, p: int) -> None:
    if kind not in KINDS:
        raise InputError(f"kind is one of {KINDS}")
    if not H.is_prime(p) or (kind != "simplicial" and p != 2):
        raise InputError("the field is of prime order, and of order 2 for hyperdigraphs and interactions")


def _cells(pdf: pd.DataFrame, kind: str) -> list:
    if kind == "interaction":
        return [(tuple(a), tuple(b), float(x)) for a, b, x in zip(pdf.cell_a, pdf.cell_b, pdf.birth)]
    return [(tuple(c), float(x)) for c, x in zip(pdf.cell, pdf.birth)]


def _complex(cells: list, kind: str, max_dim: int, p: int):
    if kind == "interaction":
        return H.interaction(cells)
    return H.simplicial([c for c in cells if len(c[0]) <= max_dim + 2], p) if kind == "simplicial" else H.hyperdigraph(cells, max_dim)


def _columns(cells: DataFrame, kind: str) -> DataFrame:
    return cells.select("topology_id", *(("cell_a", "cell_b") if kind == "interaction" else ("cell",)), "birth")


def _id(cells: DataFrame) -> str:
    return dict(cells.dtypes)["topology_id"]


def persistence(cells: DataFrame, max_dim: int = 1, kind: str = "simplicial", p: int = 2, include_zero: bool = False, start: float | None = None) -> DataFrame:
    """intervals(topology_id, dim, birth, death, at_initial_stage) up to max_dim; needs cells up to max_dim + 1.

    Births below start count as start. Deaths of essential bars are infinite.
    """
    _kind(kind, p)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = _cells(pdf, kind)
        if start is not None:
            cells = [(*c[:-1], max(start, c[-1])) for c in cells]
        births, boundaries = _complex(cells, kind, max_dim, p)
        found = H.bars(births, boundaries, max_dim, p, include_zero)
        first = min((c[-1] for c in cells), default=0.0) if start is None else start
        return pd.DataFrame({"topology_id": [pdf.topology_id.iloc[0]] * len(found), "dim": [b[0] for b in found], "birth": [b[1] for b in found], "death": [b[2] for b in found], "at_initial_stage": [b[1] == first for b in found]})

    return _columns(cells, kind).groupBy("topology_id").applyInPandas(kernel, f"topology_id {_id(cells)}, dim int, birth double, death double, at_initial_stage boolean")


def homology(cells: DataFrame, max_dim: int = 1, kind: str = "simplicial", p: int | str = 2, scale: float | None = None) -> DataFrame:
    """betti(topology_id, dim, betti) of the cells alive at scale (all by default); p is a prime or 'real'."""
    if p != "real":
        _kind(kind, p)
    elif kind != "simplicial":
        raise InputError("real coefficients are for simplicial complexes")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = [c for c in _cells(pdf, kind) if scale is None or c[-1] <= scale]
        q = 0 if p == "real" else p
        found = H.betti(*_complex(cells, kind, max_dim, q), max_dim, q)
        return pd.DataFrame({"topology_id": pdf.topology_id.iloc[0], "dim": range(max_dim + 1), "betti": found})

    return _columns(cells, kind).groupBy("topology_id").applyInPandas(kernel, f"topology_id {_id(cells)}, dim int, betti long")


def homology_over(cells: DataFrame, max_dim: int, fields: list[int | str]) -> DataFrame:
    """betti(topology_id, field, dim, betti) of simplicial complexes over several fields, primes or 'real', from one pass."""
    for p in fields:
        if p != "real":
            _kind("simplicial", p)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = _cells(pdf, "simplicial")
        found = []
        for p in fields:
            q = 0 if p == "real" else p
            found += [(str(p), d, n) for d, n in enumerate(H.betti(*_complex(cells, "simplicial", max_dim, q), max_dim, q))]
        return pd.DataFrame({"topology_id": pdf.topology_id.iloc[0], "field": [f[0] for f in found], "dim": [f[1] for f in found], "betti": [f[2] for f in found]})

    return _columns(cells, "simplicial").groupBy("topology_id").applyInPandas(kernel, f"topology_id {_id(cells)}, field string, dim int, betti long")


def laplacian_spectra(cells: DataFrame, dims: list[int], scales: list[tuple[float, float | None]], kind: str = "simplicial", smallest: int | None = None, tol: float = 1e-10) -> DataFrame:
    """spectra(topology_id, dim, start, end, eigenvalues, complete, nullity) at each (start, end); end None: ordinary.

    An operator without chains has the spectrum [] and the nullity 0. With `smallest`, only so
    many eigenvalues are kept, and nullity is null unless those are all.
    """
    if kind not in KINDS or any(t is not None and t < s for s, t in scales):
        raise InputError("kind is unknown, or a pair of scales falls")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        by: dict[int, list] = {}
        for c in _cells(pdf, kind):
            name, d = (c[0], len(c[0]) - 1) if kind != "interaction" else (c[:2], len(c[0]) + len(c[1]) - 2)
            by.setdefault(d, []).append((name, c[-1]))
        for x in by.values():
            x.sort(key=lambda c: (c[1], c[0]))
        out, seen = [], {}
        for q in dims:
            for s, t in scales:
                key = (q, *[sum(b <= x for _, b in by.get(d, [])) for d, x in ((q - 1, s), (q, s), (q, s if t is None else t), (q + 1, s if t is None else t))])
                if key not in seen:  # scales between births share a spectrum
                    m = S.hyperdigraph_laplacian(by, q, s, t, tol) if kind == "hyperdigraph" else S.closed_laplacian(by, q, s, t, S.product_faces if kind == "interaction" else H.faces, tol)
                    seen[key] = (len(m), S.eigenvalues(m, smallest))
                n, values = seen[key]
                complete = len(values) == n
                out.append((pdf.topology_id.iloc[0], q, s, s if t is None else t, values, complete, int((np.abs(values) <= max(tol, 1e-8)).sum()) if complete else None))
        return pd.DataFrame(out, columns=["topology_id", "dim", "start", "end", "eigenvalues", "complete", "nullity"])

    return _columns(cells, kind).groupBy("topology_id").applyInPandas(kernel, f"topology_id {_id(cells)}, dim int, start double, end double, eigenvalues array<double>, complete boolean, nullity long")


def l0_sweep(vertices: DataFrame, edges: DataFrame, scales: list[float]) -> DataFrame:
    """spectra of L_0 at rising scales, each solved anew only when an edge came in. vertices(cloud_id, v), edges(cloud_id, src, dst, birth)."""
    if any(a > b for a, b in zip(scales, scales[1:])):
        raise InputError("scales must not fall")
    kind = dict(vertices.dtypes)["cloud_id"]

    def kernel(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"topology_id": [], "scale": [], "eigenvalues": []})
        found = S.l0_sweep(sorted(v.v), list(zip(e.src, e.dst, e.birth)), scales)
        return pd.DataFrame({"topology_id": [v.cloud_id.iloc[0]] * len(scales), "scale": scales, "eigenvalues": found})

    return vertices.select("cloud_id", "v").groupBy("cloud_id").cogroup(edges.select(F.col("cloud_id").alias("of"), "src", "dst", "birth").groupBy("of")).applyInPandas(kernel, f"topology_id {kind}, scale double, eigenvalues array<double>")


def alpha_complex(points: DataFrame, max_dim: int = 2, end: float = float("inf"), duplicates: str = "merge") -> DataFrame:
    """cells of the alpha complex of each cloud, births squared radii. Points at the same place: the first stands for all, or an error."""
    kind, point = dict(points.dtypes)["cloud_id"], dict(points.dtypes)["point_id"]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        x = np.array(pdf.coords.tolist(), float).reshape(len(pdf), -1) + 0.0
        _, first = np.unique(x, axis=0, return_index=True)
        first.sort()
        if len(first) < len(x) and duplicates == "error":
            raise InputError("two points are at the same place")
        names = pdf.point_id.to_numpy()[first]
        cells = alpha.alpha_cells(x[first], max_dim, end)
        return pd.DataFrame({"topology_id": [pdf.cloud_id.iloc[0]] * len(cells), "dim": [len(c) - 1 for c, _ in cells], "cell": [sorted(names[i] for i in c) for c, _ in cells], "birth": [b for _, b in cells]})

    return points.select("cloud_id", "point_id", "row", "coords").groupBy("cloud_id").applyInPandas(kernel, f"topology_id {kind}, dim int, cell array<{point}>, birth double")


def delaunay_edges(points: DataFrame) -> DataFrame:
    """edges(cloud_id, src, dst, birth) of the Delaunay triangulation, births lengths."""
    from .points import distance

    cells = alpha_complex(points, 1, duplicates="error").where("dim = 1")
    at = points.select(F.col("cloud_id"), "point_id", "coords")
    e = cells.select(F.col("topology_id").alias("cloud_id"), F.element_at("cell", 1).alias("src"), F.element_at("cell", 2).alias("dst"))
    e = e.join(at.withColumnRenamed("point_id", "src").withColumnRenamed("coords", "a"), ["cloud_id", "src"]).join(at.withColumnRenamed("point_id", "dst").withColumnRenamed("coords", "b"), ["cloud_id", "dst"])
    return e.select("cloud_id", "src", "dst", distance().alias("birth"))


def truncated(cells: DataFrame, max_dim: int) -> DataFrame:
    """(topology_id, truncated): whether a topology lacks the cells of dimension max_dim + 1 that its homology in max_dim needs."""
    return cells.groupBy("topology_id").agg((F.max("dim") < max_dim + 1).alias("truncated"))


def basis_labels(cells: DataFrame, dim: int, scale: float | None = None) -> DataFrame:
    """(topology_id, labels): the cells of a dimension alive at scale in the order of the rows of its operator."""
    alive = cells.where((F.col("dim") == dim) & (F.lit(True) if scale is None else F.col("birth") <= scale))
    return alive.groupBy("topology_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("birth", "cell"))), lambda x: x.cell).alias("labels"))


def path_compatible(vertices: DataFrame, edges: DataFrame, max_dim: int = 1) -> DataFrame:
    """Intervals of H_0 and H_1 of directed edges(cloud_id, src, dst, birth) and the paths of two that they imply."""
    from .hyperdigraph import path_complex

    return persistence(path_complex(vertices, edges, max_dim + 1), max_dim, "hyperdigraph")
