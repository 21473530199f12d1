"""Registered queries whose plans must not grow with the pairs, and the block kernels against brute force."""

import numpy as np
import pytest

from cellweave.operators import blocks, components, points as P, simplicial as X
from cellweave.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cloud(spark):
    """A dense cloud with repeated places, one far away, and distances at the cutoff."""
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 0.1, (60, 2)), np.repeat(r.normal(0, 0.1, (3, 2)), 3, 0), [[0.0, 0.0], [0.15, 0.0], [9.0, 9.0]]])
    df = spark.createDataFrame([("c", k, k, p.tolist(), float(k % 3)) for k, p in enumerate(x)], "cloud_id string, point_id long, row int, coords array<double>, weight double")
    return df, x, np.sqrt((x[:, None, 0] - x[None, :, 0]) ** 2 + (x[:, None, 1] - x[None, :, 1]) ** 2)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 7)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs(cloud, small_blocks):
    df, x, d = cloud
    found = {(r.src, r.dst): r.birth for r in P.pairs(df, 0.15).collect()}
    assert found == {(i, j): d[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= 0.15}
    assert len(P.pairs(df).collect()) == len(x) * (len(x) - 1) // 2


def test_neighbours(cloud, small_blocks):
    df, x, d = cloud
    w, near = np.arange(len(x)) % 3, (d <= 0.15) & ~np.eye(len(x), dtype=bool)
    for r in blocks.neighbours(df, [0.05, 0.15], total=True).collect():
        k = near[r.point_id]
        assert r.n[1] == k.sum() and r.same[1] == (k & (w == w[r.point_id])).sum() and r.n[0] == (k & (d[r.point_id] <= 0.05)).sum()
        assert r.total == pytest.approx(d[r.point_id][k].sum()) and r.least == d[r.point_id][k].min(initial=np.inf)


def test_triangles(cloud, small_blocks):
    df, x, d = cloud
    a = (d <= 0.15) & ~np.eye(len(x), dtype=bool)
    t = (a.astype(int) @ a.astype(int)) * a
    assert {(r.src, r.dst): r.n for r in blocks.edge_triangles(df, 0.15).collect()} == {(i, j): t[i, j] for i, j in zip(*np.nonzero(np.triu(a)))}
    n = {(r.scale, r.dim): r.n_cells for r in X.rips_counts(df, [0.05, 0.15]).collect()}
    assert (n[0.15, 0], n[0.15, 1], n[0.15, 2]) == (len(x), a.sum() // 2, t.sum() // 6)
    cells = X.rips_complex(df, 2, 0.15).where("dim = 2").collect()
    assert len({tuple(r.cell) for r in cells}) == len(cells) == t.sum() // 6
    assert all(r.birth == max(d[r.cell[0], r.cell[1]], d[r.cell[0], r.cell[2]], d[r.cell[1], r.cell[2]]) and list(r.cell) == sorted(r.cell) for r in cells)
    sums = blocks.triangle_births(df, 0.15).first()
    assert sums.n == len(cells) and sums.births == pytest.approx(sum(r.birth for r in cells))


def test_components_of_points(cloud, small_blocks):
    df, x, d = cloud
    whole = components.components(df.selectExpr("cloud_id", "point_id v"), P.pairs(df, 0.06))
    assert sorted(map(tuple, components.of_points(df, 0.06).collect())) == sorted(map(tuple, whole.collect()))
    assert blocks.links(df, 0.15).count() < P.pairs(df, 0.15).count()


#: Counts and sums: neither rows of pairs nor a kernel over a whole topology.
COUNTED = ['l0_series', 'l0_spectrum', 'interaction_cycles', 'spectral_series', 'stationary', 'hyperdigraph_l0', 'hyperdigraph_persistent_l0', 'interaction_persistent_l0', 'higher_overlap', 'interaction_bound', 'skeleton_f_vector', 'vertex_deleted_l0', 'regraded_edges', 'hyperdigraph_snapshot', 'coface_truncation', 'rips_summary', 'snapshot_counts', 'l1_moments', 'boundary_of_boundary', 'interaction_boundary_audit', 'protein_ligand_atoms', 'protein_protein_atoms', 'critical_scales', 'distance_matrix_triangles']


@pytest.mark.parametrize("name", COUNTED)
def test_counted(spark, name):
    text = plan(catalog.QUERIES[name](spark, DATA))
    assert "InPandas" not in text and "src" not in text


#: Pairs and cells are sent as they are found: no exchange after the kernel that finds them.
SENT = ['rips_edges', 'edge_cofaces', 'bounded_filtration', 'masked_edges', 'adjacency_bonds', 'l0_entries', 'line_edges', 'numbered_cells', 'boundary_entries', 'rips_triangles', 'hyperdigraph_paths']


@pytest.mark.parametrize("name", SENT)
def test_sent(spark, name):
    assert "Exchange" not in plan(catalog.QUERIES[name](spark, DATA)).split("InArrow")[0]


def test_ranks_over_fields():
    from cellweave.kernels import homology as H

    plane = [(0, 1, 3), (0, 1, 5), (0, 2, 3), (0, 2, 4), (0, 4, 5), (1, 2, 4), (1, 2, 5), (1, 3, 4), (2, 3, 5), (3, 4, 5)]
    cells = {c: 0.0 for t in plane for c in (t, *(t[:k] + t[k + 1 :] for k in range(3)), *((v,) for v in t))}
    found = {p: H.betti(*H.simplicial(list(cells.items()), p), 2, p) for p in (0, 2, 3)}
    assert found == {0: [1, 0, 0], 2: [1, 1, 1], 3: [1, 0, 0]}


def test_ties_in_order_of_ids(spark):
    from cellweave.operators import hyperdigraph

    line = spark.createDataFrame([("c", k, [x]) for k, x in ((5, 1.0), (3, 1.0), (4, 0.0))], "cloud_id string, point_id long, coords array<double>")
    assert {(r.src, r.dst) for r in hyperdigraph.consecutive(line.coalesce(1)).collect()} == {(4, 3), (3, 5)}
