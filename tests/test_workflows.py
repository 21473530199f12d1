import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.errors import InputError, ResourceLimitError
from cellweave.functions import barcodes, spectra
from cellweave.operators import analysis, hyperdigraph, interaction, points as P, simplicial as X
from cellweave.plans import recipes, workflows
from cellweave.streaming import edges as streaming


@pytest.fixture(scope="module")
def square(spark):
    return spark.createDataFrame([("s", k, k, x, float(k)) for k, x in enumerate([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]])], "cloud_id string, point_id long, row int, coords array<double>, weight double")


def test_square(spark, square):
    bars = analysis.persistence(X.rips_complex(square, 2), 1).where("dim = 1").collect()
    assert [(r.birth, r.death) for r in bars] == [(1.0, pytest.approx(math.sqrt(2)))]
    found = workflows.analyze(workflows.from_points(square, "alpha"), [0.3, 0.6])
    assert {(r.dim, r.scale): r.betti for r in found["betti"].collect()} == {(0, 0.3): 1, (1, 0.3): 1, (0, 0.6): 1, (1, 0.6): 0}
    assert found["spectra"].count() == 4


def test_limits_raise(square):
    with pytest.raises(ResourceLimitError):
        X.rips_complex(square, 2, max_cells=1)
    with pytest.raises(InputError):
        analysis.persistence(X.rips_complex(square, 2), p=4)
    with pytest.raises(InputError):
        workflows.from_points(square, "none")


def test_stationary_and_series(square):
    cells = X.rips_complex(square, 2)
    rows = {r.dim: r for r in workflows.analyze_stationary(cells, 1.0, (0, 1, 2)).collect()}
    assert rows[0]["max"] == pytest.approx(4) and rows[0].betti == 1 and rows[1].betti == 1
    assert math.isnan(rows[2]["max"])
    assert workflows.laplacian_series(cells, [0], statistics=("zero_count",)).count() == 3
    with pytest.raises(InputError):
        workflows.laplacian_series(cells, [0], [1.0, 0.5])
    assert workflows.laplacian_series(cells, [0], pairs=[(0.0, 1.0)]).count() == 1


def test_summaries_of_empty_and_partial(spark):
    s = spark.createDataFrame([("a", [], True), ("b", [0.0, 1.0, 3.0], True)], "topology_id string, eigenvalues array<double>, complete boolean")
    rows = {r.topology_id: r for r in spectra.summarize(s, ("mean", "zero_count", "entropy"), custom={"n": len}).collect()}
    assert math.isnan(rows["a"]["mean"]) and rows["a"].entropy == 0 and rows["b"]["mean"] == 2 and rows["b"].n == 2
    assert spectra.summarize(s, ("mean",), empty="zero").where("topology_id = 'a'").first()["mean"] == 0
    with pytest.raises(Exception, match="partial"):
        spectra.summarize(s.withColumn("complete", F.lit(False)), ("mean",)).collect()
    with pytest.raises(Exception, match="negative"):
        spectra.summarize(spark.createDataFrame([([-1.0],)], "eigenvalues array<double>"), ("mean",)).collect()


def test_bin_counts(spark):
    inf = float("inf")
    bars = spark.createDataFrame([("t", 0, *b) for b in ((0.0, 0.05), (0.02, 0.08), (0.05, 0.1), (0.0, inf), (0.05, 0.05), (0.1, inf))], "topology_id string, dim int, birth double, death double")
    count = lambda m: [r.n for r in barcodes.bin_counts(bars, [0.0, 0.05, 0.1], [0], m).orderBy("bin").collect()]
    assert (count("overlap"), count("cover"), count("death")) == ([3, 3], [2, 2], [0, 3])
    v = barcodes.BarcodeVectorizer(2, [0]).fit(bars)
    assert v.edges == [0.0, 0.05, 0.1] and len(v.transform(bars).first().features) == 8
    assert sum(v.transform(bars).first().features) == 6
    with pytest.raises(InputError):
        barcodes.check_edges([1.0, 1.0])
    assert barcodes.edges_of(0.0, 1.0, 0.4) == [0.0, 0.4, 0.8, 1.0]


def test_hyperdigraph_from_weights(spark, square):
    tied = square.withColumn("weight", F.when(F.col("point_id") < 2, 0.0).otherwise(F.col("weight")))
    e = hyperdigraph.orient(P.pairs(tied, 1.0), tied)
    assert {(r.src, r.dst) for r in e.collect()} == {(0, 1), (1, 0), (1, 2), (2, 3), (0, 3)}
    line = spark.createDataFrame([("s", k, k, [float(x)], 1.0) for k, x in enumerate((3, 1, 2))], "cloud_id string, point_id long, row int, coords array<double>, weight double")
    assert {(r.src, r.dst, r.birth) for r in hyperdigraph.consecutive(line).collect()} == {(1, 2, 1.0), (2, 0, 1.0)}


def test_bounds_and_dimensions(spark):
    rows = spark.createDataFrame([("t", 0, [[0], [1]], [0.0, 0.0]), ("t", 1, [[0, 1]], [2.0])], "topology_id string, dim int, hyperedges array<array<long>>, births array<double>")
    cells = hyperdigraph.from_dimensions(rows)
    low = spark.createDataFrame([("t", [0, 1]), ("t", [1, 0])], "topology_id string, cell array<long>")
    assert {(tuple(r.cell), r.birth) for r in hyperdigraph.bounded(cells, low, start=0.5).collect()} == {((0,), 0.0), ((1,), 0.0), ((0, 1), 0.5), ((1, 0), 0.5)}
    assert hyperdigraph.bounded(cells, maximum=low.where("cell[0] = 1")).count() == 2


def test_interaction(spark, square):
    a = X.graph_complex(X.vertices_of(square), P.pairs(square, 1.0))
    full = interaction.interaction_complex(a, a, 2)
    values = np.array([r.eigenvalue for r in interaction.degree_zero_spectrum(full, 1.0).collect()])
    assert (values == 4).all()
    kernel = analysis.laplacian_spectra(full, [0], [(1.0, None)], "interaction").first().eigenvalues
    assert kernel == pytest.approx([4.0] * 4)
    bars = workflows.interaction_persistence(a, a, 1)
    snap = analysis.homology(full, 1, "interaction", scale=1.0)
    alive = {r.dim: r.n for r in bars.where("birth <= 1 and death > 1").groupBy("dim").agg(F.count("*").alias("n")).collect()}
    assert {r.dim: r.betti for r in snap.collect()} == {d: alive.get(d, 0) for d in (0, 1)}
    assert workflows.interaction_at_pair(a, a, 0.0, 1.0).where("degree = 1").count() == 8
    assert workflows.interaction_laplacians(a, a, [0], (0.0, 0.0), (1.0, 1.0)).count() == 1
    with pytest.raises(InputError):
        interaction.regrade(a, [1.0, 0.5])


def test_overlap(spark, square):
    pairs = spark.createDataFrame([("s", 0, 2)], "cloud_id string, a_id long, b_id long")
    v = {(r.factor, r.point_id): r.vertex for r in interaction.overlap(square, square, pairs).collect()}
    assert v[0, 0] == v[1, 2] and len(set(v.values())) == 7


def test_adjacency(spark):
    df = lambda rows: spark.createDataFrame([("c", *r) for r in rows], "cloud_id string, i int, j int, v int")
    assert [(r.src, r.dst) for r in P.bonds_from_adjacency(df([(0, 1, 1), (1, 0, 1), (0, 0, 0)])).collect()] == [(0, 1)]
    for bad in ([(0, 0, 1)], [(0, 1, 2)], [(0, 1, 1)]):
        with pytest.raises(InputError):
            P.bonds_from_adjacency(df(bad))


def test_check(spark, square):
    assert P.check(square).count() == 4
    with pytest.raises(InputError):
        P.check(square.withColumn("coords", F.array(F.lit(float("nan")))))


def test_recipes(spark, tmp_path):
    r = np.random.default_rng(0)
    atom = lambda k, e, shift: ("s", k, e, (r.random(3) * 4 + shift).tolist())
    protein = spark.createDataFrame([atom(k, "CNOS"[k % 4], 0) for k in range(12)] + [("s", 99, "C", [99.0, 0.0, 0.0])], "sample_id string, row int, element string, coords array<double>")
    ligand = spark.createDataFrame([atom(k, "CO"[k % 2], 2) for k in range(6)], "sample_id string, row int, element string, coords array<double>")
    f = recipes.protein_ligand(protein, ligand)
    x = np.array(f.first().features).reshape(10, 50, 55)
    both = recipes.PL_CHANNELS.index(("C", "O"))
    assert x[0, 0, both] == 6 and not x[:, :, 0].any() and x[0, 0, recipes.PL_CHANNELS.index(("C", "null"))] == 3
    atoms = spark.createDataFrame(
        [("s", k, "AB"[k % 2], k // 4, ["CA", "N"][k // 2 % 2], ["C", "N"][k // 2 % 2], 1.0, (r.random(3) * 6).tolist()) for k in range(24)], "sample_id string, row int, chain string, residue int, name string, element string, occupancy double, coords array<double>"
    )
    groups = spark.createDataFrame([("s", "A", "a"), ("s", "B", "b")], "sample_id string, chain string, partner string")
    assert len(recipes.protein_protein(atoms, groups).first().features) == 5040
    assert {x.status for x in recipes.publish(f, spark.createDataFrame([("s",), ("t",)], "sample_id string"), str(tmp_path / "f")).collect()} == {"done", "failed"}
    assert not (tmp_path / "f").exists()


def test_statistics_agree(spark):
    values = [0.0, 0.5, 1.5, 4.0]
    got = spark.createDataFrame([(values,)], "x array<double>").select(spectra.ten_statistics(F.col("x"))).first()[0]
    assert got == pytest.approx(recipes.statistics(np.array(values)))


def test_features_and_model(spark):
    rows = [(s, k, f"f{k}", float(s * k)) for s in range(12) for k in range(2)]
    m, names = workflows.feature_matrix(spark.createDataFrame(rows, "sample_id long, ordinal int, name string, value double"))
    assert names == ["f0", "f1"]
    y = spark.createDataFrame([(s, float(s)) for s in range(12)], "sample_id long, target double")
    assert workflows.fit_features(m, y, maxIter=2).getNumTrees == 2
    with pytest.raises(InputError):
        workflows.fit_features(m, y.limit(3))


def test_stream(spark, tmp_path):
    for k, rows in enumerate(([("c", 0, 1, 0.5), ("c", 2, 3, 0.6)], [("c", 1, 2, 0.9), ("c", 0, 3, 0.1)])):
        spark.createDataFrame(rows, "cloud_id string, src long, dst long, birth double").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema("cloud_id string, src long, dst long, birth double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = streaming.l0_trace(source).writeStream.format("memory").queryName("traces").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    last = spark.sql("SELECT * FROM traces ORDER BY scale DESC LIMIT 1").first()
    assert (last.n_edges, last["trace"], last.n_components, last.refused) == (3, 6, 1, 1)
