import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel

from cohortry.config import FEATURE_SETS, FeatureSet
from cohortry.operators import metrics as M
from cohortry.operators import selection as S
from cohortry.operators import validation as V
from cohortry.operators.matrix import build_matrix, named_matrix
from cohortry.sources.writers import save_model


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0, 0], [20, 0, 5], [0, 20, -5], [20, 20, 9]])
    x = np.vstack([c + rng.normal(size=(60, 3)) for c in centres])
    pdf = pd.DataFrame(x, columns=["p", "q", "r"]).assign(client_id=np.arange(240), truth=np.repeat(range(4), 60))
    return spark.createDataFrame(pdf)


SET = FeatureSet("t", ("p", "q", "r"))


def test_feature_sets():
    assert [len(f.numeric) for f in FEATURE_SETS.values()] == [6, 10, 8, 12, 12, 12]
    assert len(FEATURE_SETS["prd_full"].categorical) == 4


def test_standard_scaling(blobs):
    m = build_matrix(blobs, SET)
    x = named_matrix(m).toPandas()[["p", "q", "r"]].to_numpy()
    assert x.mean(0) == pytest.approx([0, 0, 0], abs=1e-9)
    assert x.std(0) == pytest.approx([1, 1, 1], abs=1e-9)


def test_constant_and_one_hot(spark):
    df = spark.createDataFrame([(1, 5.0, "F", "it's"), (2, 5.0, "M", "b"), (3, 5.0, "F", "c")], "client_id int, x double, g string, h string")
    for scaler in ("standard", "minmax"):
        m = build_matrix(df, FeatureSet("t", ("x",), ("g", "h")), scaler)
        assert m.names == ["x", "g_M", "h_b", "h_c", "h_it's"]
        rows = named_matrix(m).orderBy("client_id").collect()
        assert [tuple(r)[1:] for r in rows] == [(0, 0, 0, 0, 1), (0, 1, 1, 0, 0), (0, 0, 0, 1, 0)]
    new = m.model.transform(spark.createDataFrame([(9, 5.0, "X", "new")], df.schema)).first()
    assert list(new["features"]) == [0, 0, 0, 0, 0]


def test_saved_preprocessor(blobs, tmp_path):
    m = build_matrix(blobs, SET, "minmax")
    save_model(m.model, str(tmp_path / "pre"))
    again = PipelineModel.load(str(tmp_path / "pre")).transform(blobs)
    assert again.select("features").exceptAll(m.df.select("features")).count() == 0


def test_kmeans_finds_blobs(blobs):
    m = build_matrix(blobs, SET)
    rows = m.df.persist()
    model = S.fit_kmeans(rows, 4, n_init=4).setPredictionCol("cluster")
    assert M.adjusted_rand(model.transform(rows), "truth", "cluster").first()[0] == 1.0
    runs = V.stability_runs(model.transform(rows), m.columns, 4, "cluster", n_runs=2, n_init=3)
    row = V.stability(runs).first()
    assert (row["min_ari"], row["n_runs"]) == (1.0, 2)


def test_experiment_and_scan(spark, blobs):
    from cohortry.config import BEHAVIOUR_CORE, DECLARED

    columns = dict.fromkeys((*BEHAVIOUR_CORE, *DECLARED))
    df = blobs.selectExpr("client_id", *[
        f"cast(p + {i} * q as double) as {c}" if c in BEHAVIOUR_CORE else f"cast(client_id % {i} > 2 as int) as {c}"
        for i, c in enumerate(columns)])
    grid = S.run_experiment(df, {"t": FeatureSet("t", BEHAVIOUR_CORE)}, ("standard",), (2, 4), n_init=2)
    rows = {r["k"]: r for r in grid.collect()}
    assert set(rows) == {2, 4} and grid.columns == [f.split()[0] for f in S.EXPERIMENT_SCHEMA.split(", ")]
    assert rows[4]["inertia"] < rows[2]["inertia"] and rows[4]["viable"]
    exact = S.run_experiment(df, {"t": FeatureSet("t", BEHAVIOUR_CORE)}, ("standard",), (2,), n_init=2, silhouette="euclidean")
    assert rows[2]["silhouette"] > exact.first()["silhouette"]
    assert exact.first()["inertia"] == pytest.approx(rows[2]["inertia"])
    scan = S.scan_k(build_matrix(df, FeatureSet("t", BEHAVIOUR_CORE)), (2, 3), n_init=1)
    assert scan.count() == 2
    with pytest.raises(ValueError, match="silhouette"):
        S.run_experiment(df, silhouette="cosine")


def plain_ward(x, k):
    """Ward from the definition: join the pair that adds least within-group variance."""
    groups = [[i] for i in range(len(x))]
    heights = []

    def cost(a, b):
        def ss(g):
            return ((x[g] - x[g].mean(0)) ** 2).sum()
        return ss(a + b) - ss(a) - ss(b)

    cut = None
    while len(groups) > 1:
        if len(groups) == k:
            cut = [sorted(g) for g in groups]
        c, i, j = min((cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        heights.append(np.sqrt(2 * c))
        groups = [g for n, g in enumerate(groups) if n not in (i, j)] + [groups[i] + groups[j]]
    return heights, cut


def test_ward_on_few_rows_is_plain_ward(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(25, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(client_id=range(25)))
    tree = V.fit_hierarchical(df, ["a", "b"], 3)
    heights, cut = plain_ward(x, 3)
    got = [r["height"] for r in tree.merges.orderBy("step").collect()]
    assert got == pytest.approx(heights, abs=1e-9)
    labels = tree.labels.toPandas()
    assert sorted(sorted(g["client_id"]) for _, g in labels.groupby("hierarchical_cluster")) == sorted(cut)
    assert -1 <= tree.cophenetic <= 1


def test_ward_on_micro_clusters(blobs):
    m = build_matrix(blobs, SET)
    tree = V.fit_hierarchical(m.df, m.columns, 4, micro=20)
    assert tree.labels.count() == 240
    assert M.adjusted_rand(tree.labels, "truth", "hierarchical_cluster").first()[0] == 1.0


def test_cophenetic_of_three_points():
    centres, weights = np.array([[0.0], [1.0], [10.0]]), np.ones(3)
    merges = V.ward_merges(centres, weights)
    assert [(a, b) for a, b, _, _ in merges] == [(0, 1), (2, 3)]
    high = merges[1][2]
    want = np.corrcoef([1, 10, 9], [merges[0][2], high, high])[0, 1]
    assert V.cophenetic_correlation(centres, weights, merges) == pytest.approx(want)


@pytest.mark.parametrize("fraction", [0.8, 0.333, 1.0, 0.0])
def test_subsample_has_the_exact_size(spark, fraction):
    df = spark.range(997).withColumnRenamed("id", "client_id")
    part = V.subsample(df, "client_id", fraction, run=2)
    assert part.count() == int(fraction * 997) == part.distinct().count()


def test_components(blobs):
    m = build_matrix(blobs, SET)
    projection = V.pca_projection(m.df, 2)
    scores = projection.df.select("pc1", "pc2").toPandas().to_numpy()
    assert scores.mean(0) == pytest.approx([0, 0], abs=1e-9)
    assert np.corrcoef(scores.T)[0, 1] == pytest.approx(0, abs=1e-9)
    x = named_matrix(m).toPandas()[["p", "q", "r"]].to_numpy()
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert projection.explained == pytest.approx(list(values[:2] / values.sum()), abs=1e-9)


def test_reloaded_components_give_the_written_scores(blobs, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    m = build_matrix(blobs, SET)
    projection = V.pca_projection(m.df, 2)
    projection.model.write().overwrite().save(str(tmp_path / "pca"))
    again = PipelineModel.load(str(tmp_path / "pca")).transform(projection.df).select(
        "pc1", "pc2", vector_to_array("scores").alias("s")).collect()
    assert len(again) == 240
    assert all(r["s"] == pytest.approx([r["pc1"], r["pc2"]], abs=1e-12) for r in again)


def test_subsample_cuts_equal_hashes_by_key(spark, monkeypatch):
    monkeypatch.setattr(V, "_HASH_RANGE", 4)
    df = spark.range(100).withColumnRenamed("id", "client_id")
    assert V.subsample(df, "client_id", 0.33, run=1).count() == 33


def test_copies_do_not_take_places_of_micro_clusters(spark):
    rows = [(float(i % 5), i) for i in range(300)]
    tree = V.fit_hierarchical(spark.createDataFrame(rows, "a double, client_id int"), ["a"], 5, micro=10)
    got = tree.labels.groupBy("a").agg({"hierarchical_cluster": "max"}).collect()
    assert len({r[1] for r in got}) == 5 and tree.merges.count() == 4
