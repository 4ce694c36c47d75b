"""Many K-Means models in one scan, against plain numpy."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortry.operators import lloyd as L
from cohortry.operators import metrics as M
from cohortry.operators import selection as S
from cohortry.operators import validation as V


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([c + rng.normal(size=(70, 4)) for c in rng.normal(size=(6, 4)) * 6])
    pdf = pd.DataFrame(x, columns=[f"x_{i}" for i in range(4)]).assign(client_id=np.arange(len(x)), grp=np.arange(len(x)) % 3)
    return spark.createDataFrame(pdf).repartition(5), x


def plain_lloyd(x, centres, steps):
    for _ in range(steps):
        gap = ((x[:, None] - centres[None]) ** 2).sum(2)
        label = gap.argmin(1)
        new = np.array([x[label == j].mean(0) if (label == j).any() else centres[j] for j in range(len(centres))])
        for j in np.flatnonzero(np.bincount(label, minlength=len(centres)) == 0)[:1]:
            new[j] = x[gap.min(1).argmax()]
        if np.allclose(new, centres, atol=1e-12):
            break
        centres = new
    return centres


def test_every_model_takes_the_steps_of_plain_lloyd(table):
    df, x = table
    rng = np.random.default_rng(0)
    blocks = L.pack(df, ["x_0", "x_1", "x_2", "x_3"])
    views = [["x_0", "x_1", "x_2", "x_3"], ["x_2", "x_0"], ["x_1"]]
    groups, want = [], []
    for view in views:
        at = [int(c[-1]) for c in view]
        for k in (2, 5):
            starts = np.array([x[rng.choice(len(x), k, replace=False)][:, at] for _ in range(4)])
            starts[0, -1] = 1e6  # no row is near this one
            groups.append(L.Group(blocks.at(view), starts, np.full(4, -1)))
            want.append([plain_lloyd(x[:, at], c, 60) for c in starts])
    fits = L.improve(blocks, groups, 60, 1e-12)
    for fit, centres, group in zip(fits, want, groups):
        assert fit.centres == pytest.approx(np.array(centres), abs=1e-8)
        for c, cost in zip(fit.centres, fit.cost):
            assert cost == pytest.approx(((x[:, group.columns][:, None] - c[None]) ** 2).sum(2).min(1).sum())
    blocks.release()


def test_seeds_are_rows_far_from_each_other(table):
    df, x = table
    blocks = L.pack(df, ["x_0", "x_1", "x_2", "x_3"])
    seeds, = L._seeds(blocks, [np.arange(4)], np.full(30, -1), 6, np.zeros(0, np.int64), 1)
    rows = {tuple(r) for r in x}
    assert all(tuple(c) in rows for model in seeds for c in model)
    assert all(len({tuple(c) for c in model}) == 6 for model in seeds) and len({tuple(m[0]) for m in seeds}) > 20
    again, = L._seeds(blocks, [np.arange(4)], np.full(30, -1), 6, np.zeros(0, np.int64), 1)
    assert (again == seeds).all()
    blocks.release()


def test_fewer_distinct_rows_than_centres(spark):
    df = spark.createDataFrame([(float(i % 3), i) for i in range(30)], "x_0 double, client_id int")
    model = S.fit_kmeans(df, 5, n_init=2)
    assert model.cost == pytest.approx(0) and {float(c[0]) for c in model.centres} == {0.0, 1.0, 2.0}


def test_restarts_of_a_subsample_see_its_rows_only(table):
    df, x = table
    marked = V.subsample_marks(df.select("client_id", "x_0", "x_1"), "client_id", 0.3, range(60), 9)
    rows = {r.client_id: r for r in marked.collect()}
    inside = np.array([[rows[i][f"run_bits_{j // 50}"] >> (j % 50) & 1 for j in range(60)] for i in range(len(x))])
    assert (inside.sum(0) == int(0.3 * len(x))).all() and len({tuple(c) for c in inside.T}) == 60
    blocks = L.pack(marked, ["x_0", "x_1", "run_bits_0", "run_bits_1"])
    fits = L.fit_models(blocks, {"": ["x_0", "x_1"]}, [3], 2, 5, tol=1e-12, runs=range(60), bits=["run_bits_0", "run_bits_1"])["", 3]
    for i, (c, cost) in enumerate(zip(fits.centres, fits.cost)):
        part = x[inside[:, i // 2] == 1][:, :2]
        gap = ((part[:, None] - c[None]) ** 2).sum(2)
        assert cost == pytest.approx(gap.min(1).sum())
        assert c == pytest.approx(np.array([part[gap.argmin(1) == j].mean(0) for j in range(3)]), abs=1e-9)
    blocks.release()


def test_marks_of_whole_and_empty_subsamples(table):
    df, x = table
    for fraction, n in ((1.0, len(x)), (0.0, 0)):
        marked = V.subsample_marks(df.select("client_id"), "client_id", fraction, range(3))
        assert marked.filter("run_bits_0 = 7").count() == n and marked.filter("run_bits_0 = 0").count() == len(x) - n


def test_marks_cut_equal_hashes_by_key(spark, monkeypatch):
    monkeypatch.setattr(V, "_HASH_RANGE", 4)
    df = spark.range(100).withColumnRenamed("id", "client_id")
    marked = V.subsample_marks(df, "client_id", 0.33, range(4))
    assert [marked.filter(F.col("run_bits_0").bitwiseAND(1 << j) > 0).count() for j in range(4)] == [33] * 4


def test_stability_of_clear_groups_and_of_noise(spark, table):
    df, x = table
    model = S.fit_kmeans(df, 6, n_init=10).setPredictionCol("base")
    runs = V.stability_runs(model.transform(df), ["x_0", "x_1", "x_2", "x_3"], 6, "base", n_runs=55, n_init=10)
    scores = [r.adjusted_rand for r in runs.collect()]
    assert len(scores) == 55 and min(scores) > 0.9
    noise = df.withColumn("base", F.col("client_id") % 6)
    loose = V.stability_runs(noise, ["x_0", "x_1", "x_2", "x_3"], 6, "base", n_runs=3, n_init=1)
    assert max(r.adjusted_rand for r in loose.collect()) < 0.1


def test_measures_match_the_single_operators(spark, table):
    df, x = table
    columns = ["x_0", "x_1", "x_2", "x_3"]
    labelled = df.withColumns({"label_3": F.col("grp").cast("int"), "label_5": (F.col("client_id") % 4 + F.expr("if(client_id = 7, 1, 0)")).cast("int")})
    labelled = labelled.withColumn("label_9", F.when(F.col("client_id") == 11, 8).otherwise(F.col("label_3")))
    scores = {s["k"]: s for s in S.score_labelings(labelled, columns, (3, 5, 9), False)}
    exact = {s["k"]: s for s in S.score_labelings(labelled, columns, (3, 5, 9), False, "euclidean")}
    for k in (3, 5, 9):
        row = M.variance_ratio(labelled, f"label_{k}", columns).first()
        assert scores[k]["inertia"] == pytest.approx(row["inertia"])
        assert scores[k]["calinski_harabasz"] == pytest.approx(row["calinski_harabasz"])
        assert scores[k]["davies_bouldin"] == pytest.approx(M.davies_bouldin(labelled, f"label_{k}", columns).first()[0])
        sizes = M.cluster_sizes(labelled, f"label_{k}", k).first()
        assert (scores[k]["min_cluster_size"], scores[k]["min_cluster_pct"]) == (sizes[0], pytest.approx(sizes[1]))
        vectors = labelled.withColumn("features", array_to_vector(F.array(*columns)))
        assert scores[k]["silhouette"] == pytest.approx(M.squared_silhouette(vectors, f"label_{k}"), abs=1e-9)
        want = M.silhouette_score(labelled, columns, {f"label_{k}": k}).first()["silhouette"]
        assert exact[k]["silhouette"] == pytest.approx(want)
    assert isinstance(ClusteringEvaluator(), ClusteringEvaluator)


def test_substance_matches_the_single_operators(spark):
    columns = S._SUBSTANCE
    df = spark.range(200).selectExpr("id client_id", "cast(id % 4 as int) label_4", "cast(id * 0.5 as double) x_0", *[
        f"cast(id * {i + 3} % 7 > 2 as int) as {c}" if c in S.BUYER_FLAGS else f"cast(1e6 + (id * {i + 1}) % 11 as double) as {c}"
        for i, c in enumerate(columns)])
    score, = S.score_labelings(df, ["x_0"], (4,), True)
    row = M.separation(df, "label_4").first()
    assert score["behavioural_separation"] == pytest.approx(row["behavioural_separation"])
    assert score["declared_separation"] == pytest.approx(row["declared_separation"])
    assert score["flag_redundancy"] == pytest.approx(M.flag_redundancy(df, "label_4").first()[0])


def test_a_saved_clustering_gives_the_same_labels(table, tmp_path):
    df, x = table
    model = S.fit_kmeans(df, 4, n_init=3).setPredictionCol("cluster")
    want = ((x[:, None] - model.centres[None]) ** 2).sum(2).argmin(1)
    PipelineModel([model.transformer()]).write().overwrite().save(str(tmp_path / "m"))
    for out in (model.transform(df), PipelineModel.load(str(tmp_path / "m")).transform(df)):
        assert out.columns == [*df.columns, "cluster"]
        assert {r.client_id: r.cluster for r in out.collect()} == dict(enumerate(want))
    near = df.withColumn("cluster", L.nearest_label(model.centres)(F.array("x_0", "x_1", "x_2", "x_3")))
    assert {r.client_id: r.cluster for r in near.collect()} == dict(enumerate(want))


def test_results_of_many_partitions_merge(table, monkeypatch):
    df, x = table
    whole = S.fit_kmeans(df, 3, n_init=2)
    monkeypatch.setattr(L, "_FAN_IN", 2)
    parts = S.fit_kmeans(df, 3, n_init=2)
    assert parts.centres == pytest.approx(whole.centres) and parts.cost == pytest.approx(whole.cost)


def test_a_pass_works_in_tiles_of_a_cache():
    import tracemalloc

    rng = np.random.default_rng(3)
    n, m, k, d = 4096, 1000, 4, 3
    x = np.round(rng.normal(size=(n, d)), 2)
    x = np.concatenate([x, rng.integers(0, 1 << 50, size=(n, 2)).astype(float)], axis=1)
    centres, runs, bits = x[rng.integers(0, n, size=(m, k)), :d], np.repeat(np.arange(100), 10), np.array([d, d + 1])
    group, shape = L.Group(np.arange(d), centres, runs), L._Shape(m * k * (d + 1) + m, m, d)
    out = shape.empty()
    tracemalloc.start()
    L._lloyd_work(x, ([group], [shape], bits), [out])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # all distances are 131 MB
    sums, counts = out[:m * k * d].reshape(m, k, d), out[m * k * d:m * k * (d + 1)].reshape(m, k)
    cost, far = out[m * k * (d + 1):shape.sums], out[shape.sums + m:].reshape(m, d)
    for i in (0, 371, 999):
        run = runs[i]
        mine = x[x[:, bits[run // 50]].astype(np.int64) >> (run % 50) & 1 == 1][:, :d]
        gap = ((mine[:, None] - centres[i][None]) ** 2).sum(axis=2)
        label = gap.argmin(axis=1)
        assert counts[i].tolist() == np.bincount(label, minlength=k).tolist()
        assert np.allclose(sums[i], [mine[label == j].sum(axis=0) for j in range(k)])
        assert np.isclose(cost[i], gap.min(axis=1).sum())
        assert np.allclose(far[i], mine[gap.min(axis=1).argmax()])


def test_groups_of_one_matrix_share_their_rows_and_draws(monkeypatch):
    """Rows are taken out and draws made once for all groups, with the results of a group alone."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 6))
    x[1500:] = x[:1500]  # equal rows, and below centres that are equally near
    bits, views, runs = np.zeros(0, np.int64), [np.arange(4), np.array([5, 2])], np.full(7, -1)
    centres = {(i, k): x[rng.integers(0, 1500, (7, k))][:, :, v] for i, v in enumerate(views) for k in (2, 3, 5)}
    for c in centres.values():
        c[:, 1] = c[:, 0]
    groups = [L.Group(views[i], c, runs) for (i, _), c in centres.items()]
    calls = {"_widened": 0, "_mixed": 0}
    for name in calls:
        def counted(*args, name=name, whole=getattr(L, name)):
            calls[name] += 1
            return whole(*args)
        monkeypatch.setattr(L, name, counted)

    def run(work, groups, shapes, *more):
        out = [s.empty() for s in shapes]
        before = dict(calls)
        work(x, (groups, shapes, bits, *more), out)
        return out, {k: calls[k] - before[k] for k in calls}

    shapes = [L._Shape(g.centres.size + g.centres[:, :, 0].size + 7, 7, len(g.columns)) for g in groups]
    together, used = run(L._lloyd_work, groups, shapes)
    assert used["_widened"] == 2
    for g, shape, got in zip(groups, shapes, together):
        assert (run(L._lloyd_work, [g], [shape])[0][0] == got).all()
        label = ((x[:, g.columns][:, None, None] - g.centres) ** 2).sum(3).argmin(2)
        counts = got[g.centres.size:g.centres.size + 7 * g.centres.shape[1]].reshape(7, -1)
        assert (counts[:, 1] == 0).all() and (counts == [np.bincount(a, minlength=g.centres.shape[1]) for a in label.T]).all()
    shapes = [L._Shape(0, 7, len(g.columns)) for g in groups]
    together, used = run(L._seed_work, groups, shapes, 3, 2)
    assert used["_mixed"] <= x.shape[1] + 1 + 3  # the rows' names, the models' salt, and a draw for each tile
    for g, shape, got in zip(groups, shapes, together):
        assert (run(L._seed_work, [g], [shape], 3, 2)[0][0] == got).all()
