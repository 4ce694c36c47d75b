import pytest

from cohortry.operators import selection as S


@pytest.fixture(scope="module")
def grid(spark, golden):
    rows = [
        (r["feature_set"], r["scaler"], int(r["k"]), float(r["silhouette"]), float(r["davies_bouldin"]),
         float(r["calinski_harabasz"]), int(r["min_cluster_size"]), float(r["behavioural_separation"]),
         float(r["declared_separation"]), r["viable"] == "True")
        for r in golden("3.7")
    ]
    return spark.createDataFrame(
        rows, "feature_set string, scaler string, k int, silhouette double, davies_bouldin double, "
              "calinski_harabasz double, min_cluster_size int, behavioural_separation double, "
              "declared_separation double, published boolean")


def test_gates_match_the_published_ones(grid):
    gated = S.viability(grid)
    assert gated.count() == 162
    assert gated.filter("viable <> published").count() == 0
    assert gated.filter("not actionable").count() == 0
    assert gated.filter("not substantive").count() == 80


def test_best_k_per_index(grid, golden):
    got = {(r["feature_set"], r["scaler"]): (r["k_silhouette"], r["k_davies_bouldin"], r["k_calinski_harabasz"])
           for r in S.best_k_per_index(grid).collect()}
    want = {(r["feature_set"], r["scaler"]): tuple(int(r[f"k_{i}"]) for i in ("silhouette", "davies_bouldin", "calinski_harabasz"))
            for r in golden("3.6")}
    assert got == want


def test_consensus_and_choice(grid):
    gated = S.viability(grid)
    three = S.index_consensus(gated).filter("n_indices_agreeing = 3").collect()
    assert {(r["feature_set"], r["scaler"], r["k"]) for r in three} == {
        ("behaviour_wide", "standard", 4), ("behaviour_demo", "minmax", 2)}
    best = S.select_best(gated).first()
    assert (best["feature_set"], best["scaler"], best["k"], best["n_indices_agreeing"]) == ("behaviour_wide", "standard", 4, 3)
    assert best["voted_by"] == "calinski_harabasz,davies_bouldin,silhouette"


def test_silhouette_leader(grid):
    lead = S.top_by_silhouette(S.viability(grid)).first()
    assert (lead["feature_set"], lead["scaler"], lead["k"], lead["substantive"]) == ("behaviour_demo_flags", "minmax", 6, False)


def test_no_viable_row_falls_back_to_all(grid):
    gated = S.viability(grid, min_cluster_size=10_000)
    assert gated.filter("viable").count() == 0
    assert S.rank_configurations(gated).count() == 162


def test_elbow(spark, golden):
    rows = [(int(r["k"]), float(r["inertia"])) for r in golden("3.1")]
    scan = spark.createDataFrame(rows, "k int, inertia double")
    assert S.elbow(scan).first()["elbow_k"] == 5


def test_ties_go_to_the_lowest_k(spark):
    rows = [("a", "s", k, 0.5, 1.0, 3.0) for k in (4, 2, 3)]
    grid = spark.createDataFrame(rows, "feature_set string, scaler string, k int, silhouette double, davies_bouldin double, calinski_harabasz double")
    assert S.best_k_per_index(grid).first()[2:] == (2, 2, 2)


def test_a_missing_score_has_no_vote(spark):
    rows = [("a", "s", 2, None, None, 3.0), ("a", "s", 3, 0.4, 1.0, 4.0)]
    grid = spark.createDataFrame(rows, "feature_set string, scaler string, k int, silhouette double, davies_bouldin double, calinski_harabasz double")
    assert S.best_k_per_index(grid).first()[2:] == (3, 3, 3)


def test_more_restarts_never_cost_more(spark):
    from cohortry.config import FeatureSet
    from cohortry.operators.matrix import build_matrix

    df = spark.range(300).selectExpr("id client_id", "cast((id * 7919) % 101 as double) x", "cast((id * 104729) % 89 as double) y")
    m = build_matrix(df, FeatureSet("t", ("x", "y")))
    rows = m.df.persist()
    one = S.fit_kmeans(rows, 5, n_init=1)
    six = S.fit_kmeans(rows, 5, n_init=6)
    assert six.cost <= one.cost * (1 + 1e-9)
    with pytest.raises(ValueError):
        build_matrix(df, FeatureSet("t", ("x",)), "unknown")
