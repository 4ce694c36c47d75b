import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.functions.stats import ln_factorial, student_t_p
from cohortry.operators import metrics as M


def points(n=400, d=3, k=4, seed=3, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(3)
    label = rng.integers(0, k, n)
    if copies:
        x[:copies], label[:copies] = x[0], label[0]
    return pd.DataFrame(x, columns=[f"x{i}" for i in range(d)]).assign(label=label, id=np.arange(n))


def brute_silhouette(pdf, columns):
    x, label = pdf[columns].to_numpy(), pdf["label"].to_numpy()
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = dist[i, own].sum() / (own.sum() - 1)
        b = min(dist[i, label == c].mean() for c in set(label) if c != label[i])
        out.append((b - a) / max(a, b))
    return np.array(out)


@pytest.mark.parametrize("copies, block", [(0, 2048), (150, 64), (0, 50)])
def test_silhouette_against_all_pairs(spark, copies, block):
    pdf = points(copies=copies)
    pdf.loc[len(pdf)] = [9.0, 9.0, 9.0, 4, 999]
    pdf["label"] = pdf["label"].astype(int)
    columns = ["x0", "x1", "x2"]
    df = spark.createDataFrame(pdf)
    got = M.silhouette_points(df, columns, {"label": 5}, block).groupBy("label").agg(
        (F.sum(F.col("silhouette") * F.col("w"))).alias("s"), F.sum("w").alias("n")).collect()
    want = pd.Series(brute_silhouette(pdf, columns)).groupby(pdf["label"].to_numpy()).agg(["sum", "size"])
    assert {r["label"]: r["n"] for r in got} == want["size"].to_dict()
    assert {r["label"]: r["s"] for r in got} == pytest.approx(want["sum"].to_dict(), abs=1e-9)


def test_validity_against_numpy(spark):
    pdf = points()
    columns = ["x0", "x1", "x2"]
    df = spark.createDataFrame(pdf)
    x, label = pdf[columns].to_numpy(), pdf["label"].to_numpy()
    k, n = 4, len(x)
    centres = np.array([x[label == c].mean(0) for c in range(k)])
    ssw = ((x - centres[label]) ** 2).sum()
    ssb = sum((label == c).sum() * ((centres[c] - x.mean(0)) ** 2).sum() for c in range(k))
    row = M.variance_ratio(df, "label", columns).first()
    assert row["inertia"] == pytest.approx(ssw)
    assert row["calinski_harabasz"] == pytest.approx((ssb / (k - 1)) / (ssw / (n - k)))
    s = np.array([np.linalg.norm(x[label == c] - centres[c], axis=1).mean() for c in range(k)])
    gap = np.linalg.norm(centres[:, None] - centres[None], axis=2) + np.diag([np.inf] * k)
    want = ((s[:, None] + s[None]) / gap).max(1).mean()
    assert M.davies_bouldin(df, "label", columns).first()[0] == pytest.approx(want)


def test_published_variance_ratio_identity(golden):
    for r in golden("3.1"):
        k, w = int(r["k"]), float(r["inertia"])
        assert ((20000 - w) / (k - 1)) / (w / (2000 - k)) == pytest.approx(float(r["calinski_harabasz"]), abs=0.01)


def test_several_labelings_in_one_pass(spark):
    pdf = points().assign(b=lambda d: d["id"] % 3)
    df = spark.createDataFrame(pdf)
    columns = ["x0", "x1", "x2"]
    stacked = M.stack_labels(df.withColumnRenamed("label", "a"), {1: "a", 2: "b"}, "which")
    both = {r["which"]: r["inertia"] for r in M.variance_ratio(stacked, "label", columns, ["which"]).collect()}
    assert both[1] == pytest.approx(M.variance_ratio(df, "label", columns).first()["inertia"])
    assert both[2] == pytest.approx(M.variance_ratio(df, "b", columns).first()["inertia"])


def test_eta_squared(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (0, 3.0, 5.0), (1, 7.0, 5.0)], "l int, x double, c double")
    got = {r["feature"]: r["eta_squared"] for r in M.eta_squared(df, "l", ["x", "c"]).collect()}
    grand = 11 / 3
    want = (2 * (2 - grand) ** 2 + (7 - grand) ** 2) / sum((v - grand) ** 2 for v in (1, 3, 7))
    assert got == {"x": pytest.approx(want), "c": 0.0}


def test_agreement(spark):
    same = spark.createDataFrame([(i % 3, (i % 3 + 1) % 3, i % 2, 0) for i in range(60)], "a int, b int, c int, one int")
    assert M.compare_partitions(same, "a", "b").first()[:] == (pytest.approx(1.0), pytest.approx(1.0))
    mixed = M.compare_partitions(same, "a", "c").first()
    assert abs(mixed["adjusted_rand"]) < 0.05 and abs(mixed["adjusted_mutual_info"]) < 0.05
    assert M.adjusted_rand(same, "one", "one").first()[0] == 1.0


def test_mutual_information_value(spark):
    # Labels (0,0,1,1) and (0,0,1,2) worked by hand from the definition.
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 2)], "a int, b int")
    n, ai, bj = 4, [2, 2], [2, 1, 1]
    emi = 0.0
    for a in ai:
        for b in bj:
            for m in range(max(1, a + b - n), min(a, b) + 1):
                p = math.comb(b, m) * math.comb(n - b, a - m) / math.comb(n, a)
                emi += m / n * math.log(n * m / (a * b)) * p
    mi, ha = math.log(2), math.log(2)
    hb = -(0.5 * math.log(0.5) + 2 * 0.25 * math.log(0.25))
    got = M.compare_partitions(df, "a", "b").first()["adjusted_mutual_info"]
    assert got == pytest.approx((mi - emi) / ((ha + hb) / 2 - emi), abs=1e-9)


def test_chunked_terms_give_the_same(spark, monkeypatch):
    df = spark.range(500).selectExpr("id % 3 as a", "(id * 7) % 4 + id % 2 as b")
    whole = M.compare_partitions(df, "a", "b").first()["adjusted_mutual_info"]
    monkeypatch.setattr(M, "_TERMS_PER_ROW", 7)
    assert M.compare_partitions(df, "a", "b").first()["adjusted_mutual_info"] == pytest.approx(whole, abs=1e-12)


def test_empty_cluster_counts_as_zero(spark):
    df = spark.createDataFrame([(0,), (0,), (2,)], "l int")
    assert M.cluster_sizes(df, "l", 3).first()["min_cluster_size"] == 0
    assert M.cluster_sizes(df, "l", 2).first()["min_cluster_size"] == 1


def test_flag_redundancy_of_the_flags(spark):
    df = spark.range(64).selectExpr("id % 2 is_company", "id div 2 % 2 loan_flag", "id div 4 % 2 is_investment", "id div 8 % 2 is_domestic", "id % 16 label")
    assert M.flag_redundancy(df, "label").first()[0] == pytest.approx(1.0)


def test_ln_factorial(spark):
    rows = spark.range(200).select(ln_factorial(F.col("id"))).collect()
    assert [r[0] for r in rows] == pytest.approx([math.lgamma(i + 1) for i in range(200)], abs=1e-9)


def test_student_t(spark):
    rows = spark.createDataFrame([(0.0, 5.0), (2.0, 10.0), (-2.0, 10.0), (1.0, 1.0), (12.706204736, 1.0), (1.959963985, 1e7)], "t double, df double")
    got = [r[0] for r in rows.select(student_t_p(F.col("t"), F.col("df"))).collect()]
    assert got == pytest.approx([1.0, 0.0733880348, 0.0733880348, 0.5, 0.05, 0.05], abs=1e-7)


def test_welch_returns_attributes_with_other_level_counts(spark):
    from cohortry.operators import eda

    df = spark.createDataFrame([(c, d, "x", float(i)) for i, (c, d) in enumerate(zip("aabbcc", "pqpqpq"))],
                               "three string, two string, one string, y double")
    got = {r["attribute"]: r for r in eda.welch_tests(df, ["three", "two", "one"], "y").collect()}
    assert {a: r["levels"] for a, r in got.items()} == {"three": 3, "two": 2, "one": 1}
    assert got["three"]["t"] is None and got["one"]["p"] is None and got["two"]["t"] is not None


def test_distance_sums_take_products_and_stay_exact():
    import time

    rng = np.random.default_rng(5)

    def block(home, n, d, k):
        # Two tight groups far from zero, with equal and nearly equal points.
        x = rng.normal(size=(n, d)) * 1e-6 + 1000 + rng.integers(0, 2, size=(n, 1))
        x[: n // 8] = x[n // 8: 2 * (n // 8)]
        label, w = rng.integers(0, k, n), rng.integers(1, 4, n)
        return x, label, w, pd.DataFrame({"home": [home], "x": [x.astype("<f8").tobytes()], "l": [label.astype("<i4").tobytes()],
                                          "w": [w.astype("<i8").tobytes()]})

    a, b = block(0, 300, 5, 3), block(1, 290, 5, 3)
    for key, left, right in (((0, 1), a, b), ((0, 0), a, a)):
        got = M._distance_sums(5, [3])(key, left[3], right[3])
        gap = np.sqrt(((left[0][:, None] - right[0][None]) ** 2).sum(axis=2))
        want = gap @ (np.eye(3)[right[1]] * right[2][:, None])
        assert np.allclose(got[got.home == 0][["s_0", "s_1", "s_2"]].to_numpy()[:300], want, rtol=1e-9, atol=0)
    x = rng.normal(size=(2048, 64))
    whole = pd.DataFrame({"home": [0], "x": [x.tobytes()], "l": [rng.integers(0, 10, 2048).astype("<i4").tobytes()],
                          "w": [np.ones(2048, "<i8").tobytes()]})
    start = time.thread_time()
    M._distance_sums(64, [10])((0, 1), whole, whole)
    assert (time.thread_time() - start) / 2048 ** 2 < 60e-9  # 186 ns a pair column by column, 5 as products
