"""Operators over many labels, levels and groups, and over unknown values."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.functions import parsing as P
from cohortry.operators import eda
from cohortry.operators import features as FE
from cohortry.operators import metrics as M
from cohortry.operators.quantiles import quantile_row


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_agreement_of_a_hundred_thousand_labels(spark):
    """Pairs of rows share a label on one side, on the other their neighbours do: no pair shares both."""
    n = 200_000
    df = spark.range(n).selectExpr("id div 2 as a", "(id + 1) % 200000 div 2 as b")
    row = M.compare_partitions(df, "a", "b").first()
    pairs = n * (n - 1) / 2
    s = n / 2
    want = (0 - s * s / pairs) / (s - s * s / pairs)
    assert row["adjusted_rand"] == pytest.approx(want, abs=1e-12)
    # Every label has two rows: the terms are those of one or two shared rows.
    p1 = 2 * 2 * (n - 2) / (n * (n - 1)) * 1.0
    p2 = 2 / (n * (n - 1))
    emi = (n / 2) ** 2 * (p1 / n * math.log(n / 4) + p2 * 2 / n * math.log(2 * n / 4))
    h, mi = math.log(n / 2), math.log(n / 4)
    assert row["adjusted_mutual_info"] == pytest.approx((mi - emi) / (h - emi), abs=1e-6)


def test_agreement_within_groups(spark):
    df = spark.range(400).selectExpr("id % 2 as g", "id % 5 as a", "if(id % 2 = 0, id % 5, id % 3) as b")
    got = {r["g"]: r["adjusted_rand"] for r in M.adjusted_rand(df, "a", "b", ["g"]).collect()}
    assert got[0] == pytest.approx(1.0)
    assert got[1] == pytest.approx(M.adjusted_rand(df.filter("g = 1"), "a", "b").first()[0])


def test_many_levels_are_numbered_in_order(spark):
    df = spark.range(60_000).select(F.concat(F.lit("level "), F.lpad((F.col("id") % 20_000).cast("string"), 6, "0")).alias("country"))
    df = df.unionByName(spark.createDataFrame([(None,), ("a",)], "country string"))
    codes = FE.label_codes(df, "country")
    text = plan(codes)
    assert "SinglePartition" not in text.split("Subquery")[0]
    rows = {r["country"]: r["country_code"] for r in codes.collect()}
    assert [k for k, _ in sorted(rows.items(), key=lambda x: x[1])] == sorted(rows) and sorted(rows.values()) == list(range(20_002))


def test_quartiles_of_many_groups(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 100_000, 250_000), "x": rng.normal(size=250_000).round(3)})
    pdf.loc[:60_000, "g"] = 7
    df = spark.createDataFrame(pdf)
    got = quantile_row(df, "x", (0.25, 0.5, 0.75), "g").toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["x"].quantile([0.25, 0.5, 0.75]).unstack().sort_index()
    assert len(got) == len(want) and np.allclose(got[["q0", "q1", "q2"]].to_numpy(), want.to_numpy(), atol=1e-9)
    boxes = eda.box_statistics(df, "x", "g")
    assert boxes.count() == len(want) and boxes.agg(F.sum("n")).first()[0] == len(pdf)


def test_cross_tables_have_all_cells(spark):
    df = spark.createDataFrame([("p", "x"), ("p", "x"), ("p", "y"), ("q", "y"), ("q", None), ("r", "z"), (None, "x")], "a string, b string")
    got = {(r["a"], r["b"]): (r["n"], r["share"]) for r in eda.row_shares(df, "a", "b", 2).collect()}
    assert got == {("p", "x"): (2, pytest.approx(2 / 3)), ("p", "y"): (1, pytest.approx(1 / 3)), ("q", "x"): (0, 0.0), ("q", "y"): (1, 1.0)}


def test_explained_share_skips_unknown_values(spark):
    df = spark.createDataFrame([(0, 1.0, None), (0, 3.0, None), (0, None, None), (1, 7.0, None), (2, None, None)], "l int, x double, c double")
    got = {r["feature"]: r["eta_squared"] for r in M.eta_squared(df, "l", ["x", "c"]).collect()}
    grand = 11 / 3
    want = (3 * (2 - grand) ** 2 + (7 - grand) ** 2) / sum((v - grand) ** 2 for v in (1, 3, 7))
    assert got == {"x": pytest.approx(want), "c": 0.0}


def test_correlations_over_known_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 4)) @ rng.normal(size=(4, 4)) + 1e6
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf.loc[rng.random(900) < 0.2, "a"] = np.nan
    pdf.loc[rng.random(900) < 0.3, "c"] = np.nan
    pdf["k"], pdf["n"] = 5.0, np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf.columns)).repartition(40)
    got = {(r["a"], r["b"]): r["r"] for r in eda.correlations(df, list(pdf.columns)).collect()}
    want = pdf.corr()
    for (a, b), r in got.items():
        assert r is None if "k" in (a, b) else r == pytest.approx(want.loc[a, b], abs=1e-9)
    assert len(got) == 10  # the column without values has no pair


def test_whole_numbers(spark):
    texts = ["12", " 12 ", "-3", "+4", "1e3", "2.0", "2.5", "9007199254740993", "x", "", "NaN", "1_000", "0x1f", "12.", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(P.to_whole(F.col("t"))).collect()]
    assert got == [12, 12, -3, 4, 1000, 2, None, 9007199254740993, None, None, None, None, None, 12, None]
