import numpy as np
import pandas as pd
import pytest

from cohortry.operators.eda import box_statistics, numeric_summary, skews
from cohortry.operators.features import add_bands
from cohortry.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


def shapes():
    rng = np.random.default_rng(7)
    return {
        "one": [3.5],
        "two": [1.0, 2.0],
        "ten": list(range(1, 11)),
        "ties": [5.0] * 400 + [1.0] * 300 + [9.0] * 300,
        "hot": [0.0] * 30000 + list(rng.normal(size=60000)),
        "heavy": list(np.exp(rng.normal(size=50000) * 5)),
        "whole": list(rng.integers(0, 50, size=20000)),
    }


@pytest.mark.parametrize("name", list(shapes()))
def test_matches_linear_interpolation(spark, name):
    values = np.array(shapes()[name], float)
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(6)
    got = {r["prob"]: r["value"] for r in exact_quantiles(df, ["x"], PROBS).collect()}
    want = dict(zip(PROBS, np.quantile(values, PROBS)))
    assert got == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_groups_columns_and_nulls(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(list("aab"), 5000), "x": rng.normal(size=5000), "y": rng.integers(0, 9, 5000)})
    df = spark.createDataFrame(pdf).selectExpr("if(g = 'b' and x > 1, null, g) g", "if(y = 3, null, x) x", "y").repartition(5)
    rows = df.toPandas().dropna(subset=["g"])
    for r in exact_quantiles(df, ["x", "y"], [0.25, 0.5], "g").collect():
        want = rows.loc[rows.g == r["g"], r["feature"]].dropna().quantile(r["prob"])
        assert r["value"] == pytest.approx(want, abs=1e-12)


def test_nothing_to_rank(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]).collect() == []
    assert exact_quantiles(df.limit(0), ["x"], [0.5]).collect() == []


def test_quartile_bands(spark):
    df = spark.createDataFrame([(i, 40, float(i)) for i in range(1, 11)], "id int, age int, total_investment double")
    got = add_bands(df).groupBy("investment_band").count().collect()
    assert {r[0]: r[1] for r in got} == {"Q1 lowest": 3, "Q2": 2, "Q3": 2, "Q4 highest": 3}


def test_equal_edges_merge(spark):
    df = spark.createDataFrame([(i, 40, 0.0 if i < 8 else 9.0) for i in range(10)], "id int, age int, total_investment double")
    assert {r[0] for r in add_bands(df).select("investment_band").distinct().collect()} == {"Q1 lowest", "Q4 highest"}


def test_summary_skew_and_boxes(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("a", 4.0)], "g string, x double")
    assert skews(df, ["x"]).first()["skew"] == pytest.approx(1.469334548, abs=1e-8)
    row = numeric_summary(df, ["x"]).first()
    assert (row["n"], row["low"], row["median"], row["high"]) == (4, 1.0, 3.0, 10.0)
    box = box_statistics(df, "x", "g").first()
    assert (box["q1"], box["q3"], box["whisker_high"], box["outliers"]) == (1.75, 5.5, 10.0, 0)
