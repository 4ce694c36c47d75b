import pytest

from cohortry.config import PROFILE_MEANS, PROFILE_RATES
from cohortry.operators import profiles as PR


@pytest.fixture(scope="module")
def profile(spark, golden):
    columns = ["n_clients", "pct_clients", "capital_committed", "pct_capital", "units_bought", *PROFILE_MEANS, *PROFILE_RATES]
    rows = [(int(r["cluster"]), *[float(r[c]) for c in columns]) for r in golden("3.2")]
    return spark.createDataFrame(rows, "cluster int, " + ", ".join(f"{c} double" for c in columns))


def test_names_of_four(profile, golden):
    got = {r["cluster"]: r["segment"] for r in PR.name_segments(profile).collect()}
    assert got == {int(r["cluster"]): r["segment"] for r in golden("3.2")}


def test_fallback_names(profile):
    names = {r["cluster"]: r["segment"] for r in PR.name_segments(profile.filter("cluster < 3")).collect()}
    # Ranks in thirds: capital 2 < 0 < 1, ticket 2 < 1 < 0; a third is above .33, two thirds above .66.
    assert names == {0: "High-capital premium buyers", 1: "High-capital premium buyers", 2: "Mid-capital mid-ticket buyers"}


def test_ties_in_rank_go_to_the_lowest_cluster(spark, profile):
    same = profile.selectExpr("cluster", "1.0 as total_properties", "5.0 as avg_property_price", "1.0 as total_investment")
    got = {r["cluster"]: r["segment"] for r in PR.name_segments(same).collect()}
    assert got == {0: "Portfolio Accumulators", 1: "Large-Format Premium Buyers",
                   2: "Core Multi-Unit Investors", 3: "Core Multi-Unit Investors"}


def _book(spark, golden):
    """Two rows per column with the published mean and sample deviation."""
    stats = {r["feature"]: (float(r["mean"]), float(r["std"])) for r in golden("3.3")}
    gap = 2 ** 0.5 / 2
    low = {c: m - s * gap for c, (m, s) in stats.items()}
    high = {c: m + s * gap for c, (m, s) in stats.items()}
    rest = {c: (0.0, 1.0) for c in (*PROFILE_MEANS, *PROFILE_RATES) if c not in stats}
    names = [*stats, *rest]
    return spark.createDataFrame(
        [tuple([low[c] for c in stats] + [v[0] for v in rest.values()]),
         tuple([high[c] for c in stats] + [v[1] for v in rest.values()])],
        ", ".join(f"{c} double" for c in names)), set(stats)


def test_discriminating_features(spark, profile, golden):
    book, known = _book(spark, golden)
    got = {r["feature"]: r["spread_in_sd"] for r in PR.discriminating_features(profile, book, 30).collect()}
    for r in golden("3.4"):
        if r["feature"] in known:
            assert got[r["feature"]] == pytest.approx(float(r["spread_in_sd"]), abs=1e-6)


def test_relative_profile(spark, profile, golden):
    book, known = _book(spark, golden)
    got = {r["cluster"]: r for r in PR.relative_profile(profile, book).collect()}
    assert got[0]["total_properties"] == pytest.approx(0.8240081923, abs=1e-6)
    assert got[3]["total_investment"] == pytest.approx(2.0403248022, abs=1e-6)


def test_separation_is_the_mean_of_six(golden):
    eta = {r["feature"]: float(r["eta_squared"]) for r in golden("3.5")}
    six = ("total_properties", "total_investment", "avg_property_price", "price_dispersion", "office_share", "purchase_span_days")
    assert sum(eta[c] for c in six) / 6 == pytest.approx(0.3738, abs=1e-4)


def test_constant_column_has_no_spread(spark):
    columns = [*PROFILE_MEANS, *PROFILE_RATES]
    book = spark.createDataFrame([tuple([1.0] * len(columns))] * 3, ", ".join(f"{c} double" for c in columns))
    prof = book.limit(1).selectExpr("0 as cluster", *columns)
    assert {r["spread_in_sd"] for r in PR.discriminating_features(prof, book, 50).collect()} == {None}
