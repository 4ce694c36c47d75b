"""Client profiles, exploratory tables and segment profiles."""
from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.config import CODED, CORRELATED, DISTRIBUTIONS, FEATURE_SETS, FINGERPRINT
from cohortry.operators import eda
from cohortry.operators import features as FE
from cohortry.operators import profiles as PR
from cohortry.plans.registry import (
    BEHAVIOUR, CLUSTERED, FEATURES, LEDGER, PROFILE, REGISTER, SEGMENTED, clustered, features,
    query, rnd, rounded, segmented,
)
from cohortry.sources import views as V

_MONEY = ("total_investment avg_property_price max_property_price min_property_price "
          "avg_floor_area total_area avg_price_per_sqft")
# Means of cents by a count divisible by 8 end in a 5, so they are compared at six places.
_PLACES = {**{c: 6 for c in _MONEY.split()}, "price_dispersion": 5}
_RATIOS = "apartment_share office_share tower_diversity purchase_intensity"


# --- profiles -----------------------------------------------------------------
@query("sold_listings", "WITH " + LEDGER + """
SELECT listing_id, client_ref, sale_price FROM ledger
WHERE listing_status = 'Sold' AND client_ref IS NOT NULL""")
def sold_listings(spark, sf_dir):
    return FE.sold_listings(V.ledger(spark, sf_dir)).select("listing_id", "client_ref", "sale_price")


@query("client_purchases", "WITH " + BEHAVIOUR + f"""
SELECT client_id, total_properties, {rnd(_MONEY, 6)}, {rnd("price_dispersion", 5)}, unique_towers, first_purchase, last_purchase,
  active_months, apartment_count, office_count,
  CAST(apartment_count AS DOUBLE) / total_properties AS apartment_share,
  CAST(office_count AS DOUBLE) / total_properties AS office_share,
  CAST(last_purchase - first_purchase AS INTEGER) AS purchase_span_days,
  CAST(unique_towers AS DOUBLE) / total_properties AS tower_diversity,
  CAST(total_properties AS DOUBLE) / active_months AS purchase_intensity
FROM behaviour""")
def client_purchases(spark, sf_dir):
    return rounded(FE.aggregate_purchases(V.ledger(spark, sf_dir)),
                   {**_PLACES, **{c: 17 for c in _RATIOS.split()}})


@query("client_features", "WITH " + FEATURES + f"""
SELECT client_id, full_name, client_type, gender, country, region, date_of_birth, age,
  acquisition_purpose, satisfaction_score, loan_applied, referral_channel, loan_flag, is_investment,
  is_company, total_properties, {rnd(_MONEY, 6)}, {rnd("price_dispersion", 5)}, unique_towers, first_purchase, last_purchase,
  active_months, apartment_count, office_count, {rnd(_RATIOS, 8)}, purchase_span_days, is_domestic,
  has_purchase, age_band, age_band_order, investment_band_order, investment_band
FROM features""")
def client_features(spark, sf_dir):
    return rounded(features(spark, sf_dir),
                   {**_PLACES, **{c: 8 for c in _RATIOS.split()}})


@query("single_month_purchases", "WITH " + LEDGER + """
SELECT transaction_date, client_ref AS client_id, CAST(count(*) AS INTEGER) AS total_properties,
  round(sum(sale_price), 6) + 0.0 AS total_investment,
  round(coalesce(stddev_samp(sale_price), 0), 6) + 0.0 AS price_dispersion
FROM ledger WHERE listing_status = 'Sold' GROUP BY 1, 2""")
def single_month_purchases(spark, sf_dir):
    """Every month by client: most have a single purchase in it, so a deviation of 0."""
    book = V.ledger(spark, sf_dir).withColumn("client_ref", F.struct("transaction_date", "client_ref"))
    return rounded(FE.aggregate_purchases(book).select(
        "client_id.transaction_date", F.col("client_id.client_ref").alias("client_id"), "total_properties",
        "total_investment", "price_dispersion").filter("client_id IS NOT NULL"), 6)


@query("label_codes", "WITH " + REGISTER + """
SELECT client_id, CAST(dense_rank() OVER (ORDER BY country) - 1 AS INTEGER) AS country_code,
  CAST(dense_rank() OVER (ORDER BY region) - 1 AS INTEGER) AS region_code,
  CAST(dense_rank() OVER (ORDER BY referral_channel) - 1 AS INTEGER) AS referral_channel_code
FROM register""")
def label_codes(spark, sf_dir):
    return FE.label_encode(V.register(spark, sf_dir), CODED).select(
        "client_id", *[f"{c}_code" for c in CODED]
    )


@query("reconciliation", "WITH " + LEDGER + """
, s AS (SELECT CAST(count(*) AS DOUBLE) AS n, round(sum(sale_price), 2) AS c FROM ledger WHERE listing_status = 'Sold')
SELECT 'units' AS measure, n AS profile, n AS ledger, 0.0::DOUBLE AS difference FROM s
UNION ALL SELECT 'capital', c, c, 0.0 FROM s""")
def reconciliation(spark, sf_dir):
    return rounded(FE.reconcile(features(spark, sf_dir), V.ledger(spark, sf_dir)), 2)


# --- exploratory tables ---------------------------------------------------------
@query("frequencies", "WITH " + FEATURES + """
SELECT 'client_type' AS attribute, client_type AS level, count(*) AS n FROM features GROUP BY 2
UNION ALL SELECT 'gender', gender, count(*) FROM features GROUP BY 2
UNION ALL SELECT 'referral_channel', referral_channel, count(*) FROM features GROUP BY 2
UNION ALL SELECT 'country', country, count(*) FROM features GROUP BY 2
UNION ALL SELECT 'acquisition_purpose', acquisition_purpose, count(*) FROM features GROUP BY 2
UNION ALL SELECT 'loan_applied', loan_applied, count(*) FROM features GROUP BY 2
UNION ALL SELECT 'satisfaction_score', CAST(satisfaction_score AS VARCHAR), count(*) FROM features GROUP BY 2
UNION ALL SELECT 'total_properties', CAST(total_properties AS VARCHAR), count(*) FROM features GROUP BY 2""")
def frequencies(spark, sf_dir):
    return eda.frequencies(features(spark, sf_dir), (
        "client_type", "gender", "referral_channel", "country", "acquisition_purpose",
        "loan_applied", "satisfaction_score", "total_properties",
    ))


@query("inventory_counts", "WITH " + LEDGER + """
SELECT unit_category AS level, count(*) AS n FROM ledger GROUP BY 1""")
def inventory_counts(spark, sf_dir):
    return eda.frequency(V.ledger(spark, sf_dir), "unit_category")


@query("largest_countries", "WITH " + REGISTER + """
SELECT country AS level, count(*) AS n FROM register GROUP BY 1 ORDER BY n DESC, level LIMIT 12""")
def largest_countries(spark, sf_dir):
    return eda.top_levels(V.register(spark, sf_dir), "country", 12)


@query("age_histogram", "WITH " + REGISTER + """
SELECT CAST(b AS INTEGER) AS bin, CAST(20 + 5 * b AS DOUBLE) AS from_value, count(age) AS n
FROM range(15) t(b) LEFT JOIN register ON age BETWEEN 20 AND 95 AND least(floor((age - 20) / 5.0), 14) = b
GROUP BY b""")
def age_histogram(spark, sf_dir):
    return eda.fixed_histogram(V.register(spark, sf_dir), "age", 20, 95, 5)


@query("price_histogram", "WITH " + LEDGER + """
, e AS (SELECT min(sale_price) AS lo, max(sale_price) AS hi FROM ledger)
SELECT CAST(b AS INTEGER) AS bin, count(p) AS n
FROM range(45) t(b) LEFT JOIN (
  SELECT least(floor((sale_price - lo) * 45 / (hi - lo)), 44) AS p FROM ledger, e) ON p = b GROUP BY b""")
def price_histogram(spark, sf_dir):
    return eda.equal_histogram(V.ledger(spark, sf_dir), "sale_price", 45)


def _summary_sql(columns, source):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 4) + 0.0 AS mean, "
        f"round(stddev_samp({c}), 4) + 0.0 AS sd, round(min({c}), 4) + 0.0 AS low, "
        f"round(quantile_cont({c}, 0.25), 4) + 0.0 AS q1, round(quantile_cont({c}, 0.5), 4) + 0.0 AS median, "
        f"round(quantile_cont({c}, 0.75), 4) + 0.0 AS q3, round(max({c}), 4) + 0.0 AS high FROM {source}"
        for c in (f"CAST({c} AS DOUBLE)" for c in columns)
    ).replace("'CAST(", "'").replace(" AS DOUBLE)'", "'")


@query("numeric_summary", "WITH " + FEATURES + _summary_sql(CORRELATED, "features"))
def numeric_summary(spark, sf_dir):
    return rounded(eda.numeric_summary(features(spark, sf_dir), CORRELATED))


def _pairs_sql(columns, source):
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {source}" for a, b in pairs)


@query("correlation_matrix", "WITH " + FEATURES + ", p AS (" + _pairs_sql(CORRELATED, "features") + """)
SELECT a, b, round_even(r, 3) + 0.0 AS r FROM p UNION ALL SELECT b, a, round_even(r, 3) + 0.0 FROM p
UNION ALL SELECT c, c, 1.0 FROM (VALUES """ + ", ".join(f"('{c}')" for c in CORRELATED) + ") t(c)")
def correlation_matrix(spark, sf_dir):
    table = eda.correlation_matrix(features(spark, sf_dir), CORRELATED)
    return table.withColumn("r", F.bround("r", 3) + F.lit(0.0))


@query("strong_pairs", "WITH " + FEATURES + ", p AS (" + _pairs_sql(DISTRIBUTIONS, "features") + """)
SELECT a, b, round(r, 6) + 0.0 AS r FROM p WHERE abs(r) >= 0.75""")
def strong_pairs(spark, sf_dir):
    return rounded(eda.strong_pairs(features(spark, sf_dir), DISTRIBUTIONS), 6)


@query("outcome_correlations", "WITH " + FEATURES + """
SELECT 'age' AS feature, round(corr(age, total_investment), 6) + 0.0 AS r FROM features
UNION ALL SELECT 'satisfaction_score', round(corr(satisfaction_score, total_investment), 6) + 0.0 FROM features""")
def outcome_correlations(spark, sf_dir):
    return rounded(eda.outcome_correlations(
        features(spark, sf_dir), ("age", "satisfaction_score"), "total_investment"), 6)


@query("price_centre", "WITH " + LEDGER + """
SELECT round(avg(sale_price), 4) + 0.0 AS mean, round(quantile_cont(sale_price, 0.5), 4) + 0.0 AS median FROM ledger""")
def price_centre(spark, sf_dir):
    return rounded(eda.centre_marks(V.ledger(spark, sf_dir), "sale_price"))


@query("variation_coefficients", "WITH " + FEATURES + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(abs(stddev_samp({c}) / nullif(avg({c}), 0)), 8) + 0.0 AS cv FROM features"
    for c in DISTRIBUTIONS))
def variation_coefficients(spark, sf_dir):
    return rounded(eda.variations(features(spark, sf_dir), DISTRIBUTIONS), 8)


@query("skewness", "WITH " + FEATURES + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(skewness({c}), 6) + 0.0 AS skew FROM features" for c in DISTRIBUTIONS))
def skewness(spark, sf_dir):
    return rounded(eda.skews(features(spark, sf_dir), DISTRIBUTIONS), 6)


@query("monthly_sales", "WITH " + LEDGER + """
SELECT transaction_date AS month, count(*) AS sales FROM ledger WHERE listing_status = 'Sold' GROUP BY 1""")
def monthly_sales(spark, sf_dir):
    return eda.monthly_sales(V.ledger(spark, sf_dir))


@query("price_boxes", "WITH " + LEDGER + """
, q AS (SELECT unit_category AS g, quantile_cont(sale_price, 0.25) AS q1, quantile_cont(sale_price, 0.5) AS median,
          quantile_cont(sale_price, 0.75) AS q3 FROM ledger GROUP BY 1),
m AS (SELECT *, sale_price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM ledger JOIN q ON unit_category = g)
SELECT unit_category, count(*) AS n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
  min(sale_price) FILTER (inside) AS whisker_low, max(sale_price) FILTER (inside) AS whisker_high,
  count(*) FILTER (NOT inside) AS outliers
FROM m GROUP BY unit_category, q1, median, q3""")
def price_boxes(spark, sf_dir):
    return rounded(eda.box_statistics(V.ledger(spark, sf_dir), "sale_price", "unit_category"))


@query("outcome_by_attributes", "WITH " + FEATURES + "".join(
    f"SELECT '{c}' AS attribute, {c} AS level, count(*) AS n, round(avg(total_investment), 4) + 0.0 AS mean_outcome "
    f"FROM features WHERE {c} IS NOT NULL GROUP BY {c} UNION ALL "
    for c in ("client_type", "acquisition_purpose", "loan_applied", "age_band")
) + "SELECT 'overall', 'all', count(*), round(avg(total_investment), 4) + 0.0 FROM features")
def outcome_by_attributes(spark, sf_dir):
    return rounded(eda.outcome_by_attributes(
        features(spark, sf_dir), ("client_type", "acquisition_purpose", "loan_applied", "age_band"),
        "total_investment"))


_WELCH = ("client_type", "acquisition_purpose", "loan_applied")


_WELCH_SQL = "WITH " + FEATURES + ", g AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS attribute, {c} AS level, count(*) AS n, avg(total_investment) AS m, "
    f"var_samp(total_investment) AS v FROM features GROUP BY {c}" for c in _WELCH
) + """), s AS (SELECT a.attribute, a.level AS level_1, b.level AS level_2, a.n AS n_1, b.n AS n_2,
  a.m - b.m AS gap, a.v AS v1, b.v AS v2 FROM g a JOIN g b ON a.attribute = b.attribute AND a.level < b.level),
w AS (SELECT *, gap / sqrt(v1 / n_1 + v2 / n_2) AS t,
  (v1 / n_1 + v2 / n_2) ^ 2 / ((v1 / n_1) ^ 2 / (n_1 - 1) + (v2 / n_2) ^ 2 / (n_2 - 1)) AS df FROM s)
"""


@query("welch_tests", _WELCH_SQL + """
SELECT attribute, level_1, level_2, n_1, n_2, round(t, 6) + 0.0 AS t, round(df, 4) + 0.0 AS df,
  round(gap / sqrt(((n_1 - 1) * v1 + (n_2 - 1) * v2) / (n_1 + n_2 - 2)), 6) + 0.0 AS cohens_d FROM w""")
def welch_tests(spark, sf_dir):
    """Without p, which has a query of its own."""
    table = eda.welch_tests(features(spark, sf_dir), _WELCH, "total_investment").drop("p", "levels")
    return rounded(table, {"t": 6, "df": 4, "cohens_d": 6})


@query("welch_p_values", _WELCH_SQL + """,
-- The Student density between -|t| and |t| by Simpson's rule.
u AS (SELECT attribute, df, abs(t) AS t, unnest(range(4001)) AS i FROM w)
SELECT attribute, round(1 - 2 * max(t) / 4000 / 3 * max(exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()))
  * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * power(1 + power(t * i / 4000, 2) / df, -(df + 1) / 2)), 8) + 0.0 AS p
FROM u GROUP BY attribute""")
def welch_p_values(spark, sf_dir):
    return rounded(eda.welch_tests(features(spark, sf_dir), _WELCH, "total_investment").select("attribute", "p"), 8)


# --- segment profiles -----------------------------------------------------------
_AVGS = ("total_properties total_investment avg_property_price max_property_price price_dispersion "
         "avg_floor_area total_area avg_price_per_sqft unique_towers active_months purchase_span_days "
         "office_share apartment_share age satisfaction_score loan_flag is_investment is_company is_domestic")


@query("segment_profile", "WITH " + PROFILE + f"""
SELECT cluster, n_clients, round(pct_clients, 8) + 0.0 AS pct_clients,
  round(capital_committed, 2) + 0.0 AS capital_committed, round(pct_capital, 8) + 0.0 AS pct_capital,
  units_bought, {rnd(_AVGS, 5)} FROM profile""")
def segment_profile(spark, sf_dir):
    return rounded(PR.build_profile(clustered(spark, sf_dir)), {
        "pct_clients": 8, "pct_capital": 8, "capital_committed": 2, **{c: 5 for c in _AVGS.split()}})


@query("segment_names", "WITH " + PROFILE + " SELECT cluster, segment FROM names")
def segment_names(spark, sf_dir):
    return PR.name_segments(PR.build_profile(clustered(spark, sf_dir)))


@query("fallback_names", "WITH " + CLUSTERED + """
, p AS (SELECT age_band_order AS band, avg(total_investment) AS a, avg(avg_property_price) AS b
        FROM clustered GROUP BY 1),
r AS (SELECT x.band, (SELECT (count(*) FILTER (y.a < x.a) + (count(*) FILTER (y.a = x.a) + 1) / 2.0) / count(*) FROM p y) AS cap,
             (SELECT (count(*) FILTER (y.b < x.b) + (count(*) FILTER (y.b = x.b) + 1) / 2.0) / count(*) FROM p y) AS tic
      FROM p x)
SELECT band, CASE WHEN cap > 0.66 THEN 'High' WHEN cap > 0.33 THEN 'Mid' ELSE 'Low' END || '-capital '
  || CASE WHEN tic > 0.66 THEN 'premium' WHEN tic > 0.33 THEN 'mid-ticket' ELSE 'value' END || ' buyers' AS segment
FROM r""")
def fallback_names(spark, sf_dir):
    """Five age bands as labels, so the general names apply."""
    rows = clustered(spark, sf_dir).withColumn("band", F.col("age_band_order"))
    return PR.name_segments(PR.build_profile(rows, "band"), "band")


@query("segmented_clients", "WITH " + SEGMENTED + "SELECT client_id, cluster, segment FROM segmented")
def segmented_clients(spark, sf_dir):
    return segmented(spark, sf_dir).select("client_id", "cluster", "segment")


_RATIO = ", o AS (SELECT " + ", ".join(f"avg({c}) AS o_{c}" for c in _AVGS.split()) + " FROM clustered)"


@query("described_segments", "WITH " + PROFILE + _RATIO + ", r AS (" + " UNION ALL ".join(
    f"SELECT cluster, {c} / nullif(o_{c}, 0) AS x, '{c}' AS m FROM profile, o" for c in _AVGS.split()) + """),
s AS (SELECT cluster, arg_max(m, (x, m)) AS hi, arg_min(m, (x, m)) AS lo FROM r WHERE x IS NOT NULL GROUP BY cluster)
SELECT cluster, segment, n_clients, round(capital_committed, 2) + 0.0 AS capital_committed,
  'highest ' || hi || ', lowest ' || lo AS signal
FROM profile JOIN names USING (cluster) JOIN s USING (cluster)""")
def described_segments(spark, sf_dir):
    """Segment sizes, and what tells each from the book."""
    profile = PR.attach_segments(clustered(spark, sf_dir))[1]
    return rounded(profile.select(
        "cluster", "segment", "n_clients", "capital_committed", "signal"
    ).orderBy("n_clients", "cluster"), 2)


@query("relative_profile", "WITH " + PROFILE + _RATIO + " SELECT cluster, segment, " + ", ".join(
    f"round({c} / nullif(o_{c}, 0), 8) + 0.0 AS {c}" for c in _AVGS.split()) + " FROM profile JOIN names USING (cluster), o")
def relative_profile(spark, sf_dir):
    rows = clustered(spark, sf_dir)
    return rounded(PR.relative_profile(PR.attach_segments(rows)[1], rows), 8)


@query("segment_fingerprint", "WITH " + PROFILE + ", o AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in FINGERPRINT) + " FROM clustered) " + " UNION ALL ".join(
    f"SELECT cluster, '{c}' AS feature, round(({c} - m_{c}) / nullif(s_{c}, 0), 6) + 0.0 AS z FROM profile, o"
    for c in FINGERPRINT))
def segment_fingerprint(spark, sf_dir):
    rows = clustered(spark, sf_dir)
    return rounded(PR.fingerprint(PR.build_profile(rows), rows), 6)


@query("discriminating_features", "WITH " + PROFILE + ", d AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (SELECT max({c}) - min({c}) FROM profile) / nullif((SELECT stddev_samp({c}) FROM clustered), 0) AS s"
    for c in _AVGS.split()) + """)
SELECT feature, round(s, 6) + 0.0 AS spread_in_sd FROM d ORDER BY s DESC NULLS LAST, feature LIMIT 8""")
def discriminating_features(spark, sf_dir):
    rows = clustered(spark, sf_dir)
    return rounded(PR.discriminating_features(PR.build_profile(rows), rows, 8), 6)


@query("feature_set_columns", "WITH " + FEATURES + """
SELECT client_id, total_properties, round(total_investment, 6) AS total_investment,
  round(avg_property_price, 6) AS avg_property_price, round(price_dispersion, 5) AS price_dispersion,
  round(office_share, 8) AS office_share, purchase_span_days, age, satisfaction_score, is_company, loan_flag,
  is_investment, is_domestic, gender, referral_channel, country, region FROM features""")
def feature_set_columns(spark, sf_dir):
    fs = FEATURE_SETS["prd_full"]
    return rounded(features(spark, sf_dir).select("client_id", *fs.numeric, *fs.categorical), {
        "total_investment": 6, "avg_property_price": 6, "price_dispersion": 5, "office_share": 8})
