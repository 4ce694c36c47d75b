"""Registration of queries, and the tables and SQL texts they share."""
from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import features as FE
from cohortry.operators import profiles as PR
from cohortry.session import stage_table
from cohortry.sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only its rows can be checked."""
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, places: Mapping[str, int] | int = 4) -> DataFrame:
    """Doubles rounded for comparison; ``+ 0.0`` makes minus zero plain zero."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    if isinstance(places, int):
        places = {c: places for c in doubles}
    return df.withColumns({
        c: F.round(c, places.get(c, 4)) + F.lit(0.0) for c in doubles
    })


def rnd(columns: str, places: int = 4) -> str:
    """The same rounding as a SQL select list."""
    return ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c in columns.split())


# --- shared tables ------------------------------------------------------------
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client features of the whole tables."""
    return FE.client_features(V.register(spark, sf_dir), V.ledger(spark, sf_dir), V.HOME)


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, staged, with the investment quartile as a rule-based cluster."""
    bands = features(spark, sf_dir)
    return stage_table(bands.withColumn("cluster", F.col("investment_band_order")), "clustered")


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered clients with their segment names."""
    return PR.attach_segments(clustered(spark, sf_dir))[0]


# --- shared SQL ---------------------------------------------------------------
REGISTER = """
register AS (
  SELECT c_custkey AS client_id, c_name AS full_name,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Company' ELSE 'Individual' END AS client_type,
    CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
    n_name AS country, r_name AS region,
    make_date(1931 + c_custkey % 70, 1 + c_custkey % 12, 1 + c_custkey % 28) AS date_of_birth,
    CAST(2025 - (1931 + c_custkey % 70) AS INTEGER) AS age,
    CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'Investment' ELSE 'Home' END
      AS acquisition_purpose,
    CAST(1 + c_custkey % 5 AS INTEGER) AS satisfaction_score,
    CASE WHEN c_acctbal < 0 THEN 'Yes' ELSE 'No' END AS loan_applied,
    c_mktsegment AS referral_channel,
    CAST(c_acctbal < 0 AS INTEGER) AS loan_flag,
    CAST(c_mktsegment IN ('BUILDING', 'FURNITURE') AS INTEGER) AS is_investment,
    CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS is_company
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
)"""

LINES = """
lines AS (
  SELECT * FROM lineitem
  QUALIFY row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
             l_returnflag, l_linestatus, l_shipdate) = 1
)"""

LEDGER = LINES + """,
ledger AS (
  SELECT l_orderkey * 10 + l_linenumber AS listing_id,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS transaction_date,
    CASE WHEN l_returnflag = 'R' THEN 'Office' ELSE 'Apartment' END AS unit_category,
    l_suppkey AS tower_number, l_partkey AS unit_number,
    l_quantity AS floor_area_sqft, l_extendedprice AS sale_price,
    CASE WHEN l_linestatus = 'F' THEN 'Sold' ELSE 'Available' END AS listing_status,
    CASE WHEN l_linestatus = 'F' THEN o_custkey END AS client_ref,
    l_extendedprice / nullif(l_quantity, 0) AS price_per_sqft
  FROM lines JOIN orders ON l_orderkey = o_orderkey
)"""

BEHAVIOUR = LEDGER + """,
behaviour AS (
  SELECT client_ref AS client_id,
    CAST(count(*) AS INTEGER) AS total_properties,
    sum(sale_price) AS total_investment, avg(sale_price) AS avg_property_price,
    max(sale_price) AS max_property_price, min(sale_price) AS min_property_price,
    coalesce(stddev_samp(sale_price), 0) AS price_dispersion,
    avg(floor_area_sqft) AS avg_floor_area, sum(floor_area_sqft) AS total_area,
    avg(price_per_sqft) AS avg_price_per_sqft,
    CAST(count(DISTINCT tower_number) AS INTEGER) AS unique_towers,
    min(transaction_date) AS first_purchase, max(transaction_date) AS last_purchase,
    CAST(count(DISTINCT transaction_date) AS INTEGER) AS active_months,
    CAST(count(*) FILTER (unit_category = 'Apartment') AS INTEGER) AS apartment_count,
    CAST(count(*) FILTER (unit_category = 'Office') AS INTEGER) AS office_count
  FROM ledger WHERE listing_status = 'Sold' AND client_ref IS NOT NULL GROUP BY client_ref
)"""

_ZEROED = (
    "total_properties", "total_investment", "avg_property_price", "max_property_price",
    "min_property_price", "price_dispersion", "avg_floor_area", "total_area",
    "avg_price_per_sqft", "unique_towers", "active_months", "apartment_count", "office_count",
)

FEATURES = REGISTER + "," + BEHAVIOUR + """,
joined AS (
  SELECT r.*, """ + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _ZEROED) + """,
    first_purchase, last_purchase,
    coalesce(CAST(apartment_count AS DOUBLE) / total_properties, 0) AS apartment_share,
    coalesce(CAST(office_count AS DOUBLE) / total_properties, 0) AS office_share,
    coalesce(CAST(last_purchase - first_purchase AS INTEGER), 0) AS purchase_span_days,
    coalesce(CAST(unique_towers AS DOUBLE) / total_properties, 0) AS tower_diversity,
    coalesce(CAST(total_properties AS DOUBLE) / active_months, 0) AS purchase_intensity,
    CAST(country IS NOT DISTINCT FROM 'NATION_0' AS INTEGER) AS is_domestic,
    CAST(b.client_id IS NOT NULL AS INTEGER) AS has_purchase
  FROM register r LEFT JOIN behaviour b ON r.client_id = b.client_id
),
edges AS (
  SELECT quantile_cont(total_investment, 0.25) AS q1, quantile_cont(total_investment, 0.5) AS q2,
         quantile_cont(total_investment, 0.75) AS q3 FROM joined
),
features AS (
  SELECT joined.*,
    CASE WHEN age <= 0 THEN NULL WHEN age <= 34 THEN '<35' WHEN age <= 44 THEN '35-44'
         WHEN age <= 54 THEN '45-54' WHEN age <= 64 THEN '55-64' WHEN age <= 200 THEN '65+' END
      AS age_band,
    CAST(CASE WHEN age <= 0 THEN NULL WHEN age <= 34 THEN 0 WHEN age <= 44 THEN 1
         WHEN age <= 54 THEN 2 WHEN age <= 64 THEN 3 WHEN age <= 200 THEN 4 END AS INTEGER)
      AS age_band_order,
    CAST(CASE WHEN total_investment <= q1 THEN 0 WHEN total_investment <= q2 THEN 1
         WHEN total_investment <= q3 THEN 2 ELSE 3 END AS INTEGER) AS investment_band_order,
    CASE WHEN total_investment <= q1 THEN 'Q1 lowest' WHEN total_investment <= q2 THEN 'Q2'
         WHEN total_investment <= q3 THEN 'Q3' ELSE 'Q4 highest' END AS investment_band
  FROM joined, edges
)"""

CLUSTERED = FEATURES + """,
clustered AS (SELECT *, investment_band_order AS cluster FROM features)"""

_PROFILE_AVG = (
    "total_properties total_investment avg_property_price max_property_price price_dispersion "
    "avg_floor_area total_area avg_price_per_sqft unique_towers active_months "
    "purchase_span_days office_share apartment_share age satisfaction_score "
    "loan_flag is_investment is_company is_domestic"
).split()

PROFILE = CLUSTERED + """,
profile AS (
  SELECT cluster, count(*) AS n_clients,
    count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM clustered) AS pct_clients,
    sum(total_investment) AS capital_committed,
    sum(total_investment) / (SELECT sum(total_investment) FROM clustered) AS pct_capital,
    CAST(sum(total_properties) AS BIGINT) AS units_bought,
    """ + ", ".join(f"avg({c}) AS {c}" for c in _PROFILE_AVG) + """
  FROM clustered GROUP BY cluster
),
lead AS (SELECT cluster FROM profile ORDER BY total_properties DESC, cluster LIMIT 1),
rest AS (SELECT * FROM profile WHERE cluster NOT IN (SELECT cluster FROM lead)),
dear AS (SELECT cluster FROM rest ORDER BY avg_property_price DESC, cluster LIMIT 1),
cheap AS (SELECT cluster FROM rest ORDER BY avg_property_price, cluster LIMIT 1),
names AS (
  SELECT cluster, CASE
    WHEN cluster IN (SELECT cluster FROM lead) THEN 'Portfolio Accumulators'
    WHEN cluster IN (SELECT cluster FROM dear) THEN 'Large-Format Premium Buyers'
    WHEN cluster IN (SELECT cluster FROM cheap) THEN 'Value-Tier Buyers'
    ELSE 'Core Multi-Unit Investors' END AS segment FROM profile
)"""

SEGMENTED = PROFILE + """,
segmented AS (SELECT c.*, segment FROM clustered c JOIN names USING (cluster))"""


def components_sql(d: int, squarings: int = 14) -> str:
    """CTEs from ``pts (id, v)`` to ``scores (id, pc1, pc2)``: principal components by powers of the covariance matrix.

    A matrix squared ``squarings`` times keeps only its first component; that taken out, the same gives the
    second. The largest loading of each is positive.
    """
    at = f"range(1, {d + 1})"

    def diagonal(m: str) -> str:
        return f"list_transform({at}, lambda k: {m}[k][k])"

    def over_trace(m: str) -> str:
        return f"list_transform({m}, lambda r: list_transform(r, lambda x: x / list_sum({diagonal(m)})))"

    def component(n: int) -> str:
        return f"""
pow{n} AS (SELECT 0 AS t, {over_trace("m")} AS m FROM mat{n}
  UNION ALL SELECT t + 1, {over_trace("q")} FROM (SELECT t, list_transform(m, lambda r: list_transform(m, lambda s: list_dot_product(r, s))) AS q
  FROM pow{n} WHERE t < {squarings})),
row{n} AS (SELECT m[list_position(g, list_max(g))] AS r FROM (SELECT m, {diagonal("m")} AS g FROM pow{n} WHERE t = {squarings})),
axis{n} AS (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r)) * CASE WHEN r[list_position(b, list_max(b))] > 0 THEN 1 ELSE -1 END) AS v
  FROM (SELECT r, list_transform(r, lambda x: abs(x)) AS b FROM row{n}))"""

    return f"""
flat AS (SELECT id, unnest(v) AS x, unnest(range({d})) AS i FROM pts),
centred AS (SELECT id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM flat),
cov AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / ((SELECT count(*) FROM pts) - 1) AS c FROM centred a JOIN centred b ON a.id = b.id GROUP BY ALL),
mat1 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY i)),{component(1)},
mat2 AS (SELECT list_transform({at}, lambda i: list_transform({at}, lambda j: m[i][j] - l * v[i] * v[j])) AS m
  FROM (SELECT m, v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM mat1, axis1)),{component(2)},
scores AS (SELECT id, sum(x * axis1.v[i + 1]) AS pc1, sum(x * axis2.v[i + 1]) AS pc2 FROM centred, axis1, axis2 GROUP BY id)
"""
