"""Round trips through every source and sink: written to the shared folder, read back, compared."""
from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortry.config import EXPLORER, FEATURE_SETS, LEDGER_COLUMNS, REGISTER_COLUMNS
from cohortry.operators import eda
from cohortry.operators import features as FE
from cohortry.operators import profiles as PR
from cohortry.operators import reporting as R
from cohortry.operators import validation as VA
from cohortry.operators.matrix import build_matrix
from cohortry.plans.metric_queries import WIDE, _matrix_sql, _POINT, _scaled
from cohortry.plans.registry import (
    CLUSTERED, FEATURES, LEDGER, SEGMENTED, clustered, components_sql, features, query, rnd, rounded, segmented,
)
from cohortry.session import new_path
from cohortry.sources import readers, writers
from cohortry.sources import views as V

_TEXT = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

# The register and the ledger as the texts that the views make.
_REGISTER_TEXT = """
SELECT CAST(c_custkey AS VARCHAR) AS client_id, ' ' || split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) || '  ' AS last_name,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN ' Company' ELSE 'Individual' END AS client_type,
  CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
  CASE WHEN c_custkey % 11 = 0 THEN '  ' || n_name || ' ' ELSE n_name END AS country, r_name AS region,
  CASE WHEN c_custkey % 97 = 5 THEN 'not known'
    WHEN c_custkey % 89 = 3 THEN (13 + c_custkey % 15) || '-' || (1 + c_custkey % 12) || '-' || (1931 + c_custkey % 70)
    WHEN c_custkey % 101 = 7 THEN (1931 + c_custkey % 70) || '-' || lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0') || '-'
      || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0')
    WHEN 1 + c_custkey % 28 > 12 THEN (1 + c_custkey % 12) || '/' || (1 + c_custkey % 28) || '/' || (1931 + c_custkey % 70)
    ELSE lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') || '-' || (1931 + c_custkey % 70)
  END AS date_of_birth,
  CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'INVESTMENT' ELSE 'Home' END AS acquisition_purpose,
  CASE WHEN c_custkey % 83 <> 1 THEN CAST(1 + c_custkey % 5 AS VARCHAR) ELSE 'none given' END AS satisfaction_score,
  CASE WHEN c_acctbal < 0 THEN 'yes' ELSE 'No' END AS loan_applied,
  CASE WHEN c_custkey % 79 <> 2 THEN 'via   ' || c_mktsegment END AS referral_channel
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""

_LEDGER_TEXT = """
SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS listing_id, strftime(o_orderdate, '%m-01-%Y') AS transaction_date,
  CASE WHEN l_returnflag = 'R' THEN ' Office' ELSE 'Apartment' END AS unit_category, CAST(l_suppkey AS VARCHAR) AS tower_number,
  CAST(l_partkey AS VARCHAR) AS unit_number, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS floor_area_sqft,
  CASE WHEN l_partkey % 50 = 7 THEN 'on request' ELSE format('${:,.2f}', l_extendedprice) END AS sale_price,
  CASE WHEN l_linestatus = 'F' THEN 'Sold' ELSE 'Available' END AS listing_status,
  CASE WHEN l_linestatus = 'F' THEN ' ' || o_custkey END AS client_ref
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query("register_file", _REGISTER_TEXT)
def register_file(spark, sf_dir):
    """The register as a CSV file, opened by the reader."""
    path = new_path(spark, "register_csv")
    V.register_text(spark, sf_dir).write.options(**_TEXT).csv(path)
    return readers.read_register(spark, path).select(*REGISTER_COLUMNS)


@query("ledger_file", _LEDGER_TEXT)
def ledger_file(spark, sf_dir):
    """The ledger as a CSV file; the texts for a missing key come back as NULL."""
    path = new_path(spark, "ledger_csv")
    V.ledger_text(spark, sf_dir).select(*LEDGER_COLUMNS).write.options(**_TEXT).csv(path)
    return readers.read_ledger(spark, path).select(*LEDGER_COLUMNS)


@query("written_features", "WITH " + FEATURES + f"""
SELECT CAST(client_id AS VARCHAR) AS client_id, total_properties, {rnd("total_investment avg_floor_area", 6)}, first_purchase, age_band,
  investment_band_order, CAST(dense_rank() OVER (ORDER BY country) - 1 AS INTEGER) AS country_code FROM features""")
def written_features(spark, sf_dir):
    """The coded feature table as parquet, read back under its declared schema."""
    path = new_path(spark, "features")
    rows = features(spark, sf_dir).withColumn("client_id", F.col("client_id").cast("string"))
    writers.write_table(FE.label_encode(rows), path)
    return rounded(readers.read_features(spark, path).select(
        "client_id", "total_properties", "total_investment", "avg_floor_area", "first_purchase", "age_band",
        "investment_band_order", "country_code"), 6)


@query("written_ledger", "WITH " + LEDGER + """
SELECT listing_id, transaction_date, unit_category, tower_number, floor_area_sqft, round(sale_price, 6) AS sale_price, listing_status, client_ref FROM ledger""")
def written_ledger(spark, sf_dir):
    path = new_path(spark, "ledger")
    writers.write_table(V.ledger(spark, sf_dir), path)
    return rounded(spark.read.parquet(path).select(
        "listing_id", "transaction_date", "unit_category", "tower_number", "floor_area_sqft", "sale_price", "listing_status", "client_ref"), 6)


@query("written_report", "WITH " + LEDGER + """
SELECT strftime(transaction_date, '%Y-%m-%d') AS month, count(*) AS sales FROM ledger WHERE listing_status = 'Sold' GROUP BY 1""")
def written_report(spark, sf_dir):
    """A report table as CSV."""
    path = new_path(spark, "report")
    writers.write_report(eda.monthly_sales(V.ledger(spark, sf_dir)).orderBy("month"), path)
    return spark.read.schema("month string, sales bigint").option("header", True).csv(path)


@query("written_json", "WITH " + SEGMENTED + """
SELECT count(*) AS clients, CAST(sum(total_properties) AS BIGINT) AS units, round(sum(total_investment), 2) AS capital,
  (SELECT list(s ORDER BY s) FROM (SELECT DISTINCT segment AS s FROM segmented)) AS segments FROM segmented""")
def written_json(spark, sf_dir):
    """A one-row summary with a nested list as JSON."""
    path = new_path(spark, "summary")
    rows = segmented(spark, sf_dir)
    writers.write_json(rows.agg(
        F.count("*").alias("clients"), F.sum("total_properties").alias("units"), F.sum("total_investment").alias("capital"),
        F.array_sort(F.collect_set("segment")).alias("segments")), path)
    return rounded(spark.read.schema("clients bigint, units bigint, capital double, segments array<string>").json(path), 2)


@query("saved_preprocessor", _matrix_sql("log_standard"))
def saved_preprocessor(spark, sf_dir):
    """The fitted matrix steps saved, loaded and applied."""
    path = new_path(spark, "preprocessor")
    rows = features(spark, sf_dir)
    writers.save_model(build_matrix(rows, FEATURE_SETS["behaviour_wide"], "log_standard").model, path)
    again = PipelineModel.load(path).transform(rows)
    return rounded(again.select("client_id", *[F.col(f"x_{i}").alias(c) for i, c in enumerate(WIDE)]), 9)


@query("saved_components", "WITH RECURSIVE " + CLUSTERED + "," + _scaled(WIDE, "standard", "clustered") + f""",
pts AS (SELECT client_id AS id, {_POINT} AS v FROM scaled),
{components_sql(len(WIDE))}
SELECT id AS client_id, {rnd("pc1 pc2", 6)} FROM scores""")
def saved_components(spark, sf_dir):
    """The component model saved, loaded and applied."""
    path = new_path(spark, "components")
    m = build_matrix(clustered(spark, sf_dir), FEATURE_SETS["behaviour_wide"], "standard")
    writers.save_model(VA.pca_projection(m.df).model, path)
    scores = PipelineModel.load(path).transform(m.df).withColumn("s", vector_to_array("scores"))
    return rounded(scores.select("client_id", F.col("s")[0].alias("pc1"), F.col("s")[1].alias("pc2")), 6)


@query("report_tables", "WITH " + SEGMENTED + """
SELECT segment, count(*) AS clients, max(n_clients) AS profiled, round(sum(segmented.total_investment), 2) + 0.0 AS capital
FROM segmented JOIN profile USING (cluster) GROUP BY 1""")
def report_tables(spark, sf_dir):
    """Segmented clients and profiles as a run writes them, opened for reports."""
    path = new_path(spark, "reports")
    clients, profile = PR.attach_segments(clustered(spark, sf_dir))
    writers.write_table(clients, f"{path}/segmented_clients")
    writers.write_table(profile, f"{path}/cluster_profiles")
    opened, profiles = readers.read_report_tables(spark, path)
    sizes = profiles.select("segment", F.col("n_clients").alias("profiled"))
    return rounded(opened.groupBy("segment").agg(
        F.count("*").alias("clients"), F.sum("total_investment").alias("capital")).join(sizes, "segment"), 2)


@query("exported_selection", "WITH " + SEGMENTED + """
SELECT CAST(client_id AS VARCHAR) AS client_id, segment, country, CAST(round(total_investment, 6) AS VARCHAR) <> '' AS has_capital
FROM segmented WHERE country IN ('NATION_1', 'NATION_3') AND loan_applied = 'No'""")
def exported_selection(spark, sf_dir):
    """A filtered view exported as CSV."""
    path = new_path(spark, "export")
    view = R.filtered(segmented(spark, sf_dir), {"country": ["NATION_1", "NATION_3"], "loan_applied": ["No"]})
    writers.write_selection(R.client_explorer(view), path)
    rows = spark.read.schema(", ".join(f"{c} string" for c in EXPLORER)).option("header", True).csv(path)
    return rows.select("client_id", "segment", "country", F.col("total_investment").isNotNull().alias("has_capital"))
