"""Register and ledger as views over the order tables.

``register`` and ``ledger`` are typed; ``register_text`` and ``ledger_text``
are the all-text form the cleaning operators start from, with the defects
those operators mend (padding, case, unreadable and missing values).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.config import REFERENCE_DATE
from cohortry.functions import parsing as P

HOME = "NATION_0"

# Order that decides which of two rows with one (order, line) key is kept.
_LINE_ORDER = (
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


# Declared so that opening a table starts no job to look for its schema.
_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
              "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return table(spark, sf_dir, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )


def birth_text() -> Column:
    """Birth date in the two serialisations of the source."""
    key = F.col("c_custkey")
    year, month, day = (1931 + key % 70), (1 + key % 12), (1 + key % 28)
    slashed = F.concat_ws("/", month, day, year)
    dashed = F.concat_ws("-", F.lpad(month.cast("string"), 2, "0"),
                         F.lpad(day.cast("string"), 2, "0"), year)
    return F.when(day > 12, slashed).otherwise(dashed)


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed row per client."""
    seg = F.col("c_mktsegment")
    birth = F.make_date(
        (1931 + F.col("c_custkey") % 70).cast("int"),
        (1 + F.col("c_custkey") % 12).cast("int"),
        (1 + F.col("c_custkey") % 28).cast("int"),
    )
    labelled = _customers(spark, sf_dir).select(
        F.col("c_custkey").alias("client_id"),
        F.col("c_name").alias("full_name"),
        F.when(seg == "MACHINERY", "Company").otherwise("Individual").alias("client_type"),
        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        birth.alias("date_of_birth"),
        F.when(seg.isin("BUILDING", "FURNITURE"), "Investment").otherwise("Home")
        .alias("acquisition_purpose"),
        (1 + F.col("c_custkey") % 5).cast("int").alias("satisfaction_score"),
        F.when(F.col("c_acctbal") < 0, "Yes").otherwise("No").alias("loan_applied"),
        seg.alias("referral_channel"),
    )
    return labelled.select(
        "*",
        P.age_on(F.col("date_of_birth"), REFERENCE_DATE).alias("age"),
        P.label_flag(F.col("loan_applied"), "yes").alias("loan_flag"),
        P.label_flag(F.col("acquisition_purpose"), "investment").alias("is_investment"),
        P.label_flag(F.col("client_type"), "company").alias("is_company"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with one row per (order, line)."""
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*_LINE_ORDER)
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("_rn", F.row_number().over(first))
        .filter("_rn = 1")
        .drop("_rn")
    )


def _ledger_rows(lines: DataFrame, orders: DataFrame) -> DataFrame:
    sold = F.col("l_linestatus") == "F"
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("listing_id"),
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("transaction_date"),
        F.when(F.col("l_returnflag") == "R", "Office").otherwise("Apartment")
        .alias("unit_category"),
        F.col("l_suppkey").alias("tower_number"),
        F.col("l_partkey").alias("unit_number"),
        F.col("l_quantity").alias("floor_area_sqft"),
        F.col("l_extendedprice").alias("sale_price"),
        F.when(sold, "Sold").otherwise("Available").alias("listing_status"),
        F.when(sold, F.col("o_custkey")).alias("client_ref"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed row per listing."""
    rows = _ledger_rows(order_lines(spark, sf_dir), table(spark, sf_dir, "orders"))
    return rows.withColumn(
        "price_per_sqft", F.try_divide("sale_price", "floor_area_sqft")
    )


def register_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register as text, before cleaning."""
    key, seg = F.col("c_custkey"), F.col("c_mktsegment")
    birth = (
        F.when(key % 97 == 5, F.lit("not known"))
        .when(key % 89 == 3, F.concat_ws("-", 13 + key % 15, 1 + key % 12, 1931 + key % 70))
        .when(key % 101 == 7, F.concat_ws("-", 1931 + key % 70,
                                          F.lpad((1 + key % 12).cast("string"), 2, "0"),
                                          F.lpad((1 + key % 28).cast("string"), 2, "0")))
        .otherwise(birth_text())
    )
    return _customers(spark, sf_dir).select(
        key.cast("string").alias("client_id"),
        F.concat(F.lit(" "), F.split_part("c_name", F.lit("#"), F.lit(1))).alias("first_name"),
        F.concat(F.split_part("c_name", F.lit("#"), F.lit(2)), F.lit("  ")).alias("last_name"),
        F.when(seg == "MACHINERY", " Company").otherwise("Individual").alias("client_type"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
        F.when(key % 11 == 0, F.concat(F.lit("  "), F.col("n_name"), F.lit(" ")))
        .otherwise(F.col("n_name")).alias("country"),
        F.col("r_name").alias("region"),
        birth.alias("date_of_birth"),
        F.when(seg.isin("BUILDING", "FURNITURE"), "INVESTMENT").otherwise("Home")
        .alias("acquisition_purpose"),
        F.when(key % 83 != 1, (1 + key % 5).cast("string")).otherwise("none given")
        .alias("satisfaction_score"),
        F.when(F.col("c_acctbal") < 0, "yes").otherwise("No").alias("loan_applied"),
        F.when(key % 79 != 2, F.concat(F.lit("via   "), seg)).alias("referral_channel"),
    )


def ledger_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as text, before cleaning; (order, line) keys still repeat.

    ``line_order`` is the explicit keep-first order of repeated keys.
    """
    rows = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    sold = F.col("l_linestatus") == "F"
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("listing_id"),
        F.date_format("o_orderdate", "MM-'01'-yyyy").alias("transaction_date"),
        F.when(F.col("l_returnflag") == "R", " Office").otherwise("Apartment")
        .alias("unit_category"),
        F.col("l_suppkey").cast("string").alias("tower_number"),
        F.col("l_partkey").cast("string").alias("unit_number"),
        F.col("l_quantity").cast("int").cast("string").alias("floor_area_sqft"),
        F.when(F.col("l_partkey") % 50 == 7, "on request")
        .otherwise(F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)))
        .alias("sale_price"),
        F.when(sold, "Sold").otherwise("Available").alias("listing_status"),
        F.when(sold, F.concat(F.lit(" "), F.col("o_custkey"))).otherwise("nan")
        .alias("client_ref"),
        F.struct(*_LINE_ORDER).alias("line_order"),
    )
