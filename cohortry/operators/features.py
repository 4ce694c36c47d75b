"""From ledger rows to one behavioural profile per client."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.config import (
    CODED, FEATURE_DICTIONARY, HOME_COUNTRY, PROFILE_REGISTER_COLUMNS,
)
from cohortry.functions import bands
from cohortry.operators.quantiles import quantile_row
from cohortry.operators.scalars import one_row
from cohortry.session import stage_table


def sold_listings(ledger: DataFrame) -> DataFrame:
    """Listings that were sold to a known client."""
    return ledger.filter((F.col("listing_status") == "Sold") & F.col("client_ref").isNotNull())


def aggregate_purchases(ledger: DataFrame) -> DataFrame:
    """Purchase behaviour per client.

    Every aggregate has a partial form, the distinct counts included, so a
    client with a large part of all rows is reduced before the shuffle.
    """
    kind = F.col("unit_category")
    sums = sold_listings(ledger).groupBy(F.col("client_ref").alias("client_id")).agg(
        F.count("listing_id").alias("total_properties"),
        F.coalesce(F.sum("sale_price"), F.lit(0.0)).alias("total_investment"),
        F.avg("sale_price").alias("avg_property_price"),
        F.max("sale_price").alias("max_property_price"),
        F.min("sale_price").alias("min_property_price"),
        F.coalesce(F.stddev_samp("sale_price"), F.lit(0.0)).alias("price_dispersion"),
        F.avg("floor_area_sqft").alias("avg_floor_area"),
        F.coalesce(F.sum("floor_area_sqft"), F.lit(0.0)).alias("total_area"),
        F.avg("price_per_sqft").alias("avg_price_per_sqft"),
        F.count_distinct("tower_number").alias("unique_towers"),
        F.min("transaction_date").alias("first_purchase"),
        F.max("transaction_date").alias("last_purchase"),
        F.count_distinct("transaction_date").alias("active_months"),
        F.count(F.when(kind == "Apartment", F.col("listing_id"))).alias("apartment_count"),
        F.count(F.when(kind == "Office", F.col("listing_id"))).alias("office_count"),
    )
    whole = ("total_properties", "unique_towers", "active_months", "apartment_count", "office_count")
    sums = sums.withColumns({c: F.col(c).cast("int") for c in whole})
    return sums.withColumns({
        "apartment_share": F.try_divide("apartment_count", "total_properties"),
        "office_share": F.try_divide("office_count", "total_properties"),
        "purchase_span_days": F.date_diff("last_purchase", "first_purchase"),
        "tower_diversity": F.try_divide("unique_towers", "total_properties"),
        "purchase_intensity": F.try_divide("total_properties", "active_months"),
    })


def join_register(register: DataFrame, purchases: DataFrame,
                  home_country: str = HOME_COUNTRY) -> DataFrame:
    """Register left join behaviour; a client without purchases gets zeros."""
    numbers = [
        c for c, t in purchases.dtypes if c != "client_id" and t not in ("date", "string")
    ]
    joined = register.select(*PROFILE_REGISTER_COLUMNS).join(purchases, "client_id", "left")
    return joined.withColumns({
        "is_domestic": F.col("country").eqNullSafe(home_country).cast("int"),
        "has_purchase": F.col("total_properties").isNotNull().cast("int"),
    }).fillna(0, subset=numbers)


def add_bands(features: DataFrame) -> DataFrame:
    """Age band by fixed edges and investment band by exact quartiles."""
    edges = one_row(quantile_row(features, "total_investment", (0.25, 0.5, 0.75)))
    return (
        features.withColumn("_e", edges)
        .withColumns({
            "age_band": bands.age_band(F.col("age")),
            "age_band_order": bands.age_band_order(F.col("age")),
            "investment_band_order": bands.quartile_order(
                F.col("total_investment"), F.col("_e.q0"), F.col("_e.q1"), F.col("_e.q2")
            ),
        })
        .withColumn("investment_band", bands.quartile_band(F.col("investment_band_order")))
        .drop("_e")
    )


def client_features(register: DataFrame, ledger: DataFrame,
                    home_country: str = HOME_COUNTRY) -> DataFrame:
    """The analytical base table: register, behaviour, flags and bands.

    The ledger is aggregated once into a staged table of one row per client;
    the quartile passes and all later readers start from that.
    """
    joined = join_register(register, aggregate_purchases(ledger), home_country)
    return add_bands(stage_table(joined, "client_features"))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """``(column, code)``: levels numbered in sorted order, NULL as the text "nan".

    The distinct levels are dealt by ranges, staged and numbered range by range; the levels of the
    ranges before are added. Beside the rows there is only one count per range.
    """
    levels = df.select(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias(column)).distinct()
    ranged = stage_table(levels.repartitionByRange(column).withColumn("_range", F.spark_partition_id()), "levels")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("_range", "n"))).scalar()
    before = F.aggregate(F.filter("_counts", lambda x: x["_range"] < F.col("_range")), F.lit(0).cast("bigint"),
                         lambda total, x: total + x["n"])
    place = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return ranged.withColumn("_counts", counts).withColumn("_place", place).select(
        column, (before + F.col("_place") - 1).cast("int").alias(f"{column}_code"))


def label_encode(df: DataFrame, columns: Sequence[str] = CODED) -> DataFrame:
    """Adds ``<column>_code``; columns that are not there are skipped.

    Adaptive execution broadcasts a small level table and splits a level that many
    clients share.
    """
    out = df
    for c in columns:
        if c not in df.columns:
            continue
        codes = label_codes(df, c).withColumnRenamed(c, "_level")
        out = out.join(
            codes, F.coalesce(F.col(c).cast("string"), F.lit("nan")) == F.col("_level"), "left"
        ).drop("_level")
    return out


def reconcile(features: DataFrame, ledger: DataFrame) -> DataFrame:
    """Units and capital of the profile against the ledger: ``(measure, profile, ledger, difference)``."""
    sums = features.agg(
        F.sum("total_properties").cast("double").alias("u"), F.sum("total_investment").alias("c")
    )
    book = sold_listings(ledger).agg(
        F.count("listing_id").cast("double").alias("u"), F.sum("sale_price").alias("c")
    )
    a, b = one_row(sums), one_row(book)
    both = ledger.sparkSession.range(1).select(a.alias("a"), b.alias("b"))
    return both.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("measure"), F.col("a")[f].alias("profile"),
                 F.col("b")[f].alias("ledger"), (F.col("a")[f] - F.col("b")[f]).alias("difference"))
        for name, f in (("units", "u"), ("capital", "c"))
    ])))


def feature_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FEATURE_DICTIONARY), "`group` string, feature string, description string")
