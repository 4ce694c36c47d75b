"""Readers of the two text files and of the tables a run writes."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortry.config import LEDGER_COLUMNS, REGISTER_COLUMNS
from cohortry.functions.parsing import null_tokens

# Columns of the written feature table, declared so that reading starts no job.
FEATURES_SCHEMA = """
client_id string, full_name string, client_type string, gender string, country string,
region string, date_of_birth date, age int, acquisition_purpose string, satisfaction_score int,
loan_applied string, referral_channel string, loan_flag int, is_investment int, is_company int,
total_properties int, total_investment double, avg_property_price double,
max_property_price double, min_property_price double, price_dispersion double,
avg_floor_area double, total_area double, avg_price_per_sqft double, unique_towers int,
first_purchase date, last_purchase date, active_months int, apartment_count int,
office_count int, apartment_share double, office_share double, purchase_span_days int,
tower_diversity double, purchase_intensity double, is_domestic int, has_purchase int,
age_band string, age_band_order int, investment_band_order int, investment_band string,
country_code int, region_code int, referral_channel_code int
"""


def read_text_table(spark: SparkSession, path: str, columns: Sequence[str],
                    row_order: str = "file_order", multi_line: bool = False) -> DataFrame:
    """A CSV with every column as text, and its row order as an extra column.

    The order is file, place of the split in the file, place in the split; it
    decides which of several rows with one key comes first. The header is
    checked, so columns may not be swapped. A short line is filled with nulls; one
    with surplus fields that are not empty fails the read, and so does a short one that a quoted line
    break has cut. ``multi_line`` reads such records whole; a file is then one task's.
    """
    fields = [StructField(c, StringType()) for c in columns]
    quotes = {"quote": '"', "escape": '"'}
    rows = (
        spark.read.schema(StructType([*fields, StructField("_line", StringType())]))
        .options(header=True, enforceSchema=False, multiLine=multi_line, columnNameOfCorruptRecord="_line", **quotes)
        .csv(path)
    )
    # Parsed with one field more; as no text is null, that field is null only where it is absent.
    wide = ", ".join(f"_{i} string" for i in range(len(columns) + 1))
    surplus = F.from_csv("_line", wide, {**quotes, "nullValue": "\x00", "mode": "PERMISSIVE"})[f"_{len(columns)}"].isNotNull()
    cut = F.lit(not multi_line) & (F.regexp_count("_line", F.lit('"')) % 2 == 1)
    named = lambda what: F.raise_error(F.concat(
        F.lit(f"{what}: "), F.col("_line"), F.lit(" at "), F.coalesce(F.col(columns[0]), F.lit("")))).cast("boolean")
    rows = rows.filter(F.when(F.col("_line").isNull(), F.lit(True)).when(cut, named("quoted line break, use multi_line"))
                       .when(surplus, named("more fields than columns")).otherwise(F.lit(True)))
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"),
    )
    return rows.select(*[null_tokens(F.col(c)).alias(c) for c in columns], order.alias(row_order))


def read_register(spark: SparkSession, path: str) -> DataFrame:
    return read_text_table(spark, path, REGISTER_COLUMNS)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return read_text_table(spark, path, LEDGER_COLUMNS)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The written feature table, its schema declared."""
    return spark.read.schema(FEATURES_SCHEMA).parquet(path)


def read_report_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Segmented clients, cached for repeated reports, and the profile."""
    try:
        clients = spark.read.parquet(f"{folder}/segmented_clients")
        profile = spark.read.parquet(f"{folder}/cluster_profiles")
    except AnalysisException as error:
        raise FileNotFoundError(
            f"no segmented clients under {folder}; run cohortry.plans.segmentation.run first"
        ) from error
    return clients.cache(), profile
