"""Sinks: typed tables as parquet, report tables as CSV, the summary as JSON, models as pipelines."""
from __future__ import annotations

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str) -> None:
    """A table of any size."""
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of a few rows as one CSV part with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_selection(df: DataFrame, path: str) -> None:
    """Exported clients as CSV, in as many parts as Spark has."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)
