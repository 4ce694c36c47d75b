"""Small results beside every row, without a join."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row(df: DataFrame) -> Column:
    """A one-row table as a struct column (scalar subquery)."""
    return df.select(F.struct("*").alias("row")).scalar()


def per_group(df: DataFrame, key: str) -> Column:
    """A table of report groups as a map from group to struct (scalar subquery).

    For group keys that are few by design: clusters, segments, unit
    categories. Rows with a NULL key are left out.
    """
    rest = F.struct(*[F.col(c) for c in df.columns if c != key])
    entries = F.collect_list(F.struct(F.col(key), rest))
    return df.filter(F.col(key).isNotNull()).agg(F.map_from_entries(entries)).scalar()
