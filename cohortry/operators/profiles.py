"""Profiles of labelled clients: means, names, ratios and what tells segments apart."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.config import (
    FINGERPRINT, PROFILE_MEANS, PROFILE_RATES, SEGMENT_ORDER,
)
from cohortry.operators.scalars import one_row, per_group

_MEANS = PROFILE_MEANS + PROFILE_RATES


def build_profile(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Size, capital, units and means of every label; shares over the label table."""
    sums = df.groupBy(label).agg(
        F.count("*").alias("n_clients"),
        F.sum("total_investment").alias("capital_committed"),
        F.sum("total_properties").alias("units_bought"),
        *[F.avg(c).alias(c) for c in _MEANS],
    )
    whole = one_row(sums.agg(F.sum("n_clients").alias("n"), F.sum("capital_committed").alias("c")))
    return sums.withColumn("_w", whole).select(
        label, "n_clients", (F.col("n_clients") / F.col("_w.n")).alias("pct_clients"),
        "capital_committed",
        F.try_divide("capital_committed", F.col("_w.c")).alias("pct_capital"),
        "units_bought", *_MEANS,
    )


def percent_rank_average(column: str, by: Sequence[str] = ()) -> Column:
    """Rank as a share of the rows, ties at their average. For small tables."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ties = Window.partitionBy(*by, column) if by else Window.partitionBy(column)
    rank = F.rank().over(whole.orderBy(column)) + (F.count("*").over(ties) - 1) / 2
    return rank / F.count("*").over(whole)


def _fallback(cap: Column, tic: Column) -> Column:
    capital = F.when(cap > 0.66, "High").when(cap > 0.33, "Mid").otherwise("Low")
    ticket = F.when(tic > 0.66, "premium").when(tic > 0.33, "mid-ticket").otherwise("value")
    return F.concat(capital, F.lit("-capital "), ticket, F.lit(" buyers"))


def name_segments(profile: DataFrame, label: str = "cluster") -> DataFrame:
    """``(label, segment)`` for a profile table.

    Four labels get the named roles by rank: most units; of the rest, the
    highest and the lowest ticket; then what is left. Any other number gets
    names from the position on the capital and the ticket scale. All of it is
    window work on one row per label.
    """
    value, premium, core, accumulator = SEGMENT_ORDER
    table = Window.partitionBy(F.lit(0))
    most = F.row_number().over(table.orderBy(F.desc("total_properties"), label))
    marked = profile.select(
        label, "avg_property_price", (most > 1).alias("rest"), F.count("*").over(table).alias("labels"),
        percent_rank_average("total_investment").alias("cap"),
        percent_rank_average("avg_property_price").alias("tic"),
    )
    high = F.row_number().over(table.orderBy(F.desc("rest"), F.desc("avg_property_price"), label))
    low = F.row_number().over(table.orderBy(F.desc("rest"), "avg_property_price", label))
    ranked = marked.withColumns({"high": high, "low": low})
    role = (
        F.when(~F.col("rest"), accumulator).when(F.col("high") == 1, premium)
        .when(F.col("low") == 1, value).otherwise(core)
    )
    return ranked.select(
        label,
        F.when(F.col("labels") == 4, role).otherwise(_fallback(F.col("cap"), F.col("tic"))).alias("segment"),
    )


def segment_order(spark: SparkSession) -> DataFrame:
    """The named segments in reporting order."""
    return spark.createDataFrame(list(enumerate(SEGMENT_ORDER)), "position int, segment string")


def segment_signals(profile: DataFrame, df: DataFrame, label: str = "cluster") -> DataFrame:
    """``(label, signal)``: the measure that lies highest against the book, and the lowest."""
    ratios = F.array_sort(F.filter(F.array(*[
        F.struct(F.col(c).alias("ratio"), F.lit(c).alias("measure")) for c in _MEANS
    ]), lambda x: x["ratio"].isNotNull()))
    return relative_profile(profile, df, label).select(label, ratios.alias("r")).select(
        label, F.concat(F.lit("highest "), F.element_at("r", -1)["measure"],
                        F.lit(", lowest "), F.element_at("r", 1)["measure"]).alias("signal"))


def attach_segments(df: DataFrame, label: str = "cluster",
                    strategies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Clients with ``segment``, and the profile with name, signal and strategy.

    ``df`` should be staged. The names, one per label, are looked up in a map,
    so the clients are neither joined nor shuffled. ``strategies``: a table
    ``(segment, strategy)`` of the user's own.
    """
    profile = build_profile(df, label)
    names = name_segments(profile, label)
    described = profile.join(names, label).join(segment_signals(profile, df, label), label)
    described = described.join(strategies, "segment", "left") if strategies is not None else described.withColumn(
        "strategy", F.lit(""))
    return df.withColumn("segment", per_group(names, label)[F.col(label)]["segment"]), described.fillna(
        "", subset=["strategy"])


def _overall(df: DataFrame, columns: Sequence[str], f) -> Column:
    return one_row(df.agg(*[f(c).alias(c) for c in columns]))


def relative_profile(profile: DataFrame, df: DataFrame, label: str = "cluster") -> DataFrame:
    """Segment mean over overall mean, with the segment's name where the profile has it."""
    rows = profile.withColumn("_o", _overall(df, _MEANS, F.avg))
    named = ["segment"] if "segment" in profile.columns else []
    return rows.select(label, *named, *[F.try_divide(F.col(c), F.col("_o")[c]).alias(c) for c in _MEANS])


def fingerprint(profile: DataFrame, df: DataFrame, label: str = "cluster",
                columns: Sequence[str] = FINGERPRINT) -> DataFrame:
    """Segment means in overall sample deviations: ``(label, feature, z)``."""
    rows = profile.withColumns({
        "_m": _overall(df, columns, F.avg), "_s": _overall(df, columns, F.stddev_samp)
    })
    return rows.select(label, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 F.try_divide(F.col(c) - F.col("_m")[c], F.col("_s")[c]).alias("z"))
        for c in columns
    ])))


def discriminating_features(profile: DataFrame, df: DataFrame, top_n: int = 6) -> DataFrame:
    """Range of segment means in overall deviations, largest first; constant columns last."""
    spans = profile.agg(*[(F.max(c) - F.min(c)).alias(c) for c in _MEANS])
    rows = spans.withColumn("_s", _overall(df, _MEANS, F.stddev_samp))
    return rows.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 F.try_divide(F.col(c), F.col("_s")[c]).alias("spread_in_sd"))
        for c in _MEANS
    ]))).orderBy(F.desc_nulls_last("spread_in_sd"), "feature").limit(top_n)
