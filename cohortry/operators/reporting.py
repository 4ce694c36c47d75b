"""Report queries over the table of segmented clients."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.config import (
    BOOK_COMPARISON, COUNTRY_ISO3, EXPLORER, SEGMENT_ORDER,
)
from cohortry.functions.display import money_short, percent_text, thousands_text, times_text
from cohortry.operators.eda import row_shares, top_levels
from cohortry.operators.scalars import one_row

FILTERS = (
    "country", "region", "acquisition_purpose", "client_type", "segment",
    "loan_applied", "referral_channel",
)


# --- filters ------------------------------------------------------------------
def _matches(choices: Mapping[str, Sequence[str]]) -> Column:
    tests = [F.col(c).isin(*values) if values else F.lit(False) for c, values in choices.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def selection(choices: Mapping[str, Sequence[str]]) -> Column:
    """True for rows whose every chosen attribute is in its list, else false.

    An empty list matches nothing, and so does a missing attribute.
    """
    return F.coalesce(_matches(choices), F.lit(False))


def filtered(segmented: DataFrame, choices: Mapping[str, Sequence[str]]) -> DataFrame:
    """The selected clients; the membership tests are plain, so they reach the scan."""
    return segmented.filter(_matches(choices))


def is_empty(view: DataFrame) -> bool:
    return view.isEmpty()


def filter_options(segmented: DataFrame, columns: Sequence[str] = FILTERS) -> DataFrame:
    """Distinct values of each filter, NULLs out: ``(attribute, level)``."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("level"))
        for c in columns
    ])
    return segmented.select(F.inline(pairs)).filter("level is not null").distinct().orderBy(
        "attribute", "level"
    )


def region_options(segmented: DataFrame, countries: Sequence[str]) -> DataFrame:
    return filtered(segmented, {"country": countries}).select("region").filter(
        "region is not null"
    ).distinct().orderBy("region")


def present_segments(segmented: DataFrame) -> DataFrame:
    """Named segments that occur, in reporting order."""
    return in_report_order(segmented.select("segment").distinct())


def segment_position(c: Column) -> Column:
    """Place in the reporting order from 1; 0 for other names."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEGMENT_ORDER]), c), F.lit(0))


def in_report_order(table: DataFrame) -> DataFrame:
    """Rows of the named segments, in reporting order."""
    return table.filter(F.col("segment").isin(*SEGMENT_ORDER)).orderBy(
        segment_position(F.col("segment"))
    )


# --- headline -----------------------------------------------------------------
def key_figures(segmented: DataFrame, choices: Mapping[str, Sequence[str]]) -> DataFrame:
    """Figures of the selection next to those of the whole book, in one scan."""
    inside = selection(choices)
    amount = F.col("total_investment")
    sums = segmented.withColumn("_in", inside).agg(
        F.count_if("_in").alias("buyers"),
        F.count("*").alias("_all"),
        F.coalesce(F.sum(F.when(F.col("_in"), amount)), F.lit(0.0)).alias("capital"),
        F.sum(amount).alias("_capital"),
        F.avg(F.when(F.col("_in"), amount)).alias("avg_per_buyer"),
        F.coalesce(F.sum(F.when(F.col("_in"), F.col("total_properties"))), F.lit(0)).alias("units"),
        F.avg(F.when(F.col("_in"), F.col("avg_property_price"))).alias("avg_ticket"),
    )
    return sums.select(
        "buyers", F.try_divide("buyers", "_all").alias("share_of_book"),
        "capital", F.try_divide("capital", "_capital").alias("share_of_capital"),
        "avg_per_buyer", "units", "avg_ticket",
    )


# --- segment tables -----------------------------------------------------------
def segment_totals(view: DataFrame) -> DataFrame:
    """Clients and capital per segment, with the label of the chart."""
    return in_report_order(view.groupBy("segment").agg(
        F.count("*").alias("clients"), F.sum("total_investment").alias("capital")
    )).withColumn("label", money_short(F.col("capital"), 2, True))


def capital_shares(view: DataFrame) -> DataFrame:
    """Share of clients, share of capital and their ratio, over the named segments."""
    sums = view.filter(F.col("segment").isin(*SEGMENT_ORDER)).groupBy("segment").agg(
        F.count("*").alias("clients"), F.sum("total_investment").alias("capital")
    )
    whole = one_row(sums.agg(F.sum("clients").alias("n"), F.sum("capital").alias("c")))
    shares = sums.withColumn("_w", whole).select(
        "segment", "clients", "capital",
        (F.col("clients") / F.col("_w.n")).alias("client_share"),
        F.try_divide("capital", F.col("_w.c")).alias("capital_share"),
    )
    return in_report_order(
        shares.withColumn("over_index", F.try_divide("capital_share", "client_share"))
    )


def capital_share_texts(view: DataFrame) -> DataFrame:
    return capital_shares(view).select(
        "segment",
        thousands_text(F.col("clients")).alias("clients"),
        money_short(F.col("capital"), 2, True).alias("capital"),
        percent_text(F.col("client_share")).alias("client_share"),
        percent_text(F.col("capital_share")).alias("capital_share"),
        times_text(F.col("over_index")).alias("over_index"),
    )


def mean_units(view: DataFrame) -> DataFrame:
    return in_report_order(view.groupBy("segment").agg(F.avg("total_properties").alias("mean_units")))


def asset_mix(view: DataFrame) -> DataFrame:
    """Mean unit mix in long form: ``(segment, asset, share)``."""
    means = view.groupBy("segment").agg(
        F.avg("apartment_share").alias("Apartment"), F.avg("office_share").alias("Office")
    )
    return in_report_order(means.unpivot("segment", ["Apartment", "Office"], "asset", "share"))


def declared_rates(view: DataFrame) -> DataFrame:
    return in_report_order(view.groupBy("segment").agg(
        F.avg("loan_flag").alias("loan_rate"),
        F.avg("is_investment").alias("investment_rate"),
        F.avg("is_company").alias("company_rate"),
    ))


# --- geography ----------------------------------------------------------------
def iso3(country: Column) -> Column:
    pairs = [F.lit(x) for pair in COUNTRY_ISO3.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), country)


def country_totals(view: DataFrame) -> DataFrame:
    """Clients, capital and mean per country with its code, most clients first."""
    return (
        view.filter("country is not null").groupBy("country").agg(
            F.count("*").alias("clients"), F.sum("total_investment").alias("capital"),
            F.avg("total_investment").alias("avg_investment"),
        )
        .withColumn("iso3", iso3(F.col("country")))
        .orderBy(F.desc("clients"), "country")
    )


def mapped_countries(view: DataFrame) -> DataFrame:
    """Country totals that have a place on the map."""
    return country_totals(view).dropna(subset=["iso3"])


def country_total_texts(view: DataFrame) -> DataFrame:
    return country_totals(view).select(
        "country", thousands_text(F.col("clients")).alias("clients"),
        money_short(F.col("capital"), 2, True).alias("capital"),
        money_short(F.col("avg_investment"), 2, True).alias("avg_investment"),
    )


def top_regions(view: DataFrame, n: int = 12) -> DataFrame:
    return top_levels(view, "region", n)


def in_top_regions(view: DataFrame, n: int = 12) -> DataFrame:
    """Clients of the n largest regions; the region list has n rows."""
    best = top_regions(view, n).select(F.col("level").alias("region"))
    return view.join(F.broadcast(best), "region", "left_semi")


def region_mix(view: DataFrame, n: int = 12) -> DataFrame:
    """Segment shares within each of the n largest regions."""
    return row_shares(view, "region", "segment", n)


# --- one segment --------------------------------------------------------------
def segment_slice(view: DataFrame, segment: str) -> DataFrame:
    return view.filter(F.col("segment") == segment)


def slice_statistics(view: DataFrame, segment: str) -> DataFrame:
    return segment_slice(view, segment).agg(
        F.count("*").alias("clients"), F.avg("total_investment").alias("avg_capital"),
        F.avg("avg_property_price").alias("avg_ticket"), F.avg("total_properties").alias("avg_units"),
        F.avg("avg_floor_area").alias("avg_area"), F.avg("loan_flag").alias("loan_rate"),
        F.avg("is_investment").alias("investment_rate"),
        F.avg("purchase_span_days").alias("avg_span_days"),
    )


def book_comparison(segmented: DataFrame, choices: Mapping[str, Sequence[str]], segment: str,
                    columns: Sequence[str] = BOOK_COMPARISON) -> DataFrame:
    """Mean of a segment in the selection against the whole book, in one scan."""
    inside = selection(choices) & F.coalesce(F.col("segment") == segment, F.lit(False))
    row = segmented.withColumn("_in", inside).agg(*[
        F.struct(F.avg(F.when(F.col("_in"), F.col(c))).alias("s"), F.avg(c).alias("b")).alias(c)
        for c in columns
    ])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c)["s"].alias("segment_mean"),
                 F.col(c)["b"].alias("book_mean"),
                 F.try_divide(F.col(c)["s"], F.col(c)["b"]).alias("index_vs_book"))
        for c in columns
    ])))


def book_comparison_texts(segmented: DataFrame, choices: Mapping[str, Sequence[str]],
                          segment: str) -> DataFrame:
    return book_comparison(segmented, choices, segment).select(
        "feature", thousands_text(F.col("segment_mean"), 2).alias("segment_mean"),
        thousands_text(F.col("book_mean"), 2).alias("book_mean"),
        times_text(F.col("index_vs_book")).alias("index_vs_book"),
    )


def client_explorer(view: DataFrame) -> DataFrame:
    """The client list, most capital first."""
    return view.select(*EXPLORER).orderBy(F.desc("total_investment"), "client_id")
