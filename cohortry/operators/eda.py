"""Exploratory tables: frequencies, histograms, quartiles, correlations, group tests."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.config import CORRELATED
from cohortry.functions import parsing as P
from cohortry.functions.stats import pearson, sample_skewness, student_t_p, variation
from cohortry.operators.moments import co_moments
from cohortry.operators.quantiles import exact_quantiles, quantile_row
from cohortry.operators.scalars import one_row


def _long(row: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row of structs named after ``columns`` to one row per feature."""
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(c)[f].alias(f) for f in fields])
        for c in columns
    ])))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """``(level, n)`` without NULLs; report order is n descending, then level."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n"))
    )


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency tables of several columns from one scan: ``(attribute, level, n)``."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("level"))
        for c in columns
    ])
    return (
        df.select(F.inline(pairs)).filter("level is not null")
        .groupBy("attribute", "level").agg(F.count("*").alias("n"))
    )


def top_levels(df: DataFrame, column: str, n: int) -> DataFrame:
    return frequency(df, column).orderBy(F.desc("n"), "level").limit(n)


def null_key_table(ledger: DataFrame) -> DataFrame:
    """Every status with and without a key, also where no row is."""
    return ledger.groupBy("listing_status").agg(
        F.count_if(F.col("client_ref").isNull()).alias("m"), F.count("client_ref").alias("k")
    ).select("listing_status", F.inline(F.array(
        F.struct(F.lit(True).alias("key_missing"), F.col("m").alias("n")),
        F.struct(F.lit(False).alias("key_missing"), F.col("k").alias("n")),
    )))


def numeric_summary(df: DataFrame, columns: Sequence[str] = CORRELATED) -> DataFrame:
    """count, mean, sample sd, min, quartiles, max per column."""
    moments = df.agg(*[
        F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"),
                 F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c)
        for c in columns
    ])
    quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75)).groupBy("feature").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"),
    )
    return _long(moments, columns, ("n", "mean", "sd", "low", "high")).join(
        quartiles, "feature", "left"
    ).select("feature", "n", "mean", "sd", "low", "q1", "median", "q3", "high")


def correlations(df: DataFrame, columns: Sequence[str] = CORRELATED) -> DataFrame:
    """Pairs i < j of the correlation matrix over rows where both are known: ``(a, b, r)``.

    Each task folds its rows into one small set of co-moments for all pairs. A constant column gives no correlation.
    """
    n, x, xx, xy = co_moments(df, columns)
    rows = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            if not n[i, j]:
                continue
            ma, mb = x[i, j] / n[i, j], x[j, i] / n[i, j]
            qa, qb = xx[i, j] / n[i, j], xx[j, i] / n[i, j]
            va, vb = qa - ma * ma, qb - mb * mb
            known = va > 1e-13 * qa and vb > 1e-13 * qb
            rows.append((a, columns[j], float((xy[i, j] / n[i, j] - ma * mb) / (va * vb) ** 0.5) if known else None))
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def correlation_matrix(df: DataFrame, columns: Sequence[str] = CORRELATED) -> DataFrame:
    """The full square in long form, diagonal included."""
    upper = correlations(df, columns)
    both = F.array(
        F.struct(F.col("a").alias("a"), F.col("b").alias("b"), F.col("r").alias("r")),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("r").alias("r")),
    )
    diagonal = df.agg(*[
        F.when(F.stddev_pop(c) > 0, 1.0).alias(c) for c in columns
    ]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.col(c).alias("r")) for c in columns
    ])))
    return upper.select(F.inline(both)).unionByName(diagonal)


def strong_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.75) -> DataFrame:
    return correlations(df, columns).filter(F.abs("r") >= threshold).orderBy(
        F.desc(F.abs("r")), "a", "b"
    )


def outcome_correlations(df: DataFrame, columns: Sequence[str], outcome: str) -> DataFrame:
    row = df.agg(*[pearson(c, outcome).alias(c) for c in columns])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in columns
    ])))


def centre_marks(df: DataFrame, column: str) -> DataFrame:
    """Mean and median of a column."""
    return quantile_row(df, column, (0.5,)).select(
        one_row(df.agg(F.avg(column).alias("mean")))["mean"].alias("mean"),
        F.col("q0").alias("median"),
    )


def variations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coefficient of variation per column, ascending."""
    row = df.agg(*[F.struct(variation(c).alias("cv")).alias(c) for c in columns])
    return _long(row, columns, ("cv",)).orderBy("cv", "feature")


def skews(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adjusted skewness per column, descending."""
    row = df.agg(*[F.struct(sample_skewness(c).alias("skew")).alias(c) for c in columns])
    return _long(row, columns, ("skew",)).orderBy(F.desc("skew"), "feature")


def monthly_sales(ledger: DataFrame) -> DataFrame:
    return (
        ledger.filter("listing_status = 'Sold' and transaction_date is not null")
        .groupBy(F.trunc("transaction_date", "month").alias("month"))
        .agg(F.count("*").alias("sales"))
    )


def _all_bins(counts: DataFrame, bins: int) -> DataFrame:
    """``(bin, n)`` with every bin from 0, also those without a row."""
    every = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def fixed_histogram(df: DataFrame, column: str, start: float, stop: float, step: float) -> DataFrame:
    """Counts in [start, stop] by ``step``, last bin closed, empty bins with 0; values outside are not counted."""
    last = int((stop - start) / step) - 1
    x = F.col(column)
    place = F.least(F.floor((x - start) / step), F.lit(last))
    counts = df.filter(x.between(start, stop)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return _all_bins(counts, last + 1).select(
        "bin", (F.lit(start) + F.col("bin") * step).cast("double").alias("from_value"), "n")


def equal_histogram(df: DataFrame, column: str, bins: int = 45) -> DataFrame:
    """Counts in ``bins`` equal steps from minimum to maximum, empty bins with 0."""
    x = F.col(column)
    values = df.filter(x.isNotNull()).select(x.cast("double").alias("x"))
    ends = one_row(values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    width = F.col("_e.hi") - F.col("_e.lo")
    place = F.least(F.floor(F.coalesce(
        F.try_divide((F.col("x") - F.col("_e.lo")) * bins, width), F.lit(0.0)
    )), F.lit(bins - 1))
    return _all_bins(
        values.withColumn("_e", ends).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n")), bins)


def box_statistics(df: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 quartile ranges and outlier count per group; groups may be many."""
    quartiles = quantile_row(df, column, (0.25, 0.5, 0.75), by)
    x = F.col(column)
    rows = df.filter(x.isNotNull() & F.col(by).isNotNull()).select(by, x.cast("double").alias("x")).join(quartiles, by)
    reach = (F.col("q2") - F.col("q0")) * 1.5
    inside = F.col("x").between(F.col("q0") - reach, F.col("q2") + reach)
    return rows.groupBy(by).agg(
        F.count("*").alias("n"),
        F.max("q0").alias("q1"), F.max("q1").alias("median"), F.max("q2").alias("q3"),
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def outcome_by_attributes(df: DataFrame, attributes: Sequence[str], outcome: str) -> DataFrame:
    """Mean outcome per level of several attributes and overall, from one scan.

    Attribute ``overall`` holds the mean of all rows.
    """
    pairs = [F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("level"))
             for c in attributes]
    pairs.append(F.struct(F.lit("overall").alias("attribute"), F.lit("all").alias("level")))
    return (
        df.select(outcome, F.inline(F.array(*pairs))).filter("level is not null")
        .groupBy("attribute", "level")
        .agg(F.count("*").alias("n"), F.avg(outcome).alias("mean_outcome"))
    )


def welch_tests(df: DataFrame, attributes: Sequence[str], outcome: str) -> DataFrame:
    """Welch t-test and Cohen's d of ``outcome`` for attributes of two levels.

    The groups shrink to six numbers each; p comes from those few rows. An
    attribute with another number of levels is returned with that number in
    ``levels`` and NULL results.
    """
    pairs = F.array(*[
        F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("level"))
        for c in attributes
    ])
    moments = (
        df.select(F.col(outcome).cast("double").alias("y"), F.inline(pairs))
        .filter("level is not null").groupBy("attribute", "level")
        .agg(F.count("y").alias("n"), F.avg("y").alias("m"), F.var_samp("y").alias("v"))
    )
    sides = moments.groupBy("attribute").agg(
        F.count("*").alias("levels"),
        F.min(F.struct("level", "n", "m", "v")).alias("g1"),
        F.max(F.struct("level", "n", "m", "v")).alias("g2"),
    )
    sides = sides.withColumns({g: F.when(F.col("levels") == 2, F.col(g)) for g in ("g1", "g2")})
    n1, n2 = F.col("g1.n"), F.col("g2.n")
    v1, v2 = F.col("g1.v"), F.col("g2.v")
    e1, e2 = F.try_divide(v1, n1), F.try_divide(v2, n2)
    gap = F.col("g1.m") - F.col("g2.m")
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    scored = sides.select(
        "attribute", F.col("g1.level").alias("level_1"), F.col("g2.level").alias("level_2"),
        n1.alias("n_1"), n2.alias("n_2"),
        F.try_divide(gap, F.sqrt(e1 + e2)).alias("t"),
        F.try_divide(
            (e1 + e2) * (e1 + e2),
            F.try_divide(e1 * e1, n1 - 1) + F.try_divide(e2 * e2, n2 - 1),
        ).alias("df"),
        F.try_divide(gap, pooled).alias("cohens_d"), "levels",
    )
    return scored.withColumn("p", student_t_p(F.col("t"), F.col("df")))


def mask_frequency(df: DataFrame, column: str) -> DataFrame:
    """How often each text format occurs."""
    return df.groupBy(P.format_mask(F.col(column)).alias("mask")).agg(F.count("*").alias("n"))


def component_ranges(df: DataFrame, column: str) -> DataFrame:
    """Ranges of the first two date parts for dashed and for slashed texts."""
    c = F.col(column)
    kind = F.when(c.contains("-"), "dash").when(c.contains("/"), "slash")
    return (
        df.select(kind.alias("kind"), P.date_component(c, 0).alias("p1"),
                  P.date_component(c, 1).alias("p2"))
        .filter("kind is not null").groupBy("kind")
        .agg(F.count("*").alias("n"), F.min("p1").alias("first_min"), F.max("p1").alias("first_max"),
             F.min("p2").alias("second_min"), F.max("p2").alias("second_max"))
    )


def reading_order_sensitivity(df: DataFrame, column: str) -> DataFrame:
    """Dates and years that change when day and month swap places."""
    both = df.select(P.mixed_date(F.col(column)).alias("m"), P.mixed_date(F.col(column), True).alias("d"))
    return both.agg(
        F.count_if(F.col("m") != F.col("d")).alias("dates_differ"),
        F.count_if(F.year("m") != F.year("d")).alias("years_differ"),
    )


def row_shares(df: DataFrame, row: str, column: str, top: int) -> DataFrame:
    """Share of each ``column`` level within the ``top`` most frequent ``row`` levels, also where no row is.

    Counting comes first, so the choice of rows and the zero cells work on the small table. The levels are those
    that the chosen rows have.
    """
    best = top_levels(df, row, top).select(F.col("level").alias(row))
    cells = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(
        F.count("*").alias("n")).join(best, row, "left_semi")
    levels = cells.agg(F.collect_set(column)).scalar()
    per_row = cells.groupBy(row).agg(
        F.map_from_entries(F.collect_list(F.struct(column, "n"))).alias("m"), F.sum("n").alias("total"))
    counted = per_row.select(row, "m", "total", F.explode(levels).alias(column)).withColumn(
        "n", F.coalesce(F.try_element_at("m", F.col(column)), F.lit(0)))
    return counted.select(row, column, "n", (F.col("n") / F.col("total")).alias("share"))
