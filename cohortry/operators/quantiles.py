"""Exact interpolated quantiles that never gather a column in one task.

A first pass narrows every wanted rank to a bracket of values with the
mergeable sketch behind ``percentile_approx``. A second counts what lies
outside the bracket, and only the values inside it are sorted. The result is
exact: neighbours just outside the bracket are kept with their ranks, and a
rank that is still not covered raises an error.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ACCURACY = 10000
_MARGIN = 8.0 / _ACCURACY


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: str | None = None,
) -> DataFrame:
    """Long table ``([by,] feature, prob, value)`` with linear interpolation.

    ``by`` names one grouping column, also with very many values: the brackets are joined by it. NULLs are skipped.
    """
    keys = [by] if by else []
    source = df.filter(F.col(by).isNotNull()) if by else df
    long = source.select(
        *keys, F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("fi", "v")
    )

    edges = [p + s * _MARGIN for p in probs for s in (-1, 1)]
    inner = [min(max(e, 0.0), 1.0) for e in edges]
    sketch = long.groupBy(*keys, "fi").agg(
        F.percentile_approx("v", inner, _ACCURACY).alias("e"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    lo = [F.col("lo") if e <= 0 else F.col("e")[2 * i] for i, e in enumerate(edges[0::2])]
    hi = [F.col("hi") if e >= 1 else F.col("e")[2 * i + 1] for i, e in enumerate(edges[1::2])]
    brackets = (
        sketch.select(*keys, F.struct("fi", F.array(*lo).alias("lo"), F.array(*hi).alias("hi")).alias("b"))
        .groupBy(*keys).agg(F.array_sort(F.collect_list("b")).alias("bs"))
    )
    known = long.filter(F.col("v").isNotNull())
    known = known.join(brackets, by) if by else known.withColumn("bs", brackets.scalar())
    rows = (
        known.withColumn("b", F.get(F.col("bs"), F.col("fi")))
        .select(*keys, "fi", "v", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))
    )

    # What lies outside each bracket.
    v, slots = F.col("v"), range(len(probs))
    counted = rows.groupBy(*keys, "fi").agg(F.count("*").alias("n"), *[
        x for j in slots for x in (
            F.count_if(v < F.col("lo")[j]).alias(f"below_{j}"),
            F.max(F.when(v < F.col("lo")[j], v)).alias(f"prev_{j}"),
            F.count_if(v > F.col("hi")[j]).alias(f"above_{j}"),
            F.min(F.when(v > F.col("hi")[j], v)).alias(f"next_{j}"),
        )
    ])
    outside = counted.select(*keys, "fi", "n", F.inline(F.array(*[
        F.struct(F.lit(j).alias("pi"), F.lit(float(probs[j])).alias("prob"),
                 *[F.col(f"{f}_{j}").alias(f) for f in ("below", "prev", "above", "next")])
        for j in slots
    ])))
    exact = (F.col("n") - 1) * F.col("prob")
    # A position that is whole but for rounding is that rank.
    at = F.when(F.abs(exact - F.round(exact)) <= 1e-9 + F.col("n") * 1e-14, F.round(exact)).otherwise(exact)
    outside = outside.select("*", F.floor(at).alias("r0"), (at - F.floor(at)).alias("frac"))

    # What lies inside, sorted.
    hits = F.array_compact(F.array(*[
        F.when(v.between(F.col("lo")[j], F.col("hi")[j]), F.lit(j)) for j in slots
    ]))
    group = [*keys, "fi", "pi"]
    running = Window.partitionBy(*group).orderBy("v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    inside = (
        rows.select(*keys, "fi", "v", F.explode(hits).alias("pi"))
        .groupBy(*group, "v").agg(F.count("*").alias("cnt"))
        .withColumn("upto", F.sum("cnt").over(running))
    )

    def pick(offset: int):
        rank = F.col("r0") + offset
        start = F.col("below") + F.col("upto") - F.col("cnt")
        here = F.max(F.when((rank >= start) & (rank < F.col("below") + F.col("upto")), F.col("v")))
        prev = F.max(F.when(rank == F.col("below") - 1, F.col("prev")))
        nxt = F.max(F.when(rank == F.col("n") - F.col("above"), F.col("next")))
        return F.coalesce(here, prev, nxt)

    picked = outside.join(inside, group, "left").groupBy(*group, "prob", "frac").agg(
        pick(0).alias("v0"), pick(1).alias("v1")
    )
    missing = F.raise_error(F.lit("quantile rank not covered")).cast("double")
    step = F.when(F.col("frac") > 0, (F.coalesce("v1", missing) - F.col("v0")) * F.col("frac"))
    feature = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("fi") + 1)
    return picked.select(
        *keys, feature.alias("feature"), "prob",
        (F.coalesce("v0", missing) + F.coalesce(step, F.lit(0.0))).alias("value"),
    )


def quantile_row(df: DataFrame, column: str, probs: Sequence[float],
                 by: str | None = None) -> DataFrame:
    """Quantiles of one column side by side: ``([by,] q0, q1, ...)``."""
    long = exact_quantiles(df, [column], probs, by)
    wide = [
        F.max(F.when(F.col("prob") == float(p), F.col("value"))).alias(f"q{j}")
        for j, p in enumerate(probs)
    ]
    return long.groupBy(*([by] if by else [])).agg(*wide)
