"""Right-closed bands with an order column."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.config import AGE_BANDS, INVESTMENT_BANDS


def _first_reached(x: Column, steps: list[tuple[Column, object]]) -> Column:
    out = None
    for edge, value in steps:
        out = F.when(x <= edge, F.lit(value)) if out is None else out.when(x <= edge, F.lit(value))
    return out


def age_band(age: Column) -> Column:
    """Label of the age band; NULL outside (0, 200]."""
    steps = [(F.lit(edge), label) for edge, label in AGE_BANDS]
    return F.when(age > 0, _first_reached(age, steps))


def age_band_order(age: Column) -> Column:
    steps = [(F.lit(edge), i) for i, (edge, _) in enumerate(AGE_BANDS)]
    return F.when(age > 0, _first_reached(age, steps))


def quartile_order(x: Column, q1: Column, q2: Column, q3: Column) -> Column:
    """0 to 3 by right-closed quartile edges; equal edges merge their bands."""
    inner = F.when(x <= q1, 0).when(x <= q2, 1).when(x <= q3, 2).when(x.isNotNull(), 3)
    return inner.cast("int")


def quartile_band(order: Column) -> Column:
    return F.element_at(F.array(*[F.lit(b) for b in INVESTMENT_BANDS]), order + 1)
