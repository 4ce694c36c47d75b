"""Statistics as column expressions."""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def pearson(a: str, b: str) -> Column:
    """Correlation; NULL when a column is constant (the built-in raises then)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def sample_skewness(c: str) -> Column:
    """Adjusted Fisher-Pearson skewness; NULL below three values."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def variation(c: str) -> Column:
    return F.abs(F.try_divide(F.stddev_samp(c), F.avg(c)))


def ln_factorial(n: Column) -> Column:
    """ln(n!) by table below 10 and the Stirling series above."""
    small = F.array(*[F.lit(math.lgamma(i + 1.0)) for i in range(10)])
    x = n.cast("double") + 1.0
    series = (
        (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi)
        + 1.0 / (12.0 * x) - 1.0 / (360.0 * x * x * x)
        + 1.0 / (1260.0 * F.pow(x, F.lit(5.0))) - 1.0 / (1680.0 * F.pow(x, F.lit(7.0)))
    )
    return F.when(n < 10, F.get(small, n.cast("int"))).otherwise(series)


def student_t_p(t: Column, df: Column) -> Column:
    """Two-sided Student-t probability; meant for the few rows of a test table.

    The helper is nested so that it travels with the function and executors
    need no copy of this package.
    """
    def tail(t_value: float, freedom: float) -> float:
        # Regularised incomplete beta function at df / (df + t^2), a = df / 2, b = 1 / 2.
        if not (math.isfinite(t_value) and freedom > 0):
            return float("nan")
        x, a, b = freedom / (freedom + t_value * t_value), freedom / 2.0, 0.5
        if x >= 1.0:
            return 1.0
        if x <= 0.0:
            return 0.0
        swapped = x > (a + 1.0) / (a + b + 2.0)
        if swapped:
            x, a, b = 1.0 - x, b, a
        scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                         + a * math.log(x) + b * math.log1p(-x)) / a
        # Continued fraction 1 / (1 + d1 / (1 + d2 / ...)), from the far end.
        value = 1.0
        for step in range(400, 0, -1):
            m = step // 2
            if step % 2:
                d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            else:
                d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            value = 1.0 + d / value
        part = scale / value
        return 1.0 - part if swapped else part

    @F.pandas_udf(DoubleType())
    def p_value(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([tail(a, b) for a, b in zip(ts.astype(float), dfs.astype(float))], dtype=float)

    return p_value(t, df)
