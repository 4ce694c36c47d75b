"""Feature matrices: scaling, one-hot columns and assembly as a saved pipeline."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.config import LOGGED, SCALERS, FeatureSet


@dataclass(frozen=True)
class Matrix:
    """``df`` keeps all its columns and gains ``x_0 .. x_d-1`` and ``features``."""

    df: DataFrame
    names: list[str]
    columns: list[str]
    model: PipelineModel


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def require_complete(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise when a column that is measured or modelled holds NULLs; rows are never dropped for it."""
    missing = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict()
    short = {c: n for c, n in missing.items() if n}
    if short:
        raise ValueError(f"values are missing, fill them or fix their source: {short}")


def scaling_terms(df: DataFrame, fs: FeatureSet, scaler: str) -> list[tuple[str, str]]:
    """``(name, SQL expression)`` of the scaled numbers; one aggregate of one row.

    Standard scaling divides by the population deviation. A constant column
    becomes 0.
    """
    if scaler not in SCALERS:
        raise ValueError(f"unknown scaler {scaler!r}")
    base = {
        c: f"ln(1 + `{c}`)" if scaler == "log_standard" and c in LOGGED else f"`{c}`"
        for c in fs.numeric
    }
    source = {
        c: F.log1p(F.col(c)) if scaler == "log_standard" and c in LOGGED else F.col(c)
        for c in fs.numeric
    }
    stats = df.agg(*[
        F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"),
                 F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi")).alias(c)
        for c, x in source.items()
    ]).first()
    out = []
    for c, text in base.items():
        s = stats[c]
        shift = s["lo"] if scaler == "minmax" else s["mean"]
        span = (s["hi"] - s["lo"]) if scaler == "minmax" else s["sd"]
        if not span or s["lo"] == s["hi"]:
            out.append((c, "0D"))
        else:
            out.append((c, f"({text} - ({shift!r}D)) / {span!r}D"))
    return out


def one_hot_terms(df: DataFrame, fs: FeatureSet) -> list[tuple[str, str]]:
    """Sorted levels as 0/1 columns; two levels give one column, unknown levels zeros.

    A column per level is what the method asks for: the levels are the width of the matrix.
    """
    out = []
    for c in fs.categorical:
        levels = sorted(r[0] for r in df.select(c).distinct().collect() if r[0] is not None)
        for level in levels[1:] if len(levels) == 2 else levels:
            out.append((f"{c}_{level}", f"IF(`{c}` <=> {_quoted(level)}, 1D, 0D)"))
    return out


def build_matrix(df: DataFrame, fs: FeatureSet, scaler: str = "standard") -> Matrix:
    """Scaled numbers, one-hot columns and the vector, next to the key."""
    terms = scaling_terms(df, fs, scaler) + one_hot_terms(df, fs)
    columns = [f"x_{i}" for i in range(len(terms))]
    picked = ", ".join(f"{sql} AS {x}" for x, (_, sql) in zip(columns, terms))
    model = PipelineModel([
        SQLTransformer(statement=f"SELECT *, {picked} FROM __THIS__"),
        VectorAssembler(inputCols=columns, outputCol="features"),
    ])
    return Matrix(model.transform(df), [n for n, _ in terms], columns, model)


def named_matrix(matrix: Matrix, key: str = "client_id") -> DataFrame:
    """Key and scaled columns under their feature names."""
    return matrix.df.select(
        key, *[F.col(x).alias(n) for x, n in zip(matrix.columns, matrix.names)]
    )
