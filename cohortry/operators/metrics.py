"""Measures of a labelled table. All take optional ``by`` columns.

Every measure starts from aggregates with a partial form; what follows works
on one row per label and feature. With ``by`` one pass serves many labelings
of the same rows (see ``stack_labels``).
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.config import BEHAVIOUR_CORE, BUYER_FLAGS, DECLARED
from cohortry.operators.scalars import one_row
from cohortry.session import stage_table


def stack_labels(df: DataFrame, label_columns: dict[object, str], key: str = "k") -> DataFrame:
    """One copy of each row per labeling: adds ``key`` and ``label``."""
    options = [F.struct(F.lit(k).alias(key), F.col(c).alias("label")) for k, c in label_columns.items()]
    return df.withColumn("_s", F.explode(F.array(*options))).select("*", "_s.*").drop("_s")


def label_moments(df: DataFrame, label: str, columns: Sequence[str],
                  by: Sequence[str] = ()) -> DataFrame:
    """``(by.., label, feature, n, mean, ss, lo, hi)``; ss is the squared deviation sum.

    All columns go through one vector aggregate; they must not hold NULLs.
    """
    vector = array_to_vector(F.array(*[F.col(c).cast("double") for c in columns]))
    summary = Summarizer.metrics("mean", "variance", "min", "max").summary(F.col("_v"))
    wide = df.select(*by, label, vector.alias("_v")).groupBy(*by, label).agg(
        F.count("*").alias("n"), summary.alias("_s")
    )
    names = F.array(*[F.lit(c) for c in columns])
    parts = [vector_to_array(F.col(f"_s.{f}")) for f in ("mean", "variance", "min", "max")]
    long = wide.select(*by, label, "n", F.explode(F.arrays_zip(names, *parts)).alias("_z")).select(
        *by, label, "n", F.col("_z.0").alias("feature"), F.col("_z.1").alias("mean"),
        (F.col("_z.2") * (F.col("n") - 1)).alias("ss"), F.col("_z.3").alias("lo"), F.col("_z.4").alias("hi"),
    )
    return long


def feature_separation(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by.., feature, n, smallest, labels, ssb, ssw, eta_squared)`` from label moments."""
    group = Window.partitionBy(*by, "feature")
    grand = F.sum(F.col("n") * F.col("mean")).over(group) / F.sum("n").over(group)
    sums = moments.withColumn("_g", grand).groupBy(*by, "feature").agg(
        F.sum("n").alias("n"), F.min("n").alias("smallest"), F.count("*").alias("labels"),
        F.sum(F.col("n") * (F.col("mean") - F.col("_g")) * (F.col("mean") - F.col("_g"))).alias("ssb"),
        F.sum("ss").alias("ssw"),
        (F.min("lo") == F.max("hi")).alias("constant"),
    )
    eta = F.when(F.col("constant"), 0.0).otherwise(
        F.coalesce(F.try_divide("ssb", F.col("ssb") + F.col("ssw")), F.lit(0.0))
    )
    return sums.withColumn("eta_squared", eta).drop("constant")


def eta_squared(df: DataFrame, label: str, columns: Sequence[str] = BEHAVIOUR_CORE,
                by: Sequence[str] = ()) -> DataFrame:
    """``(by.., feature, eta_squared)``: share of each column's variance that the labels explain; 0 for a constant.

    Means and variance are those of the known values; a label weighs with all its rows, and one
    without a known value does not count.
    """
    stats = df.groupBy(*by, label).agg(F.count("*").alias("rows"), *[
        F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("v"),
                 F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(f"s_{i}")
        for i, c in enumerate(columns)])
    long = stats.select(*by, "rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"s_{i}").alias("s")) for i, c in enumerate(columns)])))
    group = Window.partitionBy(*by, "feature")
    grand = F.sum(F.col("s.n") * F.col("s.mean")).over(group) / F.sum("s.n").over(group)
    gap = F.col("s.mean") - F.col("g")
    sums = long.withColumn("g", grand).groupBy(*by, "feature").agg(
        F.sum(F.col("rows") * gap * gap).alias("between"), F.sum(F.col("s.n") * (F.col("s.v") + gap * gap)).alias("whole"),
        (F.min("s.lo") == F.max("s.hi")).alias("constant"))
    share = F.when(F.col("constant"), 0.0).otherwise(F.coalesce(F.try_divide("between", "whole"), F.lit(0.0)))
    return sums.select(*by, "feature", share.alias("eta_squared"))


def _mean_separation() -> list[Column]:
    return [
        F.avg(F.when(F.col("feature").isin(*group), F.col("eta_squared"))).alias(name)
        for name, group in (("behavioural_separation", BEHAVIOUR_CORE), ("declared_separation", DECLARED))
    ]


def separation(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean eta squared of the behaviour and of the declared columns."""
    columns = list(dict.fromkeys(BEHAVIOUR_CORE + DECLARED))
    return eta_squared(df, label, columns, by).groupBy(*by).agg(*_mean_separation())


def _ratio() -> Column:
    return F.try_divide(
        F.try_divide("ssb", F.col("labels") - 1),
        F.try_divide("inertia", F.col("rows") - F.col("labels")),
    ).alias("calinski_harabasz")


def variance_ratio(df: DataFrame, label: str, columns: Sequence[str],
                   by: Sequence[str] = ()) -> DataFrame:
    """``(by.., rows, labels, inertia, calinski_harabasz)`` from one pass."""
    parts = feature_separation(label_moments(df, label, columns, by), by)
    return parts.groupBy(*by).agg(
        F.max("n").alias("rows"), F.max("labels").alias("labels"),
        F.sum("ssw").alias("inertia"), F.sum("ssb").alias("ssb"),
    ).select(*by, "rows", "labels", "inertia", _ratio())


def _distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def davies_bouldin(df: DataFrame, label: str, columns: Sequence[str],
                   by: Sequence[str] = ()) -> DataFrame:
    """``(by.., davies_bouldin)``: centroids, then mean distance to them.

    There is one centroid per label of the model; Spark picks the join with them by their size. The
    comparison of centroids works on an array of them.
    """
    point = F.array(*[F.col(c).cast("double") for c in columns])
    centres = df.groupBy(*by, label).agg(F.array(*[F.avg(c) for c in columns]).alias("_c"))
    keys = [*by, label]
    spread = (
        df.select(*keys, point.alias("_p")).join(centres, keys)
        .groupBy(*keys).agg(F.avg(_distance(F.col("_p"), F.col("_c"))).alias("s"),
                            F.first("_c").alias("c"))
    )
    tops = spread.groupBy(*by).agg(F.array_sort(F.collect_list(
        F.struct(F.col(label).alias("l"), F.col("s"), F.col("c"))
    )).alias("t"))
    worst = F.transform("t", lambda i: F.array_max(F.transform(
        F.filter("t", lambda j: j["l"] != i["l"]),
        lambda j: F.coalesce(F.try_divide(i["s"] + j["s"], _distance(i["c"], j["c"])), F.lit(0.0)),
    )))
    mean = F.aggregate(worst, F.lit(0.0), lambda a, x: a + x) / F.size("t")
    return tops.select(*by, mean.alias("davies_bouldin"))


def cluster_sizes(df: DataFrame, label: str, k: int | Column, by: Sequence[str] = ()) -> DataFrame:
    """``(by.., min_cluster_size, min_cluster_pct)``; a label of 0..k-1 without rows counts as 0."""
    want = F.lit(k) if isinstance(k, int) else k
    sizes = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    smallest = sizes.groupBy(*by).agg(
        F.min("n").alias("_m"), F.count("*").alias("_k"), F.sum("n").alias("_n")
    )
    size = F.when(F.col("_k") < want, F.lit(0).cast("bigint")).otherwise(F.col("_m"))
    return smallest.select(
        *by, size.alias("min_cluster_size"),
        F.try_divide(size, F.col("_n")).alias("min_cluster_pct"),
    )


# --- agreement of two labelings ----------------------------------------------
def contingency(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by.., a, b, nij)``."""
    return df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("nij"))


def _pairs(n: Column) -> Column:
    x = n.cast("double")
    return x * (x - 1) / 2


def _rand(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """From sums over the cells and over the label sizes of each side; no cell is looked up beside another."""
    whole = cells.groupBy(*by).agg(F.sum(_pairs(F.col("nij"))).alias("s"), _pairs(F.sum("nij")).alias("p"))
    sides = [
        cells.groupBy(*by, side).agg(F.sum("nij").alias("n")).groupBy(*by).agg(F.sum(_pairs(F.col("n"))).alias(f"s{side}"))
        for side in ("a", "b")
    ]
    if by:
        parts = whole.join(sides[0], list(by)).join(sides[1], list(by))
    else:
        parts = whole.select("*", sides[0].scalar().alias("sa"), sides[1].scalar().alias("sb"))
    expected = F.try_divide(F.col("sa") * F.col("sb"), F.col("p"))
    top, bottom = F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected
    return parts.select(*by, F.coalesce(F.try_divide(top, bottom), F.lit(1.0)).alias("adjusted_rand"))


def adjusted_rand(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by.., adjusted_rand)``; 1 when nothing could differ."""
    return _rand(contingency(df, a, b, by), by)


_TERMS_PER_ROW = 50_000


def _expected_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the terms of each chunk; the probabilities follow from each other along it."""
    for batch in batches:
        out = []
        for n, x, y, times, first, last in zip(*[batch.column(c).to_pylist() for c in ("n", "x", "y", "times", "first", "last")]):
            m = np.arange(first, last + 1, dtype=float)
            start = (math.lgamma(x + 1) + math.lgamma(y + 1) + math.lgamma(n - x + 1) + math.lgamma(n - y + 1) - math.lgamma(n + 1)
                     - math.lgamma(first + 1) - math.lgamma(x - first + 1) - math.lgamma(y - first + 1) - math.lgamma(n - x - y + first + 1))
            step = (x - m[:-1]) * (y - m[:-1]) / (m[1:] * (n - x - y + m[1:]))
            p = np.exp(start + np.r_[0.0, np.cumsum(np.log(step))])
            out.append(times * float((m / n * np.log(n * m / (float(x) * y)) * p).sum()))
        yield pa.record_batch([pa.array(out, pa.float64())], names=["e"])


def _expected_information(sizes_a: DataFrame, sizes_b: DataFrame, n: Column) -> DataFrame:
    """Expected mutual information of random labelings with these sizes: one row ``emi``.

    Labels of one size are alike, so pairs of sizes are worked, with how often they occur: ``sizes``
    is ``(x, times)``. There are at most about the square root of twice the rows different sizes. Long ranges of
    terms are cut into chunks, which spread over the tasks.
    """
    other = sizes_b.agg(F.collect_list(F.struct(F.col("x").alias("y"), F.col("times").alias("times_b")))).scalar()
    pairs = sizes_a.select("x", "times", n.alias("n"), F.inline(other))
    ranged = pairs.select(
        "n", "x", "y", (F.col("times") * F.col("times_b")).alias("times"),
        F.greatest(F.lit(1), F.col("x") + F.col("y") - F.col("n")).alias("first"), F.least("x", "y").alias("end"))
    chunked = ranged.select("*", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("end") - F.col("first")) / _TERMS_PER_ROW)
    )).alias("chunk"))
    start = F.col("first") + F.col("chunk") * _TERMS_PER_ROW
    terms = chunked.select("n", "x", "y", "times", start.alias("first"), F.least("end", start + (_TERMS_PER_ROW - 1)).alias("last"))
    return terms.repartition("x", "y", "first").mapInArrow(_expected_terms, "e double").agg(
        F.coalesce(F.sum("e"), F.lit(0.0)).alias("emi"))


def compare_partitions(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``(adjusted_rand, adjusted_mutual_info)``; arithmetic mean of the entropies.

    Everything follows from the cells, staged, and the label sizes of each side.
    """
    cells = stage_table(contingency(df, a, b), "cells")
    n = cells.agg(F.sum("nij")).scalar()

    def entropy(x: Column, times: Column) -> Column:
        share = x / n.cast("double")
        return -F.sum(times * share * F.log(share))

    sizes = [cells.groupBy(side).agg(F.sum("nij").alias("x")).groupBy("x").agg(F.count("*").alias("times")) for side in ("a", "b")]
    ha, hb = [s.agg(entropy(F.col("x"), F.col("times"))).scalar() for s in sizes]
    joint = cells.agg(entropy(F.col("nij"), F.lit(1)).alias("joint"))
    emi = one_row(_expected_information(*sizes, n))["emi"]
    ari = one_row(_rand(cells, ()))["adjusted_rand"]
    info = joint.select("joint", ha.alias("ha"), hb.alias("hb"), emi.alias("emi"), ari.alias("adjusted_rand"))
    shared, mean = F.col("ha") + F.col("hb") - F.col("joint"), (F.col("ha") + F.col("hb")) / 2
    return info.select(
        "adjusted_rand",
        F.when((F.col("ha") == 0) & (F.col("hb") == 0), 1.0).otherwise(
            F.coalesce(F.try_divide(shared - F.col("emi"), mean - F.col("emi")), F.lit(1.0))
        ).alias("adjusted_mutual_info"),
    )


def flag_cross(df: DataFrame) -> DataFrame:
    """Adds ``flag_cross``, the four buyer flags as one text."""
    return df.withColumn("flag_cross", F.concat(*[F.col(c).cast("int").cast("string") for c in BUYER_FLAGS]))


def flag_redundancy(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    return adjusted_rand(flag_cross(df), "flag_cross", label, by).withColumnRenamed(
        "adjusted_rand", "flag_redundancy"
    )


# --- silhouette ---------------------------------------------------------------
_BLOCK_ROWS = 65_536
_TILE = 256
#: Squared distances below this share of the largest squared lengths are taken from the differences, in so many pairs at once.
_UNSURE, _NEAR = 1e-7, 1 << 14


def _pack_block(columns: list[str], labels: list[str]):
    """One block of points as one row; the points stand in the order of their values."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values([*columns, *labels])
        return pd.DataFrame({
            "home": block["home"].iloc[:1].to_numpy(), "x": [block[columns].to_numpy("<f8").tobytes()],
            "l": [block[labels].to_numpy("<i4").tobytes()], "w": [block["w"].to_numpy("<i8").tobytes()],
        })

    return run


def _distance_sums(columns: int, sizes: list[int]):
    """Task body: summed distances between two blocks, from the points of each to the labels of the other."""
    total = sum(sizes)
    first = np.cumsum([0, *sizes[:-1]])

    def unpacked(block: pd.DataFrame):
        x = np.frombuffer(block["x"].iloc[0], "<f8").reshape(-1, columns)
        labels = np.frombuffer(block["l"].iloc[0], "<i4").reshape(len(x), len(sizes))
        weight = np.frombuffer(block["w"].iloc[0], "<i8")
        return x, labels, weight

    def marks(labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(labels), total))
        out[np.arange(len(labels))[:, None], labels + first] = weight[:, None]
        return out

    def frame(block: int, sums: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame(sums, columns=[f"s_{i}" for i in range(total)])
        out.insert(0, "home", np.int32(block))
        out.insert(1, "place", np.arange(len(sums), dtype=np.int32))
        for i in range(len(sizes)):
            out[f"l_{i}"] = labels[:, i]
        out["w"] = weight
        return out

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):  # a block without points
            return frame(0, np.zeros((0, total)), np.zeros((0, len(sizes)), np.int32), np.zeros(0, np.int64))
        (x, lx, wx), (y, ly, wy), own = unpacked(left), unpacked(right), key[0] == key[1]
        sx, sy = np.zeros((len(x), total)), np.zeros((len(y), total))
        mx, my = marks(lx, wx), marks(ly, wy)
        # Around a point between them the products lose least.
        middle = (x.mean(axis=0) + y.mean(axis=0)) / 2
        x, y = x - middle, y - middle
        long_x, long_y = (x * x).sum(axis=1), (y * y).sum(axis=1)
        wide_x = np.column_stack([x, long_x, np.ones(len(x))])
        wide_y = np.ascontiguousarray(np.column_stack([-2 * y, np.ones(len(y)), long_y]).T)
        for s in range(0, len(x), _TILE):
            a = slice(s, s + _TILE)
            for t in range(s if own else 0, len(y), _TILE):
                b = slice(t, t + _TILE)
                square = wide_x[a] @ wide_y[:, b]
                unsure = _UNSURE * (long_x[a].max() + long_y[b].max())
                if square.min() <= unsure:  # near pairs by their differences
                    i, j = np.nonzero(square <= unsure)
                    for c in range(0, len(i), _NEAR):
                        ic, jc = i[c:c + _NEAR], j[c:c + _NEAR]
                        gap = x[s + ic] - y[t + jc]
                        square[ic, jc] = (gap * gap).sum(axis=1)
                distance = np.sqrt(square, out=square)
                sx[a] += distance @ my[b]
                if not own:
                    sy[b] += distance.T @ mx[a]
                elif t > s:
                    sx[b] += distance.T @ mx[a]
        if own:
            return frame(key[0], sx, lx, wx)
        return pd.concat([frame(key[0], sx, lx, wx), frame(key[1], sy, ly, wy)], ignore_index=True)

    return run


def silhouette_points(df: DataFrame, columns: Sequence[str], labels: dict[str, int],
                      block_rows: int = _BLOCK_ROWS) -> DataFrame:
    """Exact Euclidean silhouette per distinct point: ``(labeling, label, w, silhouette)``.

    ``labels`` maps label columns (0..k-1) to their k. Equal rows become one
    point of weight ``w`` first. The points are hashed into blocks, each packed
    into one row; every unordered pair of blocks is one group of numpy work that
    serves both sides and all labelings, and returns one row of sums per point. No
    pair of points is ever a row. The work is quadratic in the number of distinct
    points, as the measure is; ``squared_silhouette`` is the linear one. There
    are as many blocks as ``block_rows`` asks for, and enough to fill the cores.
    """
    names = list(labels)
    sizes = [labels[c] for c in names]
    cols = [f"c_{i}" for i in range(len(columns))]
    points = df.groupBy(
        *[F.col(c).cast("double").alias(x) for c, x in zip(columns, cols)],
        *[F.col(c).cast("int").alias(f"l_{i}") for i, c in enumerate(names)],
    ).agg(F.count("*").alias("w"))
    marked = [f"l_{i}" for i in range(len(names))]
    cores = df.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.ceil(points.count() / block_rows), math.ceil((4 * cores) ** 0.5))
    packed = points.withColumn("home", F.pmod(F.xxhash64(*cols, *marked), F.lit(blocks)).cast("int")).groupBy(
        "home").applyInPandas(_pack_block(cols, marked), "home int, x binary, l binary, w binary")
    left = packed.select(F.col("home").alias("bi"), F.explode(F.sequence("home", F.lit(blocks - 1))).alias("bj"), "x", "l", "w")
    right = packed.select(F.explode(F.sequence(F.lit(0), "home")).alias("bi"), F.col("home").alias("bj"), "x", "l", "w")
    total = sum(sizes)
    schema = ", ".join(["home int, place int", *[f"s_{i} double" for i in range(total)], *[f"{c} int" for c in marked], "w bigint"])
    scored = (
        left.groupBy("bi", "bj").cogroup(right.groupBy("bi", "bj"))
        .applyInPandas(_distance_sums(len(cols), sizes), schema)
        .groupBy("home", "place").agg(
            *[F.sum(f"s_{i}").alias(f"s_{i}") for i in range(total)],
            *[F.max(m).alias(c) for m, c in zip(marked, names)], F.max("w").alias("w"))
    )
    counts = one_row(points.agg(*[
        F.sum(F.when(F.col(m) == i, F.col("w")).otherwise(0)).alias(f"{c}_{i}")
        for m, c in zip(marked, names) for i in range(labels[c])
    ]))
    scored = scored.withColumn("_n", counts)
    rows, at = [], 0
    for c in names:
        own, other = F.lit(None).cast("double"), []
        size = F.lit(None).cast("bigint")
        for i in range(labels[c]):
            s, n = F.col(f"s_{at + i}"), F.col(f"_n.{c}_{i}")
            own = F.when(F.col(c) == i, F.try_divide(s, n - 1)).otherwise(own)
            size = F.when(F.col(c) == i, n).otherwise(size)
            other.append(F.when((F.col(c) != i) & (n > 0), F.try_divide(s, n)))
        at += labels[c]
        near = F.array_min(F.array(*other))
        value = F.when(size <= 1, 0.0).otherwise(
            F.coalesce(F.try_divide(near - own, F.greatest(own, near)), F.lit(0.0))
        )
        rows.append(F.struct(F.lit(c).alias("labeling"), F.col(c).alias("label"),
                             F.col("w"), value.alias("silhouette")))
    return scored.select(F.inline(F.array(*rows)))


def silhouette_by_label(df: DataFrame, columns: Sequence[str], labels: dict[str, int]) -> DataFrame:
    """``(labeling, label, mean, min, max, size)``."""
    return silhouette_points(df, columns, labels).groupBy("labeling", "label").agg(
        (F.sum(F.col("silhouette") * F.col("w")) / F.sum("w")).alias("mean"),
        F.min("silhouette").alias("min"), F.max("silhouette").alias("max"),
        F.sum("w").alias("size"),
    )


def silhouette_score(df: DataFrame, columns: Sequence[str], labels: dict[str, int]) -> DataFrame:
    """``(labeling, silhouette)``: mean over rows."""
    return silhouette_points(df, columns, labels).groupBy("labeling").agg(
        (F.sum(F.col("silhouette") * F.col("w")) / F.sum("w")).alias("silhouette")
    )


def squared_silhouette(df: DataFrame, label: str, features: str = "features") -> float:
    """The linear-time measure on squared distances; another number than the Euclidean one."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    return ClusteringEvaluator(
        predictionCol=label, featuresCol=features, distanceMeasure="squaredEuclidean"
    ).evaluate(df)
