"""Second opinions on a segmentation: Ward, subsamples, principal components."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.config import SEED
from cohortry.operators.lloyd import RUNS_PER_COLUMN, Group, agreement_by_run, fit_models, improve, nearest_label, pack
from cohortry.operators.quantiles import exact_quantiles
from cohortry.session import stage_table


# --- Ward on micro-clusters ---------------------------------------------------
@dataclass(frozen=True)
class Hierarchy:
    """``labels``: the input plus the label column; ``merges``: (left, right, height, size)."""

    labels: DataFrame
    merges: DataFrame
    cophenetic: float


def ward_merges(centres: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merge order of a few weighted centres; new groups are numbered from m on."""
    m = len(centres)
    centre = {i: np.asarray(centres[i], float) for i in range(m)}
    weight = {i: float(weights[i]) for i in range(m)}

    def height(i: int, j: int) -> float:
        gap = centre[i] - centre[j]
        return float(np.sqrt(2 * weight[i] * weight[j] / (weight[i] + weight[j]) * (gap @ gap)))

    nearest: dict[int, tuple[float, int]] = {}

    def look(i: int) -> None:
        others = [(height(i, j), j) for j in centre if j > i]
        if others:
            nearest[i] = min(others)
        else:
            nearest.pop(i, None)

    for i in range(m):
        look(i)
    out = []
    for new in range(m, 2 * m - 1):
        i = min(nearest, key=lambda g: (nearest[g][0], g))
        h, j = nearest[i]
        total = weight[i] + weight[j]
        mixed = (centre[i] * weight[i] + centre[j] * weight[j]) / total
        for g in (i, j):
            del centre[g], weight[g]
            nearest.pop(g, None)
        centre[new], weight[new] = mixed, total
        out.append((i, j, h, int(total)))
        for g in list(centre):
            if g == new:
                continue
            if g not in nearest or nearest[g][1] in (i, j):
                look(g)
            else:
                nearest[g] = min(nearest[g], (height(g, new), new))
    return out


def cut_merges(merges: Sequence[tuple[int, int, float, int]], m: int, k: int) -> list[int]:
    """Group 0..k-1 of each of the m centres after the first m - k merges."""
    parent = list(range(2 * m))
    for step, (i, j, _, _) in enumerate(merges[: max(0, m - k)]):
        parent[i] = parent[j] = m + step

    def root(g: int) -> int:
        while parent[g] != g:
            g = parent[g]
        return g

    numbers: dict[int, int] = {}
    return [numbers.setdefault(root(g), len(numbers)) for g in range(m)]


def cophenetic_correlation(centres: np.ndarray, weights: np.ndarray,
                           merges: Sequence[tuple[int, int, float, int]]) -> float:
    """Correlation of distance and merge height over the pairs of centres, weighted by their rows."""
    m = len(centres)
    members: dict[int, list[int]] = {i: [i] for i in range(m)}
    heights = np.zeros((m, m))
    for step, (i, j, h, _) in enumerate(merges):
        left, right = members.pop(i), members.pop(j)
        heights[np.ix_(left, right)] = h
        heights[np.ix_(right, left)] = h
        members[m + step] = left + right
    up = np.triu_indices(m, 1)
    gap = centres[up[0]] - centres[up[1]]
    distance = np.sqrt((gap * gap).sum(axis=1))
    w = (weights[up[0]] * weights[up[1]]).astype(float)
    a, b = distance - np.average(distance, weights=w), heights[up] - np.average(heights[up], weights=w)
    spread = np.sqrt((w * a * a).sum() * (w * b * b).sum())
    return float((w * a * b).sum() / spread) if spread else float("nan")


def fit_hierarchical(df: DataFrame, columns: Sequence[str], k: int, micro: int = 200,
                     seed: int = SEED, label: str = "hierarchical_cluster", passes: int = 5) -> Hierarchy:
    """Ward linkage over at most ``micro`` micro-clusters.

    Rows go to the nearest of ``micro`` distinct rows drawn by hash, whose centres are renewed in
    at most ``passes`` passes; only their centres and sizes reach the driver. Distinct rows that ``micro`` covers
    are centres of their own, so on those the result is Ward on the rows.
    """
    spark = df.sparkSession
    point = F.array(*[F.col(c).cast("double") for c in columns])
    drawn = df.select(point.alias("p")).distinct().orderBy(F.xxhash64("p", F.lit(seed)), "p").limit(micro).collect()
    blocks = pack(df, columns)
    try:
        start = Group(blocks.at(columns), np.array([[r["p"] for r in drawn]], float), np.array([-1]))
        near = improve(blocks, [start], passes)[0].best
    finally:
        blocks.release()
    marked = stage_table(df.withColumn("_micro", nearest_label(near)(point)), "micro_clusters")
    sums = marked.groupBy("_micro").agg(
        F.array(*[F.avg(F.col(c).cast("double")) for c in columns]).alias("p"), F.count("*").alias("w")
    ).orderBy("p").collect()  # at most ``micro`` rows
    centres = np.array([r["p"] for r in sums], float)
    weights = np.array([r["w"] for r in sums], float)
    merges = ward_merges(centres, weights)
    groups = cut_merges(merges, len(centres), k)
    coded = spark.createDataFrame(list(zip([r["_micro"] for r in sums], groups)), f"_micro int, {label} int")
    labels = marked.join(F.broadcast(coded), "_micro").drop("_micro")  # at most ``micro`` rows
    table = spark.createDataFrame(
        [(i, l, r, h, s) for i, (l, r, h, s) in enumerate(merges)],
        "step int, left int, right int, height double, size int",
    )
    return Hierarchy(labels, table, cophenetic_correlation(centres, weights, merges))


# --- subsamples ---------------------------------------------------------------
_HASH_RANGE = 1 << 52


def _draw(key: str, run: int, seed: int) -> Column:
    """A number of 52 bits per row and run, exact as a double."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(run)), F.lit(_HASH_RANGE)).cast("double")


def subsample(df: DataFrame, key: str, fraction: float, run: int, seed: int = SEED) -> DataFrame:
    """``int(fraction * n)`` rows without replacement.

    Rows are drawn by hash; the exact order statistic of the hash is the
    cut, so no row moves and nothing is sorted as a whole.
    """
    drawn = df.withColumn("_u", _draw(key, run, seed))
    n = df.count()
    want = int(fraction * n)
    if want >= n:
        return df
    if want == 0:
        return df.limit(0)
    # The want-th smallest hash is the quantile whose position is a whole rank.
    edge = exact_quantiles(drawn.select("_u"), ["_u"], [(want - 1) / (n - 1)]).first()["value"]
    # Keys that share the edge's hash (chance hits, so few) are taken in their own order.
    at = drawn.agg(F.count_if(F.col("_u") < edge).alias("below"), F.array_sort(F.collect_list(
        F.when(F.col("_u") == edge, F.col(key)))).alias("ties")).first()
    last = at["ties"][want - at["below"] - 1]
    return drawn.filter((F.col("_u") < edge) | ((F.col("_u") == edge) & (F.col(key) <= F.lit(last)))).drop("_u")


def subsample_marks(df: DataFrame, key: str, fraction: float, runs: Sequence[int], seed: int = SEED) -> DataFrame:
    """``df`` with ``run_bits_0, ..``: bit ``j`` of column ``i`` is set where a row is in run ``runs[50 * i + j]``.

    Every run has exactly ``int(fraction * n)`` rows. The cuts of all runs are one multi-column order
    statistic, and nothing is sorted as a whole.
    """
    n = df.count()
    want = int(fraction * n)
    names = [f"_u{i}" for i in range(len(runs))]
    drawn = df.select(key, *[_draw(key, r, seed).alias(c) for r, c in zip(runs, names)])
    cuts: dict[str, tuple] = {}
    if 0 < want < n:
        edges = {r["feature"]: r["value"] for r in exact_quantiles(drawn, names, [(want - 1) / (n - 1)]).collect()}
        long = drawn.select(key, F.inline(F.array(*[
            F.struct(F.lit(i).alias("i"), F.col(c).alias("u"), F.lit(edges[c]).alias("e")) for i, c in enumerate(names)])))
        # Keys that share a run's edge (chance hits, so few) are taken in their own order.
        at = long.groupBy("i").agg(F.count_if(F.col("u") < F.col("e")).alias("below"), F.array_sort(
            F.collect_list(F.when(F.col("u") == F.col("e"), F.col(key)))).alias("ties")).collect()
        cuts = {names[r["i"]]: (edges[names[r["i"]]], r["ties"][want - r["below"] - 1]) for r in at}

    def inside(run: int, name: str) -> Column:
        if name not in cuts:
            return F.lit(want > 0)
        edge, last = cuts[name]
        u = _draw(key, run, seed)
        return (u < edge) | ((u == edge) & (F.col(key) <= F.lit(last)))

    def bits(some: Sequence[tuple[int, str]]) -> Column:
        total = F.lit(0).cast("long")
        for j, (run, name) in enumerate(some):
            total = total + F.when(inside(run, name), F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long"))
        return total

    pairs = list(zip(runs, names))
    return df.withColumns({f"run_bits_{i}": bits(pairs[a:a + RUNS_PER_COLUMN])
                           for i, a in enumerate(range(0, len(pairs), RUNS_PER_COLUMN))})


def stability_runs(df: DataFrame, columns: Sequence[str], k: int, base_label: str,
                   key: str = "client_id", n_runs: int = 100, fraction: float = 0.8,
                   n_init: int = 10, seed: int = SEED, **options) -> DataFrame:
    """``(run, adjusted_rand)`` of refits on subsamples against ``base_label`` (0..).

    All runs and restarts are fitted in the same passes; a row's bits say which runs see it.
    """
    marked = subsample_marks(df.select(key, *columns, base_label), key, fraction, range(n_runs), seed)
    bits = [c for c in marked.columns if c.startswith("run_bits_")]
    blocks = pack(marked, [*columns, base_label, *bits])
    try:
        levels = df.agg(F.max(base_label)).first()[0] + 1
        fits = fit_models(blocks, {"": columns}, [k], n_init, seed + 1000, runs=range(n_runs), bits=bits, **options)["", k]
        best = fits.cost.reshape(n_runs, n_init).argmin(axis=1) + n_init * np.arange(n_runs)
        scores = agreement_by_run(blocks, Group(blocks.at(columns), fits.centres[best], np.arange(n_runs)), base_label, levels, bits)
    finally:
        blocks.release()
    return df.sparkSession.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "run int, adjusted_rand double")


def stability(runs: DataFrame) -> DataFrame:
    """One row ``(mean_ari, std_ari, min_ari, n_runs)``; population deviation."""
    return runs.agg(
        F.avg("adjusted_rand").alias("mean_ari"), F.stddev_pop("adjusted_rand").alias("std_ari"),
        F.min("adjusted_rand").alias("min_ari"), F.count("*").cast("int").alias("n_runs"),
    )


# --- principal components -----------------------------------------------------
@dataclass(frozen=True)
class Projection:
    df: DataFrame
    explained: list[float]
    model: PipelineModel


def pca_projection(df: DataFrame, components: int = 2, features: str = "features") -> Projection:
    """Adds ``pc1 ..``: centred scores, each component's largest loading positive.

    The signs are a step of ``model``, so a saved and reloaded one gives the same ``scores`` vector.
    """
    centre = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="_centred").fit(df)
    centred = centre.transform(df)
    pca = PCA(k=components, inputCol="_centred", outputCol="_pc").fit(centred)
    loadings = pca.pc.toArray()
    signs = [1.0 if loadings[np.abs(loadings[:, j]).argmax(), j] > 0 else -1.0 for j in range(components)]
    turn = ElementwiseProduct(scalingVec=Vectors.dense(signs), inputCol="_pc", outputCol="scores")
    scores = turn.transform(pca.transform(centred)).withColumn("_a", vector_to_array("scores"))
    scores = scores.withColumns({
        f"pc{j + 1}": F.col("_a")[j] for j in range(components)
    }).drop("_a", "_pc", "_centred", "scores")
    return Projection(scores, [float(v) for v in pca.explainedVariance], PipelineModel([centre, pca, turn]))


def segment_centres(df: DataFrame, label: str) -> DataFrame:
    """Mean position and size of each label on the first two components."""
    return df.groupBy(label).agg(
        F.avg("pc1").alias("pc1"), F.avg("pc2").alias("pc2"), F.count("*").alias("n")
    )


