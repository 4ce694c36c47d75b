"""K-Means fits, the grid of configurations, and the choice among them."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.config import (
    BEHAVIOUR_CORE, BUYER_FLAGS, DECLARED, FEATURE_SETS, K_RANGE, SCALERS, SEED, FeatureSet,
)
from cohortry.operators import metrics as M
from cohortry.operators.lloyd import Blocks, Clustering, Labeling, fit_models, measure, pack
from cohortry.operators.matrix import Matrix, build_matrix, one_hot_terms, require_complete, scaling_terms

INDICES = ("silhouette", "davies_bouldin", "calinski_harabasz")
EXPERIMENT_SCHEMA = (
    "feature_set string, scaler string, n_features int, k int, inertia double, "
    "silhouette double, calinski_harabasz double, davies_bouldin double, "
    "min_cluster_size bigint, min_cluster_pct double, behavioural_separation double, "
    "declared_separation double, flag_redundancy double, actionable boolean, "
    "substantive boolean, viable boolean"
)


# --- fits ---------------------------------------------------------------------
def matrix_columns(df: DataFrame) -> list[str]:
    """The columns ``x_0, x_1, ..`` of a matrix."""
    return [c for c in df.columns if re.fullmatch(r"x_\d+", c)]


def fit_kmeans_many(df: DataFrame, ks: Sequence[int], n_init: int, seed: int = SEED, max_iter: int = 100,
                    tol: float = 1e-4, columns: Sequence[str] | None = None) -> dict[int, Clustering]:
    """The cheapest of ``n_init`` fits for every k over ``columns`` (those of a matrix, if not named).

    All restarts and values of k share their passes over the rows.
    """
    columns = list(columns or matrix_columns(df))
    blocks = pack(df, columns)
    try:
        fits = fit_models(blocks, {"": columns}, ks, n_init, seed, max_iter, tol)
    finally:
        blocks.release()
    return {k: Clustering(f.best, tuple(columns), float(f.cost.min())) for (_, k), f in fits.items()}


def fit_kmeans(df: DataFrame, k: int, n_init: int = 50, seed: int = SEED, **options) -> Clustering:
    """One final model: the cheapest of ``n_init`` restarts."""
    return fit_kmeans_many(df, [k], n_init, seed, **options)[k]


def label_with(df: DataFrame, models: dict[int, Clustering]) -> DataFrame:
    """Adds ``label_<k>`` for every model."""
    for k, model in models.items():
        df = model.setPredictionCol(f"label_{k}").transform(df)
    return df


# --- scores -------------------------------------------------------------------
_SUBSTANCE = tuple(dict.fromkeys(BEHAVIOUR_CORE + DECLARED))
_EXPLAINED = {
    "behavioural_separation": [f"eta__{c}" for c in BEHAVIOUR_CORE],
    "declared_separation": [f"eta__{c}" for c in DECLARED],
}


def _substance(df: DataFrame) -> dict[str, str]:
    """SQL of the columns that tell what labels are about: scaled ones, and the crossed flags as a code."""
    scaled = scaling_terms(df, FeatureSet("", _SUBSTANCE), "standard")
    flags = " + ".join(f"{1 << i} * CAST(`{c}` AS INT)" for i, c in enumerate(BUYER_FLAGS))
    return {**{f"eta__{c}": sql for c, sql in scaled}, "flag_cross": flags}


def _named(score: dict, silhouette: float | None = None) -> dict:
    out = {**score, **({"flag_redundancy": score["redundancy"]} if "redundancy" in score else {})}
    return out if silhouette is None else {**out, "silhouette": silhouette}


def _check_measure(silhouette: str) -> None:
    if silhouette not in ("squared", "euclidean"):
        raise ValueError(f"unknown silhouette {silhouette!r}")


def score_labelings(labelled: DataFrame, columns: Sequence[str], ks: Sequence[int], substance: bool,
                    silhouette: str = "squared") -> list[dict]:
    """All measures of ``label_<k>`` for all k, from two passes over the rows: one dict per k, in order of k.

    The silhouette is that on squared distances, linear in the rows. ``euclidean`` asks for
    the one on distances, whose work grows with the square of the distinct rows.
    """
    _check_measure(silhouette)
    names = {k: f"label_{k}" for k in ks}
    more = _substance(labelled) if substance else {}
    blocks = pack(labelled.selectExpr(
        *[f"`{c}`" for c in (*columns, *names.values())], *[f"{sql} AS `{c}`" for c, sql in more.items()]),
        [*columns, *names.values(), *more])
    try:
        matrix = blocks.at(columns)
        scores = measure(blocks, [Labeling(matrix, k, label=int(blocks.at([c])[0])) for k, c in names.items()],
                         _EXPLAINED if substance else None, "flag_cross" if substance else None, 1 << len(BUYER_FLAGS))
    finally:
        blocks.release()
    exact = _euclidean(labelled, columns, ks) if silhouette == "euclidean" else {}
    return [_named(score, exact.get(k)) for k, score in zip(ks, scores)]


def _euclidean(labelled: DataFrame, columns: Sequence[str], ks: Sequence[int]) -> dict[int, float]:
    rows = M.silhouette_score(labelled, columns, {f"label_{k}": k for k in ks}).collect()  # one per k
    return {int(r["labeling"].split("_")[1]): r["silhouette"] for r in rows}


def scan_k(matrix: Matrix, ks: Sequence[int] = K_RANGE, n_init: int = 20, seed: int = SEED,
           silhouette: str = "squared", **options) -> DataFrame:
    """Seven columns per k."""
    _check_measure(silhouette)
    blocks = pack(matrix.df, matrix.columns)
    try:
        fits = fit_models(blocks, {"": matrix.columns}, ks, n_init, seed, **options)
        scores = measure(blocks, [Labeling(blocks.at(matrix.columns), k, f.best) for (_, k), f in fits.items()])
    finally:
        blocks.release()
    exact: dict = {}
    if silhouette == "euclidean":
        models = {k: Clustering(f.best, tuple(matrix.columns), 0.0) for (_, k), f in fits.items()}
        exact = _euclidean(label_with(matrix.df, models), matrix.columns, ks)
    rows = [_named(score, exact.get(score["k"])) for score in scores]
    fields = ("k", "inertia", "silhouette", "calinski_harabasz", "davies_bouldin",
              "min_cluster_size", "min_cluster_pct")
    return matrix.df.sparkSession.createDataFrame(
        [tuple(r[f] for f in fields) for r in rows],
        "k int, inertia double, silhouette double, calinski_harabasz double, "
        "davies_bouldin double, min_cluster_size bigint, min_cluster_pct double",
    )


def experiment_blocks(features: DataFrame, feature_sets: dict[str, FeatureSet], scalers: Sequence[str],
                      more: Sequence[str] = ()) -> tuple[Blocks, dict[tuple[str, str], list[str]]]:
    """All matrices of an experiment side by side, and the columns of each ``(feature set, scaler)``.

    Each scaled or one-hot column is there once, whichever sets share it.
    """
    numeric = tuple(dict.fromkeys(c for fs in feature_sets.values() for c in fs.numeric))
    categorical = tuple(dict.fromkeys(c for fs in feature_sets.values() for c in fs.categorical))
    sql = {f"{scaler}__{c}": text for scaler in scalers
           for c, text in scaling_terms(features, FeatureSet("", numeric), scaler)}
    hot: dict[str, list[str]] = {}
    for c in categorical:
        terms = one_hot_terms(features, FeatureSet("", (), (c,)))
        hot[c] = [f"hot__{c}__{i}" for i in range(len(terms))]
        sql |= {name: text for name, (_, text) in zip(hot[c], terms)}
    views = {(name, scaler): [*[f"{scaler}__{c}" for c in fs.numeric], *[h for c in fs.categorical for h in hot[c]]]
             for name, fs in feature_sets.items() for scaler in scalers}
    sql |= _substance(features) | {c: f"`{c}`" for c in more}
    return pack(features.selectExpr(*[f"{text} AS `{c}`" for c, text in sql.items()]), list(sql)), views


def measure_substance(blocks: Blocks, labelings: Sequence[Labeling]) -> list[dict]:
    """All measures of labelings over the blocks of an experiment."""
    return measure(blocks, labelings, _EXPLAINED, "flag_cross", 1 << len(BUYER_FLAGS))


def run_experiment(features: DataFrame, feature_sets: dict[str, FeatureSet] = FEATURE_SETS,
                   scalers: Sequence[str] = SCALERS, ks: Sequence[int] = K_RANGE,
                   n_init: int = 20, min_cluster_size: int = 25,
                   min_behavioural_separation: float = 0.10, seed: int = SEED,
                   silhouette: str = "squared", max_iter: int = 100, tol: float = 1e-4) -> DataFrame:
    """Feature set x scaler x K, one row per configuration. ``features`` should be a staged table.

    All configurations and restarts are fitted in the same passes over the rows, and scored in two
    more. ``silhouette="euclidean"`` adds the quadratic measure, matrix by matrix.
    """
    _check_measure(silhouette)
    require_complete(features, list(dict.fromkeys(
        [*BEHAVIOUR_CORE, *DECLARED, *(c for fs in feature_sets.values() for c in fs.numeric)]
    )))
    blocks, views = experiment_blocks(features, feature_sets, scalers)
    try:
        fits = fit_models(blocks, views, ks, n_init, seed, max_iter, tol)
        scores = measure_substance(blocks, [Labeling(blocks.at(views[v]), k, f.best) for (v, k), f in fits.items()])
    finally:
        blocks.release()
    exact: dict = {}
    if silhouette == "euclidean":
        for name, scaler in views:
            matrix = build_matrix(features, feature_sets[name], scaler)
            models = {k: Clustering(fits[(name, scaler), k].best, tuple(matrix.columns), 0.0) for k in ks}
            exact |= {((name, scaler), k): v for k, v in _euclidean(label_with(matrix.df, models), matrix.columns, ks).items()}
    return viability(experiment_table(features, views, list(fits), scores, exact), min_cluster_size, min_behavioural_separation)


def experiment_table(df: DataFrame, views: dict[tuple[str, str], list[str]], keys: Sequence[tuple], scores: Sequence[dict],
                     exact: dict) -> DataFrame:
    """Scores of ``((feature set, scaler), k)`` as rows, before the gates."""
    rows = []
    for (view, k), score in zip(keys, scores):
        rows.append({"feature_set": view[0], "scaler": view[1], "n_features": len(views[view]), **_named(score, exact.get((view, k)))})
    schema = EXPERIMENT_SCHEMA.split(", ")[:-3]
    return df.sparkSession.createDataFrame([tuple(r[f.split()[0]] for f in schema) for r in rows], ", ".join(schema))


def viability(experiment: DataFrame, min_cluster_size: int = 25,
              min_behavioural_separation: float = 0.10) -> DataFrame:
    """The two gates: big enough, and about behaviour rather than declarations."""
    behaviour = F.col("behavioural_separation")
    return experiment.withColumns({
        "actionable": F.col("min_cluster_size") >= min_cluster_size,
        "substantive": (behaviour > F.col("declared_separation"))
        & (behaviour >= min_behavioural_separation),
    }).withColumn("viable", F.col("actionable") & F.col("substantive"))


# --- choice -------------------------------------------------------------------
def best_k_per_index(experiment: DataFrame) -> DataFrame:
    """``(feature_set, scaler, k_silhouette, k_davies_bouldin, k_calinski_harabasz)``.

    Ties go to the lowest k; a k without a score is not chosen.
    """
    def best(measure: str, high: bool) -> Column:
        order = F.struct(F.col(measure) if not high else -F.col(measure), F.col("k"))
        return F.min(F.when(F.col(measure).isNotNull(), order))["k"].alias(f"k_{measure}")

    return experiment.groupBy("feature_set", "scaler").agg(
        best("silhouette", True), best("davies_bouldin", False), best("calinski_harabasz", True)
    )


def index_consensus(experiment: DataFrame) -> DataFrame:
    """``(feature_set, scaler, k, n_indices_agreeing, voted_by)``."""
    votes = F.array(*[
        F.struct(F.col(f"k_{i}").alias("k"), F.lit(i).alias("voter")) for i in INDICES
    ])
    return (
        best_k_per_index(experiment)
        .select("feature_set", "scaler", F.inline(votes))
        .groupBy("feature_set", "scaler", "k")
        .agg(F.count("*").cast("int").alias("n_indices_agreeing"),
             F.array_join(F.array_sort(F.collect_list("voter")), ",").alias("voted_by"))
    )


def rank_configurations(experiment: DataFrame) -> DataFrame:
    """Viable configurations (all, when none is) with their votes."""
    any_viable = experiment.agg(F.coalesce(F.bool_or("viable"), F.lit(False)).alias("v")).scalar()
    kept = experiment.filter(F.col("viable") | ~any_viable)
    votes = index_consensus(experiment)
    return kept.join(votes, ["feature_set", "scaler", "k"], "left").fillna(
        {"n_indices_agreeing": 0, "voted_by": ""}
    )


def select_best(experiment: DataFrame) -> DataFrame:
    """One row: most votes, then silhouette, then behavioural separation."""
    return rank_configurations(experiment).orderBy(
        F.desc("n_indices_agreeing"), F.desc("silhouette"), F.desc("behavioural_separation"),
        "feature_set", "scaler", "k",
    ).limit(1)


def top_by_silhouette(experiment: DataFrame, n: int = 1, viable_only: bool = False) -> DataFrame:
    rows = experiment.filter("viable") if viable_only else experiment
    return rows.orderBy(F.desc("silhouette"), "feature_set", "scaler", "k").limit(n)


def elbow(scan: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by.., elbow_k)``: the point farthest from the chord between the ends; ties to the lowest k."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    low, high = F.min("k").over(group), F.max("k").over(group)
    y_low, y_high = F.min("inertia").over(group), F.max("inertia").over(group)
    ends = F.min(F.struct("k", "inertia")).over(group), F.max(F.struct("k", "inertia")).over(group)
    x = F.try_divide(F.col("k") - low, high - low)

    def scaled(y: Column) -> Column:
        return F.try_divide(y - y_low, y_high - y_low)

    y0, y1 = scaled(ends[0]["inertia"]), scaled(ends[1]["inertia"])
    # Distance from the line through (0, y0) and (1, y1).
    gap = F.abs((y1 - y0) * x - (scaled(F.col("inertia")) - y0)) / F.sqrt(1 + (y1 - y0) * (y1 - y0))
    marked = scan.select(*by, "k", F.round(gap, 12).alias("_d"))
    return marked.groupBy(*by).agg(
        F.min(F.struct((-F.col("_d")).alias("d"), F.col("k")))["k"].alias("elbow_k")
    )
