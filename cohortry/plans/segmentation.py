"""The batch run: two text files to segmented clients, profiles, reports and models."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.config import (
    CORRELATED, FEATURE_SETS, FINGERPRINT, HOME_COUNTRY, K_RANGE, SCALERS, SEED, FeatureSet,
)
from cohortry.operators import cleaning as C
from cohortry.operators import eda
from cohortry.operators import features as FE
from cohortry.operators import metrics as M
from cohortry.operators import profiles as PR
from cohortry.operators import selection as SE
from cohortry.operators import validation as VA
from cohortry.operators.matrix import build_matrix
from cohortry.operators.scalars import one_row
from cohortry.session import stage_table
from cohortry.sources import readers, writers


@dataclass(frozen=True)
class Settings:
    """Size of the search; the defaults are those of the full analysis."""

    feature_sets: dict[str, FeatureSet] = field(default_factory=lambda: dict(FEATURE_SETS))
    scalers: Sequence[str] = SCALERS
    ks: Sequence[int] = K_RANGE
    grid_restarts: int = 20
    final_restarts: int = 50
    stability_runs: int = 100
    stability_restarts: int = 10
    min_cluster_size: int = 25
    min_behavioural_separation: float = 0.10
    micro_clusters: int = 200
    silhouette: str = "squared"
    home_country: str = HOME_COUNTRY
    seed: int = SEED


def clean_inputs(spark: SparkSession, register_path: str, ledger_path: str,
                 out: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cleaned register and ledger, written, and the audit."""
    raw_register = readers.read_register(spark, register_path)
    raw_ledger = readers.read_ledger(spark, ledger_path)
    order = ["file_order"]
    writers.write_table(C.clean_register(raw_register, order), f"{out}/clients_clean")
    writers.write_table(C.clean_ledger(raw_ledger, order), f"{out}/properties_clean")
    report = stage_table(C.cleaning_report(raw_register, raw_ledger, order, order), "cleaning_report")
    writers.write_report(report.orderBy("position").select("check", "value"), f"{out}/tables/cleaning_report")
    return spark.read.parquet(f"{out}/clients_clean"), spark.read.parquet(f"{out}/properties_clean"), report


def build_features(spark: SparkSession, register: DataFrame, ledger: DataFrame, out: str,
                   home_country: str = HOME_COUNTRY) -> DataFrame:
    """The coded feature table, written once and read back."""
    table = FE.label_encode(FE.client_features(register, ledger, home_country))
    writers.write_table(table, f"{out}/client_features")
    writers.write_report(FE.feature_dictionary(spark), f"{out}/tables/feature_dictionary")
    return readers.read_features(spark, f"{out}/client_features")


def write_exploration(features: DataFrame, out: str) -> None:
    matrix = eda.correlation_matrix(features, CORRELATED)
    writers.write_report(matrix.withColumn("r", F.bround("r", 3)).orderBy("a", "b"),
                         f"{out}/tables/correlation_matrix")
    summary = eda.numeric_summary(features, CORRELATED)
    writers.write_report(
        summary.withColumns({c: F.bround(c, 3) for c, t in summary.dtypes if t == "double"}).orderBy("feature"),
        f"{out}/tables/numeric_summary",
    )


def run(spark: SparkSession, register_path: str, ledger_path: str, out: str,
        settings: Settings = Settings()) -> DataFrame:
    """Everything, written under ``out``; returns the one-row summary."""
    s = settings
    register, ledger, report = clean_inputs(spark, register_path, ledger_path, out)
    features = build_features(spark, register, ledger, out, s.home_country)
    write_exploration(features, out)

    experiment = SE.run_experiment(
        features, s.feature_sets, s.scalers, s.ks, s.grid_restarts, s.min_cluster_size,
        s.min_behavioural_separation, s.seed, s.silhouette,
    )
    writers.write_report(experiment, f"{out}/tables/model_selection_experiment")
    best = SE.select_best(experiment).first()
    leader = SE.top_by_silhouette(experiment).first()
    k = best["k"]

    matrix = build_matrix(features, s.feature_sets[best["feature_set"]], best["scaler"])
    scan = SE.scan_k(matrix, s.ks, s.grid_restarts, s.seed, s.silhouette)
    writers.write_report(scan, f"{out}/tables/k_scan")
    elbow_k = SE.elbow(scan).first()["elbow_k"]

    rows = matrix.df.persist(StorageLevel.MEMORY_AND_DISK)
    model = SE.fit_kmeans(rows, k, s.final_restarts, s.seed).setPredictionCol("cluster")
    projection = VA.pca_projection(model.transform(rows))
    tree = VA.fit_hierarchical(projection.df, matrix.columns, k, s.micro_clusters, s.seed)
    labelled = stage_table(tree.labels, "labelled_clients")
    rows.unpersist()

    if s.silhouette == "euclidean":
        writers.write_report(M.silhouette_by_label(labelled, matrix.columns, {"cluster": k}),
                             f"{out}/tables/silhouette_by_cluster")
    runs = VA.stability_runs(labelled.drop("hierarchical_cluster"), matrix.columns, k, "cluster",
                             n_runs=s.stability_runs, n_init=s.stability_restarts, seed=s.seed)
    agreement = M.compare_partitions(labelled, "cluster", "hierarchical_cluster")
    writers.write_report(tree.merges, f"{out}/tables/ward_merges")

    clients, profile = PR.attach_segments(labelled.drop("features", *matrix.columns))
    writers.write_table(clients, f"{out}/segmented_clients")
    writers.write_table(profile, f"{out}/cluster_profiles")
    profile = spark.read.parquet(f"{out}/cluster_profiles")
    writers.write_report(PR.relative_profile(profile, labelled), f"{out}/tables/relative_profile")
    writers.write_report(PR.discriminating_features(profile, labelled, 8), f"{out}/tables/discriminating_features")
    eta = M.eta_squared(labelled, "cluster", FINGERPRINT)
    writers.write_report(eta.withColumn("eta_squared", F.bround("eta_squared", 4)).orderBy(F.desc("eta_squared")),
                         f"{out}/tables/eta_squared")

    writers.save_model(matrix.model, f"{out}/models/preprocessor")
    writers.save_model(PipelineModel([model.transformer()]), f"{out}/models/kmeans")
    writers.save_model(projection.model, f"{out}/models/pca")

    notes = C.audit_notes(report).agg(F.array_sort(F.collect_list("note")).alias("v")).scalar()
    checks = report.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("check", "value")))).alias("v")).scalar()
    totals = one_row(features.agg(
        F.count("*").alias("n_clients"), F.sum("total_properties").alias("units_sold"),
        F.sum("total_investment").alias("total_capital"),
    ))
    names = profile.agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col("cluster").cast("string"), F.col("segment")))))).scalar()

    def literal(row, *fields):
        return F.struct(*[F.lit(row[f]).alias(f) for f in fields])

    summary = spark.range(1).select(
        checks.alias("cleaning"), notes.alias("cleaning_notes"), totals.alias("_t"),
        ledger.agg(F.count("*")).scalar().alias("n_properties"),
        F.struct(
            *[F.lit(best[f]).alias(f) for f in (
                "feature_set", "scaler", "k", "silhouette", "davies_bouldin", "calinski_harabasz",
                "n_indices_agreeing", "voted_by")],
            F.lit(elbow_k).alias("elbow_k"),
            F.lit(len(matrix.names)).alias("n_model_features"),
            F.array(*[F.lit(n) for n in matrix.names]).alias("model_features"),
            one_row(M.separation(labelled, "cluster"))["behavioural_separation"].alias("behavioural_separation"),
            one_row(M.flag_redundancy(labelled, "cluster"))["flag_redundancy"].alias("flag_redundancy"),
            F.array(*[F.lit(v) for v in projection.explained]).alias("pca_explained"),
            one_row(VA.stability(runs)).alias("stability"),
            F.lit(tree.cophenetic).alias("cophenetic_correlation"),
            one_row(agreement).alias("hierarchical"),
            names.alias("segments"),
            literal(leader, "feature_set", "scaler", "k", "silhouette", "flag_redundancy",
                    "behavioural_separation", "substantive").alias("silhouette_leader"),
        ).alias("model"),
    ).select("cleaning", "cleaning_notes", "_t.*", "n_properties", "model")
    writers.write_json(summary, f"{out}/run_summary")
    return spark.read.json(f"{out}/run_summary")
