"""The batch run from two CSV files to every written table."""
import glob
import json

import pytest
from pyspark.sql import functions as F

from cohortry.config import FEATURE_SETS
from cohortry.operators import reporting as R
from cohortry.plans import segmentation
from cohortry.sources import readers, views, writers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    register = views.register_text(spark, SF).withColumns({
        # The model needs every age and score, so what cannot be read is mended here.
        "date_of_birth": F.when(F.col("date_of_birth") == "not known", "1/2/1970").otherwise(F.col("date_of_birth")),
        "satisfaction_score": F.when(F.col("satisfaction_score") == "none given", "3").otherwise(F.col("satisfaction_score")),
    })
    register.write.option("header", True).csv(f"{folder}/register")
    views.ledger_text(spark, SF).drop("line_order").write.option("header", True).csv(f"{folder}/ledger")
    settings = segmentation.Settings(
        feature_sets={n: FEATURE_SETS[n] for n in ("behaviour_core", "behaviour_demo_flags")},
        scalers=("standard", "minmax"), ks=(2, 3, 4), grid_restarts=1, final_restarts=2,
        stability_runs=2, stability_restarts=1, min_cluster_size=5, micro_clusters=40, home_country="NATION_0",
    )
    summary = segmentation.run(spark, f"{folder}/register", f"{folder}/ledger", f"{folder}/out", settings)
    return f"{folder}/out", summary


def test_summary(done):
    out, summary = done
    row = summary.first()
    assert row["n_clients"] == 150 and row["model"]["k"] in (2, 3, 4)
    assert row["cleaning"]["clients_rows_out"] == "150"
    assert len(row["model"]["segments"].asDict()) == row["model"]["k"]
    text = open(glob.glob(f"{out}/run_summary/part-*")[0]).read()
    assert json.loads(text)["model"]["hierarchical"]["adjusted_rand"] <= 1


def test_tables(spark, done):
    out, _ = done
    grid = spark.read.option("header", True).csv(f"{out}/tables/model_selection_experiment")
    assert grid.count() == 12 and len(grid.columns) == 16
    features = readers.read_features(spark, f"{out}/client_features")
    assert features.count() == 150 and len(features.columns) == 44
    for name in ("cleaning_report", "correlation_matrix", "numeric_summary", "k_scan", "relative_profile",
                 "discriminating_features", "eta_squared", "feature_dictionary", "ward_merges"):
        assert spark.read.option("header", True).csv(f"{out}/tables/{name}").count() > 0
    assert {p.split("/")[-1] for p in glob.glob(f"{out}/models/*")} == {"preprocessor", "kmeans", "pca"}


def test_report_tables(spark, done, tmp_path):
    out, summary = done
    clients, profile = readers.read_report_tables(spark, out)
    assert clients.count() == 150 and profile.count() == summary.first()["model"]["k"]
    assert {"cluster", "segment", "hierarchical_cluster", "pc1", "pc2"} <= set(clients.columns)
    view = R.filtered(clients, {"loan_applied": ["No"]})
    writers.write_selection(R.client_explorer(view), str(tmp_path / "export"))
    assert spark.read.option("header", True).csv(str(tmp_path / "export")).count() == view.count()
    assert R.is_empty(R.filtered(clients, {"country": []}))
    clients.unpersist()


def test_missing_tables_say_what_to_do(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="run"):
        readers.read_report_tables(spark, str(tmp_path / "none"))


def test_missing_ages_stop_the_search(spark, done):
    from cohortry.operators.selection import run_experiment

    features = readers.read_features(spark, f"{done[0]}/client_features")
    gap = features.withColumn("age", F.when(F.col("age") > 30, F.col("age")))
    with pytest.raises(ValueError, match="age"):
        run_experiment(gap, {"behaviour_core": FEATURE_SETS["behaviour_core"]}, ("standard",), (2,), n_init=1)
