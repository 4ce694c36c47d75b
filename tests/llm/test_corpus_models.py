"""Toxicity, language identification, resampling and the pipeline."""
from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortry.llm.language_id import fit_languages, identify_language
from cohortry.llm.queries import QUERIES
from cohortry.llm.resampling import fit_ratio, resample
from cohortry.llm.toxicity import fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_on_held_out_rows(spark, labels):
    rows = QUERIES["op1_toxicity"](spark, SF).join(labels, "doc_id", "left").join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    english = [r for r in rows if r.held_out and r.lang == "en" and r.toxic is not None]
    assert all(r.predicted == r.toxic for r in english)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 3


def test_toxicity_odd_rows(odd, none, labels):
    model = fit_toxicity(odd, labels.filter("doc_id < 0"))
    assert not model.fitted
    rows = score_toxicity(odd, model, keep=("doc_id", "score", "root")).collect()
    assert len(rows) == odd.count() and {(r.score, r.predicted) for r in rows} == {(0.0, 0)}
    toxic = labels.sparkSession.createDataFrame([(i, i % 2) for i in range(1, 13)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = fit_toxicity(odd, toxic)
    assert score_toxicity(odd, model).count() == odd.count()
    assert score_toxicity(none, model).count() == 0


def test_language_on_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op7_language_id"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_odd_rows(spark, odd, none):
    model = fit_languages(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = identify_language(odd, model).collect()
    assert len(rows) == odd.count()
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (4, 5, 6)} == {("und", 0.0)}
    assert identify_language(none, model).count() == 0
    assert {r.lang_pred for r in identify_language(odd, fit_languages(none)).collect()} == {"und"}


def test_resampling(spark, odd, none, labels):
    rows = QUERIES["op2_importance_resampling"](spark, SF).join(labels, "doc_id", "left").collect()
    assert sum(r.selected for r in rows) == math.ceil(0.85 * len(rows))
    assert min(r.gumbel_key for r in rows if r.selected) >= max(r.gumbel_key for r in rows if not r.selected)
    good = [r.mean_ratio for r in rows if r.held_out and r.quality == 1]
    bad = [r.mean_ratio for r in rows if r.held_out and r.quality == 0]
    assert sum(g > b for g in good for b in bad) >= 0.98 * len(good) * len(bad)
    ratio = fit_ratio(odd, labels.filter("doc_id < 0"))
    assert resample(odd, ratio).filter("selected").count() == math.ceil(0.85 * odd.count())
    assert resample(none, ratio).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name in ("toxicity", "near_duplicates", "decontamination"):
            assert docs.exceptAll(before).isEmpty() and 0 < docs.count() < before.count()
    clean = kept["toxicity"].join(labels.filter("toxic = 0"), "doc_id", "left_semi").count()
    assert clean >= labels.filter("toxic = 0").count() - 3
    from cohortry.llm.decontamination import contaminated, contamination
    from cohortry.llm.jaccard_join import jaccard_components
    again = jaccard_components(kept["near_duplicates"])
    assert again.filter("doc_id <> component_id").isEmpty()
    assert contamination(kept["decontamination"], spark.read.parquet(f"{SF}/benchmark.parquet")).filter(contaminated()).isEmpty()
    assert kept["mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    out = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, out.collect())) == sorted(map(str, kept["sharding"].collect()))


def test_pipeline_odd_and_empty_documents(spark, odd, none):
    for docs in (odd, none):
        rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, SF).count() <= 2 * docs.count()


def test_one_row_of_each_group_stays(spark, odd, none, tmp_path):
    """Null ids, repeated rows, and an id that heads one group and is a copy in another."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    text = lambda k: " ".join(f"t{k}_{i}" for i in range(30))
    rows = [(1, text(0)), (2, text(0)), (2, text(1)), (3, text(1)), (None, text(1)), (None, text(2)), (None, text(2)), (None, text(2)),
            (5, text(3)), (5, text(3)), (5, text(3)), (6, text(4)), (None, ""), (None, ""), (7, None), (7, None)]
    spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], columns).repartition(3).write.parquet(str(tmp_path / "d"))
    found = corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "d")), SF).collect()
    want = [(1, text(0)), (2, text(1)), (None, text(2)), (5, text(3)), (6, text(4)), (None, ""), (None, ""), (7, None), (7, None)]
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(want, key=str)
    kept = corpus_pipeline.near_duplicates(spark, odd, SF).select("doc_id").collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 1, 4, 5, 6, 7, 9, 11, 12, 13, None], key=str)
    assert corpus_pipeline.near_duplicates(spark, none, SF).count() == 0
