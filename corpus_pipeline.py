"""A corpus pipeline: toxicity, near duplicates, benchmark passages, source mix and shards."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.decontamination import contaminated, contamination
from cohortry.llm.jaccard_join import jaccard_components, row_key
from cohortry.llm.mixing import emit_copies, mix_sources, word_count
from cohortry.llm.sharding import uniform_shards
from cohortry.llm.staging import new_folder
from cohortry.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keep(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text are among ``keys`` (``doc_id, text_hash``)."""
    keys = keys.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.withColumn("_text_hash", F.xxhash64("text")).join(
        keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi"
    ).drop("_text_hash")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the documents that are here."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, keep=COLUMNS).filter("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the smallest id, null ids last, then the first in the input.

    Texts without words are in no group and all stay. Rows are known by their place in the input, not by id.
    """
    groups = jaccard_components(docs, by_row=True)
    heads = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("h"))
    heads = heads.select(F.col("h.row").alias("_row"), F.col("h.doc_id").alias("_id"))
    kept = docs.withColumn("_at", row_key()).join(heads, F.col("_at") == F.col("_row"))
    same = F.when(F.col("doc_id").eqNullSafe(F.col("_id")), True).otherwise(
        F.raise_error(F.lit("the input changed between two reads; write it as a table first")).cast("boolean"))
    return kept.filter(same).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _keep(docs, found.filter(~contaminated())).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    mixed = mix_sources(docs.withColumn("_words", word_count()), "_words")
    return emit_copies(mixed).select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in 24 shards, each with its slot."""
    return uniform_shards(docs, 24).select(*COLUMNS, "shard", "slot")


STAGES = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("mixing", mixing), ("sharding", sharding),
]

#: The classifier is not expressible in SQL; a test holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
