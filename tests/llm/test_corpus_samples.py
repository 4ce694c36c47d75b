"""The bounded sample against a plain ranking."""
from pyspark.sql import functions as F

from cohortry.llm.samples import class_sample, held_out


def test_sample_is_the_first_of_each_label_by_hash(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"),
                                      F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0).alias("label"))
    rows = labels.filter(~held_out()).select("doc_id", "label", F.xxhash64(F.lit(5), "doc_id").alias("h")).collect()
    want = {(r.doc_id, label) for label in (0, 1)
            for r in sorted((r for r in rows if r.label == label), key=lambda r: r.h)[:300]}
    found = class_sample(docs, labels, 300, 1000)
    assert set(zip(found.column("doc_id").to_pylist(), found.column("label").to_pylist())) == want
    assert len(found) == 600
    assert len(class_sample(docs, labels.limit(0), 300, 1000)) == 0


def test_repeated_ids_neither_swell_nor_empty_a_sample(spark):
    """One id on a third of all rows: the bound is exact, and its label keeps all other texts."""
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 9).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"),
        F.when(F.col("id") % 3 == 0, "fr").when(F.col("id") % 50 == 1, "fr").otherwise("en").alias("lang"))
    docs = rows.unionByName(rows).unionByName(rows.filter("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    labels = docs.select("doc_id", F.lit(1).alias("label")).unionByName(docs.filter("doc_id = 9").select("doc_id", F.lit(0).alias("label")))
    found = class_sample(docs, labels, 200, 1000)
    assert found.column("label").to_pylist().count(1) == 200 and found.column("label").to_pylist().count(0) == 200
    found = class_sample(docs, F.col("lang"), 10_000, 1000)
    want = {(r.doc_id, r.text) for r in rows.filter(~held_out()).filter("lang = 'fr'").collect()}
    assert {(i, t) for i, t, x in zip(*[found.column(c).to_pylist() for c in ("doc_id", "text", "label")]) if x == "fr"} == want
    assert len(class_sample(docs, F.col("lang"), 50, 1000)) == 100
