"""Bounded samples of rows to learn from."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def sampled_texts(docs: DataFrame, labels: DataFrame | Column, most: int, most_bytes: int, seed: int = 5) -> DataFrame:
    """``(doc_id, label, text, lang)`` of exactly ``most`` texts per label, or all if there are fewer.

    ``labels`` is a table ``(doc_id, label)``, or the label as a column of ``docs``. Texts are
    taken in the order of a hash of their id, then of the text, and whole; texts of more
    than ``most_bytes``, null ids and held-out rows are not learned from. Equal rows, and equal labels of
    an id, count once. At most ``most`` names of texts per label are broadcast to fetch them.
    """
    text = F.xxhash64("text").alias("_h")
    fit = docs.filter(F.col("doc_id").isNotNull() & F.octet_length("text").between(1, most_bytes) & ~held_out())
    if isinstance(labels, Column):
        rows = fit.select("doc_id", text, labels.alias("label")).filter(F.col("label").isNotNull()).distinct()
    else:
        known = labels.filter(F.col("label").isNotNull() & ~held_out()).select("doc_id", "label").distinct()
        rows = fit.select("doc_id", text).distinct().join(known, "doc_id")
    order = F.xxhash64(F.lit(seed), "doc_id")
    # Ids in reach of the first ``most`` are ranked; an id's rows are cut to ``most`` per label before the shuffle.
    ids = rows.select("doc_id", "label").distinct().groupBy("label").agg(F.count("*").alias("_ids"))  # one row per label
    near = rows.join(F.broadcast(ids), "label").filter(
        order / F.lit(2.0 ** 64) + 0.5 < F.lit(2.0 * most + 1000) / F.col("_ids"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(order, "doc_id", "_h"))
    chosen = near.withColumn("_p", place).filter(F.col("_p") <= most).select("doc_id", "label", "_h")
    names = docs.sparkSession.createDataFrame(sorted(map(tuple, chosen.collect()), key=str), chosen.schema)
    found = fit.select("doc_id", "text", "lang", text).join(F.broadcast(names), ["doc_id", "_h"])
    return found.groupBy("doc_id", "label", "_h").agg(F.min("text").alias("text"), F.min("lang").alias("lang")).drop("_h")


def class_sample(docs: DataFrame, labels: DataFrame | Column, most: int, most_bytes: int, seed: int = 5) -> pa.Table:
    """The rows of ``sampled_texts`` on the driver, in order."""
    return sampled_texts(docs, labels, most, most_bytes, seed).orderBy("doc_id", "label", F.xxhash64("text")).toArrow()
