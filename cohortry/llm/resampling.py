"""Importance resampling for quality: a target and a raw model of hashed n-grams, and Gumbel top-k.

Both models are bags of hashed unigrams and bigrams of words and marks: the target over
labelled good texts, the raw one over all texts. The mean log ratio of a text's grams,
times ``scale``, is its log weight; adding Gumbel noise and taking the k largest
draws k texts without replacement in proportion to their weights.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm import hashing as H
from cohortry.llm.samples import sampled_texts
from cohortry.llm.staging import staged


def gram_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text, bucket)`` of all unigrams and bigrams."""
    words, first, _ = H.word_hashes(*H.text_bytes(texts), H.WORDS_AND_MARKS)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    pairs = H.mixed(words[:-1] * np.uint64(3) + words[1:]) if len(words) else words
    inner = text[:-1] == text[1:]
    hashes = np.concatenate([words, pairs[inner]])
    return np.concatenate([text, text[:-1][inner]]), ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in H.slices(batch, "text"):
                total += np.bincount(gram_buckets(piece.column("text"), buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])
    return run


def _total(docs: DataFrame, buckets: int) -> np.ndarray:
    """Grams of all texts by bucket, counted in the tasks; one number per bucket reaches the driver."""
    counts = docs.select("text").mapInArrow(_counts(buckets), "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets)
    out[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    return out


def fit_ratio(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, per_label: int = 20_000,
              most_bytes: int = 100_000, prior: float = 1.0) -> np.ndarray:
    """Log ratio of target to raw frequency by bucket.

    The raw counts cover every text of ``docs``. The target counts come from at most
    ``per_label`` texts with quality 1, held-out rows left out; without such texts
    the ratio is 0.
    """
    good = sampled_texts(docs, labels.filter("quality = 1").select("doc_id", F.col("quality").alias("label")), per_label, most_bytes)
    raw, target = _total(docs, buckets), _total(good, buckets)
    if not target.any():
        return np.zeros(buckets)
    # Smoothed towards the raw model, so a bucket that the sample is too small to see stays near 0.
    share = (raw + prior) / (raw + prior).sum()
    return np.log((target + prior * buckets * share) / (target.sum() + prior * buckets) / share)


def resample(docs: DataFrame, ratio: np.ndarray, share: float = 0.85, scale: float = 40.0, doc_id: str = "doc_id",
             text: str = "text", seed: int = 29) -> DataFrame:
    """``(doc_id, mean_ratio, log_weight, gumbel_key, selected)`` for every row of ``docs``.

    ``selected`` marks exactly ``ceil(share * rows)`` rows, those of the largest keys; equal keys go by id,
    a hash of the text and the place in the input. A null, empty or wordless text has ratio 0. The noise depends on
    ``seed``, the id and the text, so only equal rows share it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in H.slices(batch, "text"):
                owner, bucket = gram_buckets(piece.column("text"), len(shared.value))
                n = np.bincount(owner, minlength=len(piece))
                total = np.bincount(owner, shared.value[bucket], len(piece))
                yield pa.record_batch([piece.column("doc_id"), piece.column("tie"), piece.column("at"),
                                       pa.array(total / np.maximum(n, 1), pa.float64())], names=["doc_id", "tie", "at", "mean_ratio"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"),
                       F.monotonically_increasing_id().alias("at"), F.col(text).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, tie long, at long, mean_ratio double")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tie"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    keyed = staged(scored.withColumn("log_weight", F.col("mean_ratio") * scale).withColumn(
        "gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "keys")
    total = keyed.count()
    wanted = int(np.ceil(share * total))
    if not total:
        return keyed.withColumn("selected", F.lit(False)).drop("tie", "at")
    # Keys surely above and surely below the cut need no order; those between are ranked.
    at = 1 - wanted / total
    low, high = keyed.approxQuantile("gumbel_key", [max(0.0, at - 0.002), min(1.0, at + 0.002)], 0.001)
    above = keyed.filter(F.col("gumbel_key") > high).count()
    between = keyed.filter(F.col("gumbel_key").between(low, high)).withColumn("place", F.row_number().over(
        Window.orderBy(F.desc("gumbel_key"), "doc_id", "tie", "at")))
    cut = between.filter(F.col("place") == wanted - above).first()
    if cut is None:
        raise RuntimeError("the quantile sketch missed the cut")
    reached = F.struct(-F.col("gumbel_key"), F.coalesce("doc_id", F.lit(-1 << 63)), F.col("tie"), F.col("at")) <= F.struct(
        F.lit(-cut["gumbel_key"]), F.lit(cut["doc_id"] if cut["doc_id"] is not None else -1 << 63).cast("long"),
        F.lit(cut["tie"]).cast("long"), F.lit(cut["at"]).cast("long"))
    return keyed.withColumn("selected", reached).drop("tie", "at")
