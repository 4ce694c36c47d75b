"""Mixing sources to target weights by systematic sampling, in DataFrame expressions only.

Every document of a source is expected ``rate = target / source size`` times. The
documents of a source stand in one order; with the running sum of expected
copies and one random offset per source, a document is emitted once for every
integer that the sum passes at it. The order goes by size class and, within a
class, by a hash, so each class is taken at the source's rate almost exactly.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SUBS = 1024  # parts of a size class that are ranked apart, by hash


def word_count(text: str = "text") -> Column:
    """Words between white space; a null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """``(source, source_size)`` with each source's ``target``.

    Weights repeat over the sources in code point order, null last. Targets are
    proportional to the weights and stop at ``most`` times the source's size;
    what is above goes to the others by weight. That is one level ``x`` with
    ``target = min(most * size, x * weight)``: sources are capped in the order of
    cap over weight for as long as the level of the rest is not below. The table
    has one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source"))
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    rows = rows.withColumn("_level", level).withColumn("_open", F.col("_cap") > F.col("_level") * F.col("_w"))
    shared = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("_shared", shared).select("source", "source_size", F.when(
        F.col("_cap") <= F.coalesce(F.col("_shared"), F.lit(float("inf"))) * F.col("_w"), F.col("_cap")
    ).otherwise(F.col("_shared") * F.col("_w")).alias("target"))


def mix_sources(docs: DataFrame, size: str, key: str = "doc_id", source: str = "source",
                weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
                seed: int = 17) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` (its source's) and ``copies``, how often the mix takes it.

    ``size`` is a column of ``docs``; null counts as 0. A null source is a source of
    its own. Sources without size take nothing. Equal rows may swap places in the order, all else is
    the same in every run. Columns of
    ``docs`` with the three new names are replaced; no rows give no rows.
    """
    # Rows that repeat an id are told apart by what else they hold; maps cannot be hashed.
    plain = [F.col(f"`{c}`") for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    content = F.xxhash64(*plain)
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("source_size", "target", "copies")])
    rows = docs.select(
        kept.alias("_row"), F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("_source"),
        F.xxhash64(F.lit(seed), F.col(key), content).alias("_hash"),
    ).withColumns({
        "_class": F.floor(F.log2(F.col("_size") + 1) * 4).cast("int"),
        "_sub": F.pmod(F.col("_hash"), F.lit(_SUBS)).cast("int"),
    })
    bucket = ["_source", "_class", "_sub"]
    counts = rows.groupBy(*bucket).agg(F.count("*").alias("_n"), F.sum("_size").alias("_sum"))
    sizes = counts.groupBy(F.when(F.col("_source") != "n", F.substring("_source", 2, 1 << 30)).alias("source")).agg(
        F.sum("_sum").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).withColumn(
        "_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    before = Window.partitionBy("_source").orderBy("_class", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(
        targets, "_source").select(*bucket, "_before", "source_size", "target")
    place = F.row_number().over(Window.partitionBy(*bucket).orderBy("_hash", "_key", "_size"))
    placed = rows.withColumn("_place", place).join(starts, bucket)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("_source")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    upto = lambda i: F.floor(rate * i + offset)
    rank = F.col("_before") + F.col("_place")
    return placed.select("_row.*", "source_size", "target", (upto(rank) - upto(rank - 1)).cast("int").alias("copies"))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each row as often as ``copies`` says."""
    row = mixed.filter("copies > 0").select(F.struct("*").alias("row"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return row.select("row.*")
