"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

A hash deals the rows to local partitions. How many rows of each partition go to
each shard is drawn on the driver, as those counts of a uniform shuffle are
distributed (multivariate hypergeometric, shard sizes exact). Each partition
permutes its rows and cuts them by its counts; the shards exchange them, in
pieces of bounded size, and permute again.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def communication_matrix(counts: Sequence[int], sizes: Sequence[int], seed: int) -> np.ndarray:
    """Partitions by shards: row sums ``counts``, column sums ``sizes``."""
    draw = np.random.default_rng(seed)
    left = np.array(sizes, np.int64)
    out = np.empty((len(counts), len(sizes)), np.int64)
    for i, n in enumerate(counts):
        out[i] = _draw(draw, left, n)
        left -= out[i]
    return out


def _draw(draw: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the places that are left, counted by shard; numpy's draw takes fewer than 10**9 places."""
    if left.sum() < 10**9:
        return draw.multivariate_hypergeometric(left, n, method="marginals")
    # Of so many places, split the shards in halves and draw how many go to the first.
    if len(left) == 1:
        return np.array([n])
    half = len(left) // 2
    k = draw_hypergeometric(draw, int(left[:half].sum()), int(left[half:].sum()), n)
    return np.r_[_draw(draw, left[:half], k), _draw(draw, left[half:], n - k)]


def draw_hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` places drawn from ``good + bad`` are good, for numbers of any size.

    Inversion around the mode: the probabilities follow from each other, so none needs a factorial. What lies more
    than 14 deviations and 50 places off has less weight than a double resolves.
    """
    low, high, total = max(0, n - bad), min(n, good), good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    reach = int(14 * (n * (good / total) * (bad / total) * (total - n) / max(1, total - 1)) ** 0.5) + 50 if total else 0
    up = np.arange(mode, min(high, mode + reach), dtype=float)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=float)
    above = np.cumsum(np.log((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))))
    below = np.cumsum(np.log(down * (bad - n + down) / ((good - down + 1) * (n - down + 1))))
    weights = np.cumsum(np.exp(np.r_[below[::-1], 0.0, above]))
    return mode - len(down) + int(np.searchsorted(weights, draw.random() * weights[-1], side="right"))


def _content(docs: DataFrame, columns: Sequence[str]) -> Column:
    """A hash of a row's columns; those that Spark cannot hash (maps) are left out."""
    plain = [F.col(f"_row.`{c}`") for c in columns if "map<" not in docs.schema[c].dataType.simpleString()]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def uniform_shards(docs: DataFrame, shards: int = 24, key: str = "doc_id", seed: int = 23,
                   local_rows: int = 16384, piece_rows: int = 8192) -> DataFrame:
    """``docs`` with ``shard`` (from 0) and ``slot`` (from 0, without gaps in its shard).

    Shard sizes differ by one row at most. Rows that repeat a key, null keys
    among them, are numbered, and both permutations go by key and number, so
    copies are as far apart as other rows. A key of more than ``local_rows`` rows
    is dealt to several local partitions by the rows' places in the input, which must
    then come in the same order twice (files do); counts that do not fit raise. Columns
    of ``docs`` named ``shard`` or ``slot`` are replaced; no rows give no rows.
    """
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    kept = F.struct(*[F.col(f"`{c}`") for c in columns])
    named = docs.select(kept.alias("_row"), F.col(key).alias("_key"))
    spark = docs.sparkSession
    total = named.count()
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    parts = max(1, -(-total // local_rows))
    # Fewer than total / local_rows keys; their rows are spread over partitions by salts.
    hot = named.groupBy("_key").count().filter(F.col("count") > local_rows).select(
        F.col("_key").alias("_hot"), F.ceil(F.col("count") / local_rows).cast("int").alias("_salts"))
    heavy = hot.collect()
    if not heavy:
        named = named.withColumn("_salt", F.lit(0))
    else:
        named = named.withColumn("_at", F.monotonically_increasing_id()).join(
            F.broadcast(spark.createDataFrame(heavy, hot.schema)), F.col("_key").eqNullSafe(F.col("_hot")), "left").withColumn("_salt", F.coalesce(
                F.pmod(F.xxhash64(F.lit(seed + 4), F.col("_at")), F.col("_salts")).cast("int"), F.lit(0))
            ).drop("_at", "_hot", "_salts")
    part = F.pmod(F.xxhash64(F.lit(seed), F.col("_key"), F.col("_salt")), F.lit(parts)).cast("int")
    counts = sorted((r[0], r[1]) for r in named.groupBy(part).count().collect())
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    cuts = spark.createDataFrame(
        [(p, row) for (p, _), row in zip(counts, np.cumsum(matrix, axis=1).tolist())],
        "_part int, _upto array<long>")

    pieces = max(1, -(-sizes[0] // piece_rows)) if total else 1
    same = ["_key", "_salt", "_number"]

    def dealt(rows: DataFrame, tie: Column) -> DataFrame:
        number = F.row_number().over(Window.partitionBy("_part", "_key", "_salt").orderBy(tie))
        place = F.row_number().over(Window.partitionBy("_part").orderBy("_first", *same))
        # One exchange serves both windows.
        rows = rows.withColumn("_part", part).repartition("_part").withColumn("_number", number).withColumns({
            "_first": F.xxhash64(F.lit(seed + 1), *same),
            "_piece": F.pmod(F.xxhash64(F.lit(seed + 2), *same), F.lit(pieces)).cast("int"),
        }).withColumn("_place", place).join(cuts, "_part")
        shard = F.size(F.filter("_upto", lambda x: x < F.col("_place")))
        fits = F.when(shard < shards, shard).otherwise(
            F.raise_error(F.lit("the input changed between two reads; write it as a table first")).cast("int"))
        return rows.withColumn("shard", fits).drop("_upto", "_place")

    # Key, salt and number say where a row goes, so this narrow pass counts what the full one deals.
    held = dealt(named.select("_key", "_salt"), F.lit(0)).groupBy("shard", "_piece").count()
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("shard", "_piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    second = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy(F.xxhash64(F.lit(seed + 3), *same), *same))
    # Rows of one key are numbered by their content, so a repeated task numbers them alike.
    return dealt(named, _content(docs, columns)).withColumn("_second", second).join(starts, ["shard", "_piece"]).select(
        "_row.*", "shard", (F.col("_start") + F.col("_second") - 1).alias("slot"))
