"""Connected components of a table of links, in rounds of shuffles."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.staging import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node go to the smallest of the node and its neighbours."""
    both = edges.select(F.inline(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")),
    )))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Each link is joined at its smaller end: (larger end, smallest of that).
    return edges.join(least.withColumnRenamed("u", "b"), "b").select("a", F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.select(F.inline(F.array(
        F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
    ))).filter("a != b")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", name: str = "links") -> DataFrame:
    """``(node, root)``: the smallest node that each linked node reaches; roots are not listed.

    Large-star and small-star steps in turn, each a map-side aggregate and an
    equi-join whose hot keys Spark can split. Every round is written to the
    shared folder. Links with a null end and links to itself are left out;
    no links give no rows.
    """
    edges = staged(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct(), name)
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        edges = staged(_small_star(_large_star(edges)).distinct(), name)
