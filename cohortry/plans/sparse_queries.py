"""Sparse one-hot matrices: the dictionary of levels, rows, moments, measures, and a fit on planted groups."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from cohortry.config import FEATURE_SETS, FeatureSet
from cohortry.operators import sparse as SP
from cohortry.plans.metric_queries import _scaled
from cohortry.plans.registry import CLUSTERED, clustered, query, rounded
from cohortry.session import stage_table
from cohortry.sources import views as V

_SET = FEATURE_SETS["prd_encoded"]
_P = len(_SET.numeric)

_LEVELS = """long AS (""" + " UNION ALL ".join(
    f"SELECT DISTINCT {i} AS fi, '{c}' AS feature, CAST({c} AS VARCHAR) AS level FROM clustered WHERE {c} IS NOT NULL"
    for i, c in enumerate(_SET.categorical)) + """),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fi ORDER BY level) - 1 AS r, count(*) OVER (PARTITION BY fi) AS n FROM long),
widths AS (SELECT fi, if(max(n) = 2, 1, max(n)) AS w FROM ranked GROUP BY fi),
dict AS (SELECT fi, feature, level, CASE WHEN n <> 2 OR r > 0 THEN
  CAST(r - if(n = 2, 1, 0) + coalesce((SELECT sum(w) FROM widths WHERE widths.fi < ranked.fi), 0) AS INTEGER) END AS place FROM ranked)"""
_ENTRIES = ("WITH " + CLUSTERED + "," + _scaled(_SET.numeric, "minmax", "clustered") + "," + _LEVELS + ", entries AS ("
            + " UNION ALL ".join(
                [f"SELECT client_id, {i} AS i, CAST({c} AS DOUBLE) AS x FROM scaled" for i, c in enumerate(_SET.numeric)]
                + [f"SELECT client_id, place + {_P} AS i, 1.0 AS x FROM clustered JOIN dict ON fi = {j} AND level = CAST({c} AS VARCHAR) "
                   "WHERE place IS NOT NULL" for j, c in enumerate(_SET.categorical)]) + ")")
# Every client with every column, then the measures by their definitions.
_MEASURES = _ENTRIES + """,
cols AS (SELECT DISTINCT i FROM entries),
p AS (SELECT a.client_id, a.cluster, cols.i, coalesce(e.x, 0.0) AS x
  FROM (SELECT client_id, cluster FROM clustered) a CROSS JOIN cols LEFT JOIN entries e ON e.client_id = a.client_id AND e.i = cols.i),
n AS (SELECT cluster, count(*) AS n FROM clustered GROUP BY 1),
c AS (SELECT cluster, i, avg(x) AS m FROM p GROUP BY 1, 2),
g AS (SELECT i, avg(x) AS g FROM p GROUP BY 1),
d AS (SELECT p.client_id, p.cluster AS own, c.cluster AS l, sum(power(x - m, 2)) AS d2 FROM p JOIN c ON p.i = c.i GROUP BY ALL),
w AS (SELECT own, sum(d2) AS w, avg(sqrt(d2)) AS s FROM d WHERE own = l GROUP BY 1),
b AS (SELECT sum(n * power(m - g, 2)) AS b FROM c JOIN g ON c.i = g.i JOIN n ON n.cluster = c.cluster),
apart AS (SELECT a.cluster AS a, b.cluster AS b, sqrt(sum(power(a.m - b.m, 2))) AS gap FROM c a JOIN c b ON a.i = b.i AND a.cluster <> b.cluster GROUP BY ALL),
worst AS (SELECT apart.a, max((x.s + y.s) / gap) AS r FROM apart JOIN w x ON x.own = apart.a JOIN w y ON y.own = apart.b GROUP BY 1),
far AS (SELECT client_id, max(CASE WHEN d.own = l THEN (d2 + w.w / n) * n / (n - 1) END) AS a,
  min(CASE WHEN d.own <> l THEN d2 + w.w / n END) AS b FROM d JOIN w ON w.own = d.l JOIN n ON n.cluster = d.l GROUP BY 1),
t AS (SELECT sum(n) AS n, count(*) AS k FROM n)
SELECT CAST(t.n AS BIGINT) AS "rows", CAST(k AS INTEGER) AS labels, round((SELECT sum(w) FROM w), 6) + 0.0 AS inertia,
  round((SELECT avg((b - a) / greatest(a, b)) FROM far), 8) + 0.0 AS silhouette,
  round((b / (k - 1)) / ((SELECT sum(w) FROM w) / (t.n - k)), 6) + 0.0 AS calinski_harabasz,
  round((SELECT avg(r) FROM worst), 8) + 0.0 AS davies_bouldin FROM t, b"""


def _matrix(spark, sf_dir):
    return SP.sparse_matrix(clustered(spark, sf_dir), _SET, "minmax")


@query("one_hot_levels", "WITH " + CLUSTERED + "," + _LEVELS + " SELECT feature, level, place FROM dict")
def one_hot_levels(spark, sf_dir):
    return SP.level_places(clustered(spark, sf_dir), _SET.categorical)


@query("sparse_entries", _ENTRIES + ' SELECT client_id, CAST(i AS INTEGER) AS "index", round(x, 9) + 0.0 AS value FROM entries')
def sparse_entries(spark, sf_dir):
    return rounded(SP.entries(_matrix(spark, sf_dir), "client_id"), 9)


@query("sparse_moments", _ENTRIES + """, n AS (SELECT count(*) AS n FROM clustered)
SELECT CAST(i AS INTEGER) AS "index", round(sum(x) / max(n), 8) + 0.0 AS mean,
  round(sum(x * x) / max(n) - power(sum(x) / max(n), 2), 8) + 0.0 AS variance FROM entries, n GROUP BY i""")
def sparse_moments(spark, sf_dir):
    return rounded(SP.moments(_matrix(spark, sf_dir)).select("index", "mean", "variance"), 8)


@query("sparse_measures", _MEASURES)
def sparse_measures(spark, sf_dir):
    """Measures of the investment quartiles over numbers and one-hot columns."""
    return rounded(SP.measures(_matrix(spark, sf_dir), "cluster", 4),
                   {"inertia": 6, "calinski_harabasz": 6, "silhouette": 8, "davies_bouldin": 8})


@query("planted_levels", """
SELECT c_custkey AS client_id, min(c_custkey) OVER (PARTITION BY c_nationkey % 5) AS first_id FROM customer""")
def planted_levels(spark, sf_dir):
    """K-Means over one-hot columns: three attributes tell five groups, a fourth has a level per customer."""
    g = (F.col("c_nationkey") % 5).cast("string")
    rows = V.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("client_id"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_name").alias("name"),
        *[F.concat(F.lit(f"{c} "), g).alias(c) for c in ("zone", "branch", "tariff")])
    matrix = SP.sparse_matrix(stage_table(rows, "planted_levels"), FeatureSet("", ("balance",), ("zone", "branch", "tariff", "name")), "minmax")
    matrix = replace(matrix, df=stage_table(matrix.df, "sparse_rows"))
    labelled = SP.fit_sparse_kmeans(matrix, 5, n_init=10).transform(matrix).select("client_id", "cluster")
    # One row per cluster, five in all.
    first = labelled.groupBy("cluster").agg(F.min("client_id").alias("first_id"))
    return labelled.join(F.broadcast(first), "cluster").select("client_id", "first_id")
