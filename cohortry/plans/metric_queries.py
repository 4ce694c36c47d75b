"""Matrices, measures of labelled tables, the choice of a configuration, and fits."""
from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.config import (
    BEHAVIOUR_CORE, BEHAVIOUR_WIDE, DECLARED, FEATURE_SETS, FINGERPRINT, K_RANGE, LOGGED, SCALERS,
)
from cohortry.operators import metrics as M
from cohortry.operators import selection as SE
from cohortry.operators import validation as VA
from cohortry.operators.lloyd import Labeling
from cohortry.operators.matrix import Matrix, build_matrix, named_matrix
from cohortry.operators.scalars import one_row
from cohortry.plans.registry import CLUSTERED, FEATURES, clustered, components_sql, features, query, rnd, rounded
from cohortry.session import stage_table
from cohortry.sources import views as V

WIDE = list(BEHAVIOUR_WIDE)


# --- SQL of scaled columns ------------------------------------------------------
def _scaled(columns, scaler, source):
    """CTE ``scaled`` with the columns of one scaler, and the one-row table it needs."""
    raw = {c: f"ln(1 + {c})" if scaler == "log_standard" and c in LOGGED else c for c in columns}
    if scaler == "minmax":
        ends = ", ".join(f"min({x}) AS a_{c}, max({x}) - min({x}) AS b_{c}" for c, x in raw.items())
    else:
        ends = ", ".join(f"avg({x}) AS a_{c}, stddev_pop({x}) AS b_{c}" for c, x in raw.items())
    picked = ", ".join(f"coalesce(({x} - a_{c}) / nullif(b_{c}, 0), 0) AS {c}" for c, x in raw.items())
    return f"""ends AS (SELECT {ends} FROM {source}),
scaled AS (SELECT client_id, cluster, {picked} FROM {source}, ends)"""


def _matrix_sql(scaler):
    return ("WITH " + CLUSTERED + "," + _scaled(WIDE, scaler, "clustered")
            + f" SELECT client_id, {rnd(' '.join(WIDE), 9)} FROM scaled")


def _matrix(spark, sf_dir, scaler):
    return rounded(named_matrix(build_matrix(features(spark, sf_dir), FEATURE_SETS["behaviour_wide"], scaler)), 9)


@query("scaled_standard", _matrix_sql("standard"))
def scaled_standard(spark, sf_dir):
    return _matrix(spark, sf_dir, "standard")


@query("scaled_minmax", _matrix_sql("minmax"))
def scaled_minmax(spark, sf_dir):
    return _matrix(spark, sf_dir, "minmax")


@query("scaled_log_standard", _matrix_sql("log_standard"))
def scaled_log_standard(spark, sf_dir):
    return _matrix(spark, sf_dir, "log_standard")


_CHANNELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("one_hot_columns", "WITH " + FEATURES + """
SELECT client_id, CAST(gender = 'M' AS DOUBLE) AS "gender_M", """ + ", ".join(
    f'CAST(referral_channel = \'{c}\' AS DOUBLE) AS "referral_channel_{c}"' for c in _CHANNELS) + ", " + ", ".join(
    f'CAST(country = \'NATION_{i}\' AS DOUBLE) AS "country_NATION_{i}"' for i in range(25)) + " FROM features")
def one_hot_columns(spark, sf_dir):
    matrix = build_matrix(features(spark, sf_dir), FEATURE_SETS["prd_encoded"], "minmax")
    hot = [n for n in matrix.names if n.startswith(("gender_", "referral_channel_", "country_"))]
    return named_matrix(matrix).select("client_id", *hot)


# --- measures of a rule-based labelling ------------------------------------------
_SCALED = "WITH " + CLUSTERED + "," + _scaled(WIDE, "standard", "clustered")
_POINT = "[" + ", ".join(WIDE) + "]"


def _labelled(spark, sf_dir):
    return build_matrix(clustered(spark, sf_dir), FEATURE_SETS["behaviour_wide"], "standard")


def _eta_sql(columns, source="clustered", label="cluster", by=""):
    """One row per feature with its eta squared, per value of ``by`` when given."""
    parts = []
    for c in columns:
        head = f"{by}, " if by else ""
        where = f"PARTITION BY {by}" if by else ""
        parts.append(
            f"SELECT {head}'{c}' AS feature, coalesce(sum(power(m - g, 2)) / nullif(sum(power(x - g, 2)), 0), 0) AS eta_squared "
            f"FROM (SELECT {head}CAST({c} AS DOUBLE) AS x, avg({c}) OVER ({where}) AS g, "
            f"avg({c}) OVER (PARTITION BY {head}{label}) AS m FROM {source})" + (f" GROUP BY {by}" if by else "")
        )
    return " UNION ALL ".join(parts)


@query("eta_squared", "WITH " + CLUSTERED + ", e AS (" + _eta_sql(FINGERPRINT)
       + ") SELECT feature, round(eta_squared, 8) + 0.0 AS eta_squared FROM e")
def eta_squared(spark, sf_dir):
    return rounded(M.eta_squared(clustered(spark, sf_dir), "cluster", FINGERPRINT).orderBy(
        F.desc("eta_squared")), 8)


def _in(columns):
    return "(" + ", ".join(f"'{c}'" for c in columns) + ")"


_SEPARATION = list(dict.fromkeys(BEHAVIOUR_CORE + DECLARED))


@query("separation", "WITH " + CLUSTERED + ", e AS (" + _eta_sql(_SEPARATION) + f""")
SELECT round(avg(eta_squared) FILTER (feature IN {_in(BEHAVIOUR_CORE)}), 8) AS behavioural_separation,
  round(avg(eta_squared) FILTER (feature IN {_in(DECLARED)}), 8) AS declared_separation FROM e""")
def separation(spark, sf_dir):
    return rounded(M.separation(clustered(spark, sf_dir), "cluster"), 8)


@query("variance_ratio", _SCALED + ", s AS (" + " UNION ALL ".join(
    f"SELECT sum(power({c} - m, 2)) AS w, sum(power(m - g, 2)) AS b FROM "
    f"(SELECT {c}, avg({c}) OVER () AS g, avg({c}) OVER (PARTITION BY cluster) AS m FROM scaled)" for c in WIDE
) + """), t AS (SELECT sum(w) AS w, sum(b) AS b FROM s), n AS (SELECT count(*) AS n, count(DISTINCT cluster) AS k FROM scaled)
SELECT n AS "rows", k AS labels, round(w, 6) + 0.0 AS inertia, round((b / (k - 1)) / (w / (n - k)), 6) + 0.0 AS calinski_harabasz
FROM t, n""")
def variance_ratio(spark, sf_dir):
    m = _labelled(spark, sf_dir)
    return rounded(M.variance_ratio(m.df, "cluster", m.columns), 6)


_DB = """
, p AS (SELECT client_id, cluster, unnest(""" + _POINT + """) AS x, unnest(range(""" + str(len(WIDE)) + """)) AS i FROM scaled),
c AS (SELECT cluster, i, avg(x) AS m FROM p GROUP BY 1, 2),
d AS (SELECT client_id, p.cluster, sqrt(sum(power(x - m, 2))) AS d FROM p JOIN c ON p.cluster = c.cluster AND p.i = c.i GROUP BY 1, 2),
s AS (SELECT cluster, avg(d) AS s FROM d GROUP BY 1),
g AS (SELECT a.cluster AS a, b.cluster AS b, sqrt(sum(power(a.m - b.m, 2))) AS g FROM c a JOIN c b ON a.i = b.i AND a.cluster <> b.cluster GROUP BY 1, 2),
w AS (SELECT g.a, max((x.s + y.s) / g.g) AS r FROM g JOIN s x ON x.cluster = g.a JOIN s y ON y.cluster = g.b GROUP BY 1)
"""


@query("davies_bouldin", _SCALED + _DB + "SELECT round(avg(r), 8) AS davies_bouldin FROM w")
def davies_bouldin(spark, sf_dir):
    m = _labelled(spark, sf_dir)
    return rounded(M.davies_bouldin(m.df, "cluster", m.columns), 8)


def _silhouette_sql(source, label, point, key):
    return f"""
pairs AS (SELECT a.{key} AS k, a.{label} AS l, b.{label} AS o,
    sum(list_distance({point.format('a')}, {point.format('b')})) AS s, count(*) AS n
  FROM {source} a, {source} b GROUP BY 1, 2, 3),
near AS (SELECT k, l, min(s / n) FILTER (o <> l) AS b, max(s / nullif(n - 1, 0)) FILTER (o = l) AS a,
    max(n) FILTER (o = l) AS own FROM pairs GROUP BY 1, 2),
sil AS (SELECT k, l, CASE WHEN own = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS s FROM near)"""


_POINT_OF = "[" + ", ".join("{0}." + c for c in WIDE) + "]"


@query("silhouette_by_cluster", _SCALED + "," + _silhouette_sql("scaled", "cluster", _POINT_OF, "client_id") + """
SELECT l AS label, round(avg(s), 6) + 0.0 AS mean, round(min(s), 6) + 0.0 AS min, round(max(s), 6) + 0.0 AS max,
  count(*) AS size FROM sil GROUP BY l""")
def silhouette_by_cluster(spark, sf_dir):
    m = _labelled(spark, sf_dir)
    df = m.df.select(*m.columns, "cluster")
    return rounded(M.silhouette_by_label(df, m.columns, {"cluster": 4}).drop("labeling"), 6)


@query("embedding_silhouette", "WITH " + _silhouette_sql("embeddings", "label", "CAST({0}.embedding AS DOUBLE[])", "vec_id") + """
SELECT l AS label, round(avg(s), 5) + 0.0 AS mean, round(min(s), 5) + 0.0 AS min, round(max(s), 5) + 0.0 AS max,
  count(*) AS size FROM sil GROUP BY l""")
def embedding_silhouette(spark, sf_dir):
    df, columns, k = _embedding_columns(spark, sf_dir)
    return rounded(M.silhouette_by_label(df, columns, {"label": k}).drop("labeling"), 5)


def _embedding_columns(spark, sf_dir):
    """Embedding components as columns; their number and the labels are those of the table."""
    rows = V.table(spark, sf_dir, "embeddings")
    shape = rows.agg(F.max(F.size("embedding")).alias("d"), F.max("label").alias("k")).first()
    columns = [f"e_{i}" for i in range(shape["d"])]
    df = rows.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(columns)])
    return df, columns, shape["k"] + 1


@query("embedding_validity", """
WITH p AS (SELECT vec_id AS client_id, label AS cluster, CAST(unnest(embedding) AS DOUBLE) AS x,
    unnest(range(len(embedding))) AS i FROM embeddings),
""" + _DB.strip().split("\n", 1)[1] + """
, t AS (SELECT sum(power(x - m, 2)) AS w FROM p JOIN c ON p.cluster = c.cluster AND p.i = c.i),
v AS (SELECT sum(power(x - g, 2)) AS tot FROM (SELECT x, avg(x) OVER (PARTITION BY i) AS g FROM p)),
n AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings)
SELECT round(w, 6) AS inertia, round(((tot - w) / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz,
  round((SELECT avg(r) FROM w), 6) AS davies_bouldin FROM t, v, n""")
def embedding_validity(spark, sf_dir):
    df, columns, _ = _embedding_columns(spark, sf_dir)
    db = one_row(M.davies_bouldin(df, "label", columns))["davies_bouldin"]
    ratio = M.variance_ratio(df, "label", columns)
    return rounded(ratio.select("inertia", "calinski_harabasz", db.alias("davies_bouldin")), 6)


_ARI = """
SELECT (s - sa * sb / p) / ((sa + sb) / 2 - sa * sb / p) AS ari FROM (
  SELECT (SELECT sum(n * (n - 1) / 2.0) FROM {cells}) AS s,
    (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM {cells} GROUP BY a)) AS sa,
    (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM {cells} GROUP BY b)) AS sb,
    (SELECT sum(n) * (sum(n) - 1) / 2.0 FROM {cells}) AS p)"""


@query("flag_redundancy", "WITH " + CLUSTERED + """
, cells AS (SELECT cluster AS a, is_company || '' || loan_flag || is_investment || is_domestic AS b, CAST(count(*) AS DOUBLE) AS n
  FROM clustered GROUP BY 1, 2)
SELECT round(ari, 8) + 0.0 AS flag_redundancy FROM (""" + _ARI.format(cells="cells") + ")")
def flag_redundancy(spark, sf_dir):
    return rounded(M.flag_redundancy(clustered(spark, sf_dir), "cluster"), 8)


_UNITS = "CAST(least(3, floor(total_properties / 8.0)) AS INTEGER)"


@query("partition_agreement", "WITH " + CLUSTERED + f"""
, cells AS (SELECT cluster AS a, {_UNITS} AS b, CAST(count(*) AS DOUBLE) AS n FROM clustered GROUP BY 1, 2),
tot AS (SELECT sum(n) AS t FROM cells),
ra AS (SELECT a, sum(n) AS x FROM cells GROUP BY 1), rb AS (SELECT b, sum(n) AS y FROM cells GROUP BY 1),
mi AS (SELECT sum(n / t * ln(n * t / (x * y))) AS v FROM cells JOIN ra USING (a) JOIN rb USING (b), tot),
ha AS (SELECT -sum(x / t * ln(x / t)) AS v FROM ra, tot), hb AS (SELECT -sum(y / t * ln(y / t)) AS v FROM rb, tot),
terms AS (SELECT x, y, t, unnest(range(CAST(greatest(1, x + y - t) AS BIGINT), CAST(least(x, y) AS BIGINT) + 1)) AS m
  FROM ra, rb, tot),
emi AS (SELECT sum(m / t * ln(t * m / (x * y)) * exp(
    lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(m + 1)
    - lgamma(x - m + 1) - lgamma(y - m + 1) - lgamma(t - x - y + m + 1))) AS v FROM terms)
SELECT round(ari, 8) + 0.0 AS adjusted_rand,
  round((mi.v - emi.v) / ((ha.v + hb.v) / 2 - emi.v), 7) + 0.0 AS adjusted_mutual_info
FROM ({_ARI.format(cells='cells')}), mi, ha, hb, emi""")
def partition_agreement(spark, sf_dir):
    """Investment quartiles against bands of eight units."""
    units = F.least(F.lit(3), F.floor(F.col("total_properties") / 8)).cast("int")
    rows = clustered(spark, sf_dir).select("cluster", units.alias("units"))
    return rounded(M.compare_partitions(rows, "cluster", "units"),
                   {"adjusted_rand": 8, "adjusted_mutual_info": 7})


@query("smallest_cluster", "WITH " + CLUSTERED + """
SELECT min(n) AS min_cluster_size, min(n) / CAST(sum(n) AS DOUBLE) AS min_cluster_pct,
  CAST(0 AS BIGINT) AS size_with_empty
FROM (SELECT cluster, count(*) AS n FROM clustered GROUP BY 1)""")
def smallest_cluster(spark, sf_dir):
    rows = clustered(spark, sf_dir)
    gap = one_row(M.cluster_sizes(rows, "cluster", 5))["min_cluster_size"]
    return M.cluster_sizes(rows, "cluster", 4).withColumn("size_with_empty", gap)


# --- a grid of rule-based labellings ---------------------------------------------
_ALL_HOT = {
    "gender": ("M",), "referral_channel": _CHANNELS, "country": tuple(f"NATION_{i}" for i in range(25)),
    "region": ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"),
}


def _bands(x, lo, hi, k):
    return F.least(F.lit(k - 1), F.floor((x - lo) * k / (hi - lo))).cast("int")


def _rule_labels(spark, sf_dir):
    """All clients with equal-width bands of investment as labels, one per K."""
    rows = features(spark, sf_dir)
    e = one_row(rows.agg(F.min("total_investment").alias("lo"), F.max("total_investment").alias("hi")))
    marked = rows.withColumn("_e", e)
    for k in K_RANGE:
        marked = marked.withColumn(
            f"label_{k}", _bands(F.col("total_investment"), F.col("_e.lo"), F.col("_e.hi"), k))
    return stage_table(marked.drop("_e"), "rule_labels")


def _rule_grid(spark, sf_dir):
    """Every feature set, scaler and K, 162 configurations, scored like fitted clusters."""
    marked = _rule_labels(spark, sf_dir)
    names = {k: f"label_{k}" for k in K_RANGE}
    blocks, views = SE.experiment_blocks(marked, FEATURE_SETS, SCALERS, list(names.values()))
    keys = [(view, k) for view in views for k in K_RANGE]
    scores = SE.measure_substance(blocks, [
        Labeling(blocks.at(views[view]), k, label=int(blocks.at([names[k]])[0])) for view, k in keys])
    blocks.release()
    return SE.viability(SE.experiment_table(marked, views, keys, scores, {}))


def _grid_vectors():
    """CTEs with each client's vector in every matrix: ``vec (fs, sc, id, v)``."""
    numeric = list(dict.fromkeys(c for fs in FEATURE_SETS.values() for c in fs.numeric))
    ctes, parts = [], []
    for sc in SCALERS:
        raw = {c: f"ln(1 + {c})" if sc == "log_standard" and c in LOGGED else c for c in numeric}
        a, b = ("min({0})", "max({0}) - min({0})") if sc == "minmax" else ("avg({0})", "stddev_pop({0})")
        ctes.append(f"e_{sc} AS (SELECT " + ", ".join(f"{a.format(x)} AS a_{c}, {b.format(x)} AS b_{c}" for c, x in raw.items()) + " FROM marked)")
        for name, fs in FEATURE_SETS.items():
            cells = [f"CAST(coalesce(({raw[c]} - a_{c}) / nullif(b_{c}, 0), 0) AS DOUBLE)" for c in fs.numeric]
            cells += [f"CAST({c} = '{level}' AS DOUBLE)" for c in fs.categorical for level in _ALL_HOT[c]]
            parts.append(f"SELECT '{name}' AS fs, '{sc}' AS sc, client_id AS id, [{', '.join(cells)}] AS v FROM marked, e_{sc}")
    return ",\n".join(ctes) + ",\nvec AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


def _grid_sql():
    """The same grid in SQL: vectors of every matrix, then each measure per configuration."""
    label = ", ".join(
        f"CAST(least({k - 1}, floor((total_investment - lo) * {k} / (hi - lo))) AS INTEGER) AS label_{k}" for k in K_RANGE)
    ks = "[" + ", ".join(map(str, K_RANGE)) + "]"
    labels = "[" + ", ".join(f"label_{k}" for k in K_RANGE) + "]"
    eta = _eta_sql(_SEPARATION, "stacked", "l", "k")
    return "WITH " + FEATURES + f""",
lims AS (SELECT min(total_investment) AS lo, max(total_investment) AS hi FROM features),
marked AS MATERIALIZED (SELECT features.*, {label} FROM features, lims),
stacked AS (SELECT client_id AS id, {', '.join(_SEPARATION)}, unnest({ks}) AS k, unnest({labels}) AS l FROM marked),
lab AS MATERIALIZED (SELECT id, k, l FROM stacked),
{_grid_vectors()},
flat AS (SELECT fs, sc, id, unnest(v) AS x, unnest(range(len(v))) AS i FROM vec),
cen AS MATERIALIZED (SELECT fs, sc, k, l, max(n) AS n, list(m ORDER BY i) AS m FROM (
  SELECT fs, sc, k, l, i, avg(x) AS m, count(*) AS n FROM flat JOIN lab USING (id) GROUP BY ALL) GROUP BY fs, sc, k, l),
own AS (SELECT vec.fs, vec.sc, lab.k, lab.l, vec.id, power(list_distance(v, m), 2) AS d2 FROM vec JOIN lab ON lab.id = vec.id
  JOIN cen ON cen.fs = vec.fs AND cen.sc = vec.sc AND cen.k = lab.k AND cen.l = lab.l),
spr AS MATERIALIZED (SELECT fs, sc, k, l, avg(sqrt(d2)) AS s, avg(d2) AS v, sum(d2) AS w, count(*) AS n FROM own GROUP BY ALL),
wit AS (SELECT fs, sc, k, sum(w) AS w, sum(n) AS n, count(*) AS kk FROM spr GROUP BY ALL),
tot AS (SELECT fs, sc, sum(power(x - g, 2)) AS t FROM (SELECT fs, sc, x, avg(x) OVER (PARTITION BY fs, sc, i) AS g FROM flat) GROUP BY ALL),
wor AS (SELECT a.fs, a.sc, a.k, a.l, max((x.s + y.s) / list_distance(a.m, b.m)) AS r FROM cen a
  JOIN cen b ON a.fs = b.fs AND a.sc = b.sc AND a.k = b.k AND a.l <> b.l
  JOIN spr x ON x.fs = a.fs AND x.sc = a.sc AND x.k = a.k AND x.l = a.l
  JOIN spr y ON y.fs = a.fs AND y.sc = a.sc AND y.k = a.k AND y.l = b.l GROUP BY ALL),
dbi AS (SELECT fs, sc, k, avg(r) AS davies_bouldin FROM wor GROUP BY ALL),
far AS (SELECT vec.fs, vec.sc, lab.k, vec.id, max(CASE WHEN cen.l = lab.l THEN cen.n END) AS size,
    max(CASE WHEN cen.l = lab.l THEN (power(list_distance(vec.v, m), 2) + spr.v) * cen.n / nullif(cen.n - 1, 0) END) AS a,
    min(CASE WHEN cen.l <> lab.l THEN power(list_distance(vec.v, m), 2) + spr.v END) AS b
  FROM vec JOIN lab ON lab.id = vec.id JOIN cen ON cen.fs = vec.fs AND cen.sc = vec.sc AND cen.k = lab.k
  JOIN spr ON spr.fs = vec.fs AND spr.sc = vec.sc AND spr.k = cen.k AND spr.l = cen.l GROUP BY ALL),
sil AS (SELECT fs, sc, k, avg(CASE WHEN size = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) AS silhouette FROM far GROUP BY ALL),
siz AS (SELECT k, CASE WHEN count(*) < k THEN 0 ELSE min(n) END AS mn, sum(n) AS t FROM (SELECT k, l, count(*) AS n FROM lab GROUP BY ALL) GROUP BY k),
eta AS ({eta}),
sep AS (SELECT k, avg(eta_squared) FILTER (feature IN {_in(BEHAVIOUR_CORE)}) AS beh,
  avg(eta_squared) FILTER (feature IN {_in(DECLARED)}) AS decl FROM eta GROUP BY k),
cel AS (SELECT k, l AS a, is_company || '' || loan_flag || is_investment || is_domestic AS b, CAST(count(*) AS DOUBLE) AS n FROM stacked GROUP BY ALL),
ari AS (SELECT k, sum(n * (n - 1) / 2) AS s, max(t) * (max(t) - 1) / 2 AS p, sum(n * (ai - 1) / 2) AS sa, sum(n * (bj - 1) / 2) AS sb
  FROM (SELECT *, sum(n) OVER (PARTITION BY k, a) AS ai, sum(n) OVER (PARTITION BY k, b) AS bj, sum(n) OVER (PARTITION BY k) AS t FROM cel) GROUP BY k),
grid AS MATERIALIZED (SELECT wit.fs AS feature_set, wit.sc AS scaler, CAST((SELECT max(len(v)) FROM vec WHERE vec.fs = wit.fs) AS INTEGER) AS n_features,
  CAST(wit.k AS INTEGER) AS k, w AS inertia, silhouette, ((tot.t - w) / (kk - 1)) / (w / (n - kk)) AS calinski_harabasz, davies_bouldin,
  CAST(mn AS BIGINT) AS min_cluster_size, mn / CAST(siz.t AS DOUBLE) AS min_cluster_pct, beh AS behavioural_separation, decl AS declared_separation,
  (s - sa * sb / p) / ((sa + sb) / 2 - sa * sb / p) AS flag_redundancy,
  mn >= 25 AS actionable, beh > decl AND beh >= 0.1 AS substantive, mn >= 25 AND beh > decl AND beh >= 0.1 AS viable
  FROM wit JOIN tot ON wit.fs = tot.fs AND wit.sc = tot.sc JOIN dbi ON dbi.fs = wit.fs AND dbi.sc = wit.sc AND dbi.k = wit.k
  JOIN sil ON sil.fs = wit.fs AND sil.sc = wit.sc AND sil.k = wit.k JOIN siz ON siz.k = wit.k JOIN sep ON sep.k = wit.k JOIN ari ON ari.k = wit.k),
best AS (SELECT feature_set, scaler, arg_max(k, (round(silhouette, 9), -k)) AS k_silhouette, arg_min(k, (round(davies_bouldin, 9), k)) AS k_davies_bouldin,
  arg_max(k, (round(calinski_harabasz, 6), -k)) AS k_calinski_harabasz FROM grid GROUP BY ALL),
votes AS (SELECT feature_set, scaler, k, CAST(count(*) AS INTEGER) AS n_indices_agreeing, string_agg(v, ',' ORDER BY v) AS voted_by FROM (
  SELECT feature_set, scaler, k_silhouette AS k, 'silhouette' AS v FROM best UNION ALL SELECT feature_set, scaler, k_davies_bouldin, 'davies_bouldin' FROM best
  UNION ALL SELECT feature_set, scaler, k_calinski_harabasz, 'calinski_harabasz' FROM best) GROUP BY ALL)
"""


_GRID_SQL = _grid_sql()
_MEASURES = ("inertia silhouette calinski_harabasz davies_bouldin min_cluster_pct behavioural_separation "
             "declared_separation flag_redundancy")


@query("rule_grid", _GRID_SQL + f"""SELECT feature_set, scaler, n_features, k, {rnd(_MEASURES, 6)}, min_cluster_size,
  actionable, substantive, viable FROM grid""")
def rule_grid(spark, sf_dir):
    return rounded(_rule_grid(spark, sf_dir), 6)


@query("index_votes", _GRID_SQL + "SELECT * FROM votes")
def index_votes(spark, sf_dir):
    return SE.index_consensus(_rule_grid(spark, sf_dir))


@query("best_k_per_index", _GRID_SQL + "SELECT * FROM best")
def best_k_per_index(spark, sf_dir):
    return SE.best_k_per_index(_rule_grid(spark, sf_dir))


@query("selected_configuration", _GRID_SQL + """
SELECT feature_set, scaler, k, coalesce(n_indices_agreeing, 0) AS n_indices_agreeing, coalesce(voted_by, '') AS voted_by,
  round(silhouette, 6) AS silhouette
FROM grid LEFT JOIN votes USING (feature_set, scaler, k)
WHERE viable OR NOT (SELECT bool_or(viable) FROM grid)
ORDER BY n_indices_agreeing DESC, grid.silhouette DESC, behavioural_separation DESC, feature_set, scaler, k LIMIT 1""")
def selected_configuration(spark, sf_dir):
    return rounded(SE.select_best(_rule_grid(spark, sf_dir)).select(
        "feature_set", "scaler", "k", "n_indices_agreeing", "voted_by", "silhouette"), 6)


@query("silhouette_leaders", _GRID_SQL + """
SELECT feature_set, scaler, k, round(silhouette, 6) AS silhouette, substantive
FROM grid ORDER BY grid.silhouette DESC, feature_set, scaler, k LIMIT 8""")
def silhouette_leaders(spark, sf_dir):
    return rounded(SE.top_by_silhouette(_rule_grid(spark, sf_dir), 8).select(
        "feature_set", "scaler", "k", "silhouette", "substantive"), 6)


@query("elbow", _GRID_SQL + """, e AS (SELECT *, (k - 2) / 8.0 AS x, (inertia - min(inertia) OVER w) / (max(inertia) OVER w - min(inertia) OVER w) AS y
  FROM grid WINDOW w AS (PARTITION BY feature_set, scaler)),
f AS (SELECT *, max(y) FILTER (k = 2) OVER w AS y0, max(y) FILTER (k = 10) OVER w AS y1 FROM e WINDOW w AS (PARTITION BY feature_set, scaler))
SELECT feature_set, scaler, arg_max(k, (round(abs(x * (y1 - y0) - (y - y0)), 10), -k)) AS elbow_k FROM f GROUP BY 1, 2""")
def elbow(spark, sf_dir):
    return SE.elbow(_rule_grid(spark, sf_dir), ("feature_set", "scaler"))


# --- fits ---------------------------------------------------------------------
def _staged_matrix(spark, sf_dir):
    return build_matrix(clustered(spark, sf_dir), FEATURE_SETS["behaviour_wide"], "standard")


@query("kmeans_grid")
def kmeans_grid(spark, sf_dir):
    """Every feature set, scaler and K with 20 restarts: 3240 models over all clients."""
    return SE.run_experiment(clustered(spark, sf_dir))


@query("kmeans_scan")
def kmeans_scan(spark, sf_dir):
    """K from 2 to 10 with 20 restarts."""
    return SE.scan_k(_staged_matrix(spark, sf_dir))


@query("kmeans_segments")
def kmeans_segments(spark, sf_dir):
    """Final fit with four clusters and 50 restarts, named and profiled."""
    from cohortry.operators.profiles import attach_segments

    m = _staged_matrix(spark, sf_dir)
    rows = m.df.drop("cluster")
    model = SE.fit_kmeans(rows, 4, n_init=50, columns=m.columns).setPredictionCol("cluster")
    labelled = stage_table(model.transform(rows).drop("features", *m.columns), "kmeans_labels")
    return attach_segments(labelled)[1].select("cluster", "segment", "n_clients", "pct_capital")


@query("ward_agreement")
def ward_agreement(spark, sf_dir):
    """Ward over 200 micro-clusters against the investment quartiles."""
    m = _staged_matrix(spark, sf_dir)
    tree = VA.fit_hierarchical(m.df, m.columns, 4)
    return M.compare_partitions(tree.labels, "cluster", "hierarchical_cluster").withColumn(
        "cophenetic", F.lit(tree.cophenetic))


@query("subsample_stability")
def subsample_stability(spark, sf_dir):
    """100 subsamples with 10 restarts each."""
    m = _staged_matrix(spark, sf_dir)
    rows = m.df.drop("cluster")
    base = SE.fit_kmeans(rows, 4, n_init=50, columns=m.columns).setPredictionCol("base").transform(rows)
    return VA.stability(VA.stability_runs(base, m.columns, 4, "base"))


# --- fits whose best result is known ---------------------------------------------
# Ten groups of customers at distances that triple, with some noise: the best K clusters
# are the K - 1 farthest groups and all others together.
_PLANTED = """
planted AS (SELECT c_custkey AS client_id, c_nationkey % 10 AS g, power(3, c_nationkey % 10) + c_acctbal / 1e5 AS x_0,
  (c_custkey % 7) / 10.0 AS x_1 FROM customer)"""


def _planted(spark, sf_dir):
    g = F.col("c_nationkey") % 10
    return stage_table(V.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("client_id"), (F.pow(F.lit(3.0), g) + F.col("c_acctbal") / 1e5).alias("x_0"),
        ((F.col("c_custkey") % 7) / 10.0).cast("double").alias("x_1")), "planted")


@query("planted_scan", "WITH " + _PLANTED + """,
lab AS (SELECT client_id AS id, k, greatest(g - (10 - k), 0) AS l, x_0 AS x, CAST(x_1 AS DOUBLE) AS y FROM planted, (SELECT unnest(range(2, 11)) AS k)),
cen AS (SELECT k, l, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) + var_pop(y) AS v FROM lab GROUP BY ALL),
dev AS (SELECT lab.k, lab.l, id, power(x - mx, 2) + power(y - my, 2) AS d2 FROM lab JOIN cen ON lab.k = cen.k AND lab.l = cen.l),
wit AS (SELECT k, sum(d2) AS w FROM dev GROUP BY k),
grd AS (SELECT avg(x) AS gx, avg(y) AS gy FROM lab),
btw AS (SELECT k, sum(n * (power(mx - gx, 2) + power(my - gy, 2))) AS b, sum(n) AS n, min(n) AS mn FROM cen, grd GROUP BY k),
spr AS (SELECT k, l, avg(sqrt(d2)) AS s FROM dev GROUP BY ALL),
wor AS (SELECT a.k, a.l, max((x.s + y.s) / sqrt(power(a.mx - b.mx, 2) + power(a.my - b.my, 2))) AS r FROM cen a JOIN cen b ON a.k = b.k AND a.l <> b.l
  JOIN spr x ON x.k = a.k AND x.l = a.l JOIN spr y ON y.k = b.k AND y.l = b.l GROUP BY ALL),
dbi AS (SELECT k, avg(r) AS db FROM wor GROUP BY k),
far AS (SELECT lab.k, id, max(CASE WHEN cen.l = lab.l THEN (power(x - mx, 2) + power(y - my, 2) + v) * n / (n - 1) END) AS a,
  min(CASE WHEN cen.l <> lab.l THEN power(x - mx, 2) + power(y - my, 2) + v END) AS b FROM lab JOIN cen ON lab.k = cen.k GROUP BY ALL),
sil AS (SELECT k, avg((b - a) / greatest(a, b)) AS s FROM far GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, round(ln(w), 8) + 0.0 AS ln_inertia, round(sil.s, 8) + 0.0 AS silhouette,
  round(ln((b / (k - 1)) / (w / (n - k))), 8) + 0.0 AS ln_calinski_harabasz, round(db, 8) + 0.0 AS davies_bouldin,
  CAST(mn AS BIGINT) AS min_cluster_size, round(mn / CAST(n AS DOUBLE), 8) + 0.0 AS min_cluster_pct
FROM wit JOIN btw USING (k) JOIN dbi USING (k) JOIN sil USING (k)""")
def planted_scan(spark, sf_dir):
    """The scan of K from 2 to 10 with 20 restarts on groups whose best clusters are known."""
    rows = _planted(spark, sf_dir)
    matrix = Matrix(rows, ["x_0", "x_1"], ["x_0", "x_1"], None)
    return rounded(SE.scan_k(matrix).select(
        "k", F.log("inertia").alias("ln_inertia"), "silhouette", F.log("calinski_harabasz").alias("ln_calinski_harabasz"),
        "davies_bouldin", "min_cluster_size", "min_cluster_pct"), 8)


_PLANTED_4 = "CAST(greatest(g - 6, 0) AS INTEGER)"


@query("planted_segments", "WITH " + _PLANTED + f" SELECT client_id, {_PLANTED_4} AS place FROM planted")
def planted_segments(spark, sf_dir):
    """Four clusters with 50 restarts, numbered by their centre."""
    model = SE.fit_kmeans(_planted(spark, sf_dir), 4)
    order = model.centres[:, 0].argsort().argsort()
    place = F.element_at(F.array(*[F.lit(int(x)) for x in order]), F.col("prediction") + 1)
    return model.transform(_planted(spark, sf_dir)).select("client_id", place.alias("place"))


@query("planted_stability", "WITH " + _PLANTED + f""", s AS (SELECT count(DISTINCT {_PLANTED_4}) / 4.0 AS one FROM planted)
SELECT CAST(one AS DOUBLE) AS mean_ari, CAST(one - 1 AS DOUBLE) AS std_ari, CAST(one AS DOUBLE) AS min_ari, CAST(100 AS INTEGER) AS n_runs FROM s""")
def planted_stability(spark, sf_dir):
    """100 subsamples with 10 restarts find the same four groups."""
    rows = _planted(spark, sf_dir)
    base = SE.fit_kmeans(rows, 4).setPredictionCol("base").transform(rows)
    return rounded(VA.stability(VA.stability_runs(base, ["x_0", "x_1"], 4, "base")), 9)


@query("planted_ward", "WITH " + _PLANTED + f"""
SELECT {_PLANTED_4} AS place, count(*) AS n, CAST(1 AS BIGINT) AS labels FROM planted GROUP BY 1""")
def planted_ward(spark, sf_dir):
    """Ward over 200 micro-clusters joins the same groups: their sizes, and how many labels each has."""
    g = F.col("c_nationkey") % 10
    known = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id"), F.greatest(g - 6, F.lit(0)).cast("int").alias("place"))
    tree = VA.fit_hierarchical(_planted(spark, sf_dir), ["x_0", "x_1"], 4)
    return tree.labels.join(known, "client_id").groupBy("place").agg(
        F.count("*").alias("n"), F.count_distinct("hierarchical_cluster").alias("labels"))


@query("subsample_sizes", "WITH " + FEATURES + """
SELECT CAST(floor(0.8 * count(*)) AS BIGINT) AS drawn, count(*) AS clients FROM features""")
def subsample_sizes(spark, sf_dir):
    """A subsample without replacement has exactly the size asked for."""
    rows = V.register(spark, sf_dir)
    part = VA.subsample(rows, "client_id", 0.8, run=1)
    everyone = one_row(rows.agg(F.count("*").alias("n")))["n"]
    return part.agg(F.count_distinct("client_id").alias("drawn")).withColumn("clients", everyone)


@query("principal_components", "WITH RECURSIVE " + CLUSTERED + "," + _scaled(WIDE, "standard", "clustered") + f""",
pts AS (SELECT client_id AS id, {_POINT} AS v FROM scaled),
{components_sql(len(WIDE))}
SELECT id AS client_id, {rnd("pc1 pc2", 6)} FROM scores""")
def principal_components(spark, sf_dir):
    m = _staged_matrix(spark, sf_dir)
    return rounded(VA.pca_projection(m.df).df.select("client_id", "pc1", "pc2"), 6)


@query("segment_centres", "WITH RECURSIVE " + CLUSTERED + "," + _scaled(WIDE, "standard", "clustered") + f""",
pts AS (SELECT client_id AS id, {_POINT} AS v FROM scaled),
{components_sql(len(WIDE))}
SELECT cluster, round(avg(pc1), 6) + 0.0 AS pc1, round(avg(pc2), 6) + 0.0 AS pc2, count(*) AS n
FROM scores JOIN clustered ON id = client_id GROUP BY 1""")
def segment_centres(spark, sf_dir):
    """Centres of the investment quartiles on the first two components."""
    m = _staged_matrix(spark, sf_dir)
    return rounded(VA.segment_centres(VA.pca_projection(m.df).df, "cluster"), 6)


@query("embedding_components", f"""WITH RECURSIVE pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
{components_sql(64)}
SELECT id AS vec_id, label, {rnd("pc1 pc2", 5)} FROM scores JOIN embeddings ON id = vec_id""")
def embedding_components(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    rows = V.table(spark, sf_dir, "embeddings").withColumn(
        "features", array_to_vector(F.col("embedding").cast("array<double>")))
    return rounded(VA.pca_projection(rows).df.select("vec_id", "label", "pc1", "pc2"), 5)
