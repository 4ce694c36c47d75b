"""Matrices with any number of one-hot columns: sparse rows, their moments, measures and K-Means.

A row holds its scaled numbers and the places of its levels, never a column per level. The
dictionary of levels is a table that is joined, and so are centres and means over the one-hot
part: neither the driver nor a broadcast has to hold a number per level. An attribute of few levels
is sent to all tasks; one of many is joined by sorting, whatever the size of its packed
files, and Spark splits a level there that many rows share.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.config import SEED, FeatureSet
from cohortry.operators import sparse_blocks as SB
from cohortry.operators.matrix import scaling_terms
from cohortry.operators.scalars import one_row
from cohortry.session import stage_table

#: Index of the entry that counts a row itself.
_ROW = -1
#: Most bytes that the part of one attribute may take where it is sent to all tasks.
_SENT_BYTES = 4 << 20


@dataclass(frozen=True)
class SparseMatrix:
    """``df`` keeps all its columns and gains ``features``: ``indices`` and ``values`` of a row.

    Indices 0..p-1 are the scaled numbers, all there; the one-hot columns follow, only ones are there.
    ``levels`` is the dictionary ``(feature, level, place)``; ``spans`` has the first place of each attribute
    and how many it has, and is looked up where it is not given.
    """

    df: DataFrame
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    levels: DataFrame
    spans: tuple[tuple[int, int], ...] | None = None


@dataclass(frozen=True)
class Centres:
    """``q`` points: the scaled numbers as an array, the one-hot part as a table ``(place, m)`` of ``q`` numbers each.

    A place that is not in the table is 0 in all points. ``places`` is the number of its rows where that is known.
    """

    dense: np.ndarray  # q x p
    hot: DataFrame
    places: int | None = None


# --- levels and rows --------------------------------------------------------------
def level_places(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, level, place)``: the one-hot columns of several attributes, numbered in order of attribute and level.

    Of two levels the first has no place (NULL); unknown values are no level. The distinct levels are
    dealt by ranges and numbered range by range, so only one count per range and attribute is held together.
    """
    pairs = [F.struct(F.lit(i).alias("fi"), F.col(c).cast("string").alias("level")) for i, c in enumerate(columns)]
    distinct = df.select(F.inline(F.array(*pairs))).filter("level is not null").distinct()
    ranged = stage_table(
        distinct.repartitionByRange("fi", "level").withColumn("_range", F.spark_partition_id()), "level_places")
    counts = ranged.groupBy("_range", "fi").agg(F.count("*").alias("n")).agg(
        F.collect_list(F.struct("_range", "fi", "n"))).scalar()

    def total(which) -> Column:
        return F.aggregate(F.filter("_counts", which), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])

    def levels_of(i: int) -> Column:
        return total(lambda x: x["fi"] == i)

    widths = F.array(*[F.when(levels_of(i) == 2, F.lit(1).cast("bigint")).otherwise(levels_of(i))
                       for i in range(len(columns))])
    two = total(lambda x: x["fi"] == F.col("fi")) == 2
    before = total(lambda x: (x["fi"] == F.col("fi")) & (x["_range"] < F.col("_range")))
    here = F.row_number().over(Window.partitionBy("_range", "fi").orderBy("level"))
    ranked = ranged.withColumn("_counts", counts).withColumn("_here", here).select(
        "fi", "level", (before + F.col("_here") - 1).alias("rank"), two.alias("two"),
        F.aggregate(F.slice(widths, 1, F.col("fi")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("offset"))
    place = F.col("offset") + F.col("rank") - F.col("two").cast("int")
    names = F.array(*[F.lit(c) for c in columns])
    return ranked.select(
        F.get(names, F.col("fi")).alias("feature"), "level",
        F.when(~(F.col("two") & (F.col("rank") == 0)), place).cast("int").alias("place"))


def _spans(levels: DataFrame, columns: Sequence[str]) -> tuple[tuple[int, int], ...]:
    """First place and number of places of each attribute."""
    ends = {r["feature"]: r for r in levels.groupBy("feature").agg(
        F.min("place").alias("lo"), F.count("place").alias("n")).collect()}  # a row per attribute
    return tuple((ends[c]["lo"], ends[c]["n"]) if c in ends and ends[c]["n"] else (0, 0) for c in columns)


def _sized(table: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A side of a join by what it takes unpacked; Spark goes by the size of packed files."""
    return F.broadcast(table) if rows * row_bytes <= _SENT_BYTES else table.hint("merge")


def sparse_matrix(df: DataFrame, fs: FeatureSet, scaler: str = "standard") -> SparseMatrix:
    """Scaled numbers and one-hot entries of each row; scaled numbers must not be NULL, levels may be."""
    terms = scaling_terms(df, fs, scaler) if fs.numeric else []
    if not fs.categorical:
        levels = df.sparkSession.createDataFrame([], "feature string, level string, place int")
    else:
        levels = stage_table(level_places(df, fs.categorical), "levels")
    spans = _spans(levels, fs.categorical) if fs.categorical else ()
    out = df
    for i, c in enumerate(fs.categorical):
        own = levels.filter(F.col("feature") == c).select(F.col("level").alias("_level"), F.col("place").alias(f"_place_{i}"))
        out = out.join(_sized(own, spans[i][1], 256), F.col(c).cast("string") == F.col("_level"), "left").drop("_level")
    p = len(terms)
    hot = [f"_place_{i}" for i in range(len(fs.categorical))]
    places = F.array_compact(F.array(*[F.col(h) + p for h in hot])) if hot else F.array().cast("array<int>")
    scaled = F.expr("array(" + ", ".join(f"CAST({sql} AS DOUBLE)" for _, sql in terms) + ")" if terms else "CAST(array() AS array<double>)")
    indices = F.concat(F.array(*[F.lit(i) for i in range(p)]).cast("array<int>"), places)
    values = F.concat(scaled, F.transform(places, lambda x: F.lit(1.0)))
    out = out.withColumn("features", F.struct(indices.alias("indices"), values.alias("values"))).drop(*hot)
    return SparseMatrix(out, tuple(n for n, _ in terms), tuple(fs.categorical), levels, spans)


def column_names(matrix: SparseMatrix) -> DataFrame:
    """``(index, name)`` of all columns of the matrix, as a table."""
    p = len(matrix.numeric)
    hot = matrix.levels.filter("place is not null").select(
        (F.col("place") + p).alias("index"), F.concat_ws("_", "feature", "level").alias("name"))
    if not p:
        return hot
    numbers = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(n).alias("name")) for i, n in enumerate(matrix.numeric)])
    return matrix.df.sparkSession.range(1).select(F.inline(numbers)).unionByName(hot)


def entries(matrix: SparseMatrix, *keys: str) -> DataFrame:
    """The entries that are there: ``(keys.., index, value)``."""
    pairs = F.arrays_zip(F.col("features.indices").alias("index"), F.col("features.values").alias("value"))
    return matrix.df.select(*keys, F.inline(pairs))


def moments(matrix: SparseMatrix) -> DataFrame:
    """``(index, total, squares, mean, variance)`` of every column, entries that are not there counting as 0."""
    rows = one_row(matrix.df.agg(F.count("*").alias("n")))["n"]
    sums = entries(matrix).groupBy("index").agg(
        F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"))
    mean = F.col("total") / F.col("n")
    return sums.withColumn("n", rows).select(
        "index", "total", "squares", mean.alias("mean"),
        F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)).alias("variance"))


# --- distances ----------------------------------------------------------------------
def _doubles(values: np.ndarray) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")" if len(values) else "CAST(array() AS array<double>)"


def with_distances(matrix: SparseMatrix, points: Centres, name: str = "gaps") -> DataFrame:
    """``matrix.df`` with the squared distances to all points, as one array.

    Over the one-hot part the squared distance is the points' squared length there, and ``1 - 2 m`` for each
    place of the row; those numbers come by one join per attribute, with the points at its places only.
    """
    q, p = len(points.dense), len(matrix.numeric)
    square = points.hot.agg(*[F.sum(F.col("m")[i] * F.col("m")[i]) for i in range(q)]).first()
    length = np.array([x or 0.0 for x in square], float)  # one number per point
    gaps = F.expr(
        "zip_with(array(" + ", ".join(_doubles(c) for c in points.dense) + "), " + _doubles(length)
        + f", (c, l) -> l + aggregate(zip_with(slice(features.values, 1, {p}), c, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x))")
    out = matrix.df.withColumn("_dense", gaps)
    hot = []
    spans = _spans(matrix.levels, matrix.categorical) if matrix.spans is None else matrix.spans
    for j, (lo, n) in enumerate(spans):
        if not n:
            continue
        table = points.hot.filter(F.col("place").between(lo, lo + n - 1)).select(
            F.col("place").alias("_p"), F.col("m").alias(f"_m_{j}"))
        own = F.get(F.filter("features.indices", lambda x: x.between(p + lo, p + lo + n - 1)), F.lit(0))
        most = n if points.places is None else min(n, points.places)
        out = out.join(_sized(table, most, 8 * q + 64), own == F.col("_p") + p, "left").drop("_p")
        hot.append(f"_m_{j}")
    ones = (F.size("features.indices") - p).cast("double")
    total = F.transform(F.col("_dense"), lambda x: x + ones)
    for m in hot:
        total = F.zip_with(total, F.coalesce(m, F.array_repeat(F.lit(0.0), q)), lambda a, b: a - 2 * b)
    return out.withColumn(name, F.transform(total, lambda x: F.greatest(x, F.lit(0.0)))).drop("_dense", *hot)


def _nearest(gaps: Column, model: int, k: int) -> Column:
    """Label 0..k-1 of the nearest of a model's points; of equally near ones the first."""
    own = F.slice(gaps, model * k + 1, k)
    return (F.array_position(own, F.array_min(own)) - 1).cast("int")


# --- sums by label, and points from them ---------------------------------------------
def _label_sums(rows: DataFrame, labels: str) -> DataFrame:
    """``(label, index, total)`` from ``features`` and an array of ``(label, cost)``; ``_ROW`` counts rows, ``_ROW - 1`` adds costs."""
    cells = F.flatten(F.array(
        F.array(F.struct(F.lit(_ROW).alias("index"), F.lit(1.0).alias("value")),
                F.struct(F.lit(_ROW - 1).alias("index"), F.col("_mark.cost").alias("value"))),
        F.arrays_zip(F.col("features.indices").alias("index"), F.col("features.values").alias("value"))))
    return (rows.select("features", F.explode(labels).alias("_mark"))
            .select(F.col("_mark.label").alias("label"), F.inline(cells))
            .groupBy("label", "index").agg(F.sum("value").alias("total")))


@dataclass(frozen=True)
class _Sums:
    """Sums of ``q`` labels: rows, costs and scaled numbers here; the one-hot part as a table ``(place, t)``."""

    n: np.ndarray
    cost: np.ndarray
    dense: np.ndarray
    hot: DataFrame


def _sums(rows: DataFrame, labels: str, q: int, p: int) -> _Sums:
    table = stage_table(_label_sums(rows, labels), "label_sums")
    few = np.zeros((q, p + 2))
    for r in table.filter(F.col("index") < p).collect():  # q x (numbers + 2)
        few[r["label"], r["index"] + 2] = r["total"]
    by_place = table.filter(F.col("index") >= p).groupBy((F.col("index") - p).alias("place")).agg(
        F.map_from_entries(F.collect_list(F.struct("label", "total"))).alias("t"))
    hot = by_place.select("place", F.transform(
        F.sequence(F.lit(0), F.lit(q - 1)), lambda i: F.coalesce(F.try_element_at("t", i), F.lit(0.0))).alias("t"))
    return _Sums(few[:, 1], few[:, 0], few[:, 2:], hot)


def _means(sums: _Sums) -> Centres:
    n = np.maximum(sums.n, 1)
    return Centres(sums.dense / n[:, None],
                   sums.hot.select("place", F.zip_with("t", F.expr(_doubles(n)), lambda t, c: t / c).alias("m")))


# --- measures -------------------------------------------------------------------------
def measures(matrix: SparseMatrix, label: str, k: int) -> DataFrame:
    """One row for labels 0..k-1: ``rows, labels, inertia, silhouette, calinski_harabasz, davies_bouldin``.

    Two passes over the rows. The silhouette is that on squared distances. Labels without rows are left out;
    rows without a label, or with another one, are not measured.
    """
    p = len(matrix.numeric)
    df = matrix.df.filter(F.col(label).between(0, k - 1))
    known = replace(matrix, df=df)
    marked = df.withColumn("_label", F.array(F.struct(F.col(label).cast("int").alias("label"), F.lit(0.0).alias("cost"))))
    sums = _sums(marked, "_label", k, p)
    n, there = sums.n, np.flatnonzero(sums.n)
    schema = "rows bigint, labels int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double"
    if not len(there):
        return df.sparkSession.createDataFrame([(0, 0, None, None, None, None)], schema)
    mean = _means(sums)
    mean = Centres(mean.dense, stage_table(mean.hot, "label_means"))
    # Squared distances between the means: k x k numbers, of which the one-hot part is summed over the table.
    apart = ((mean.dense[:, None] - mean.dense[None]) ** 2).sum(axis=2)
    pairs = [(a, b) for i, a in enumerate(there) for b in there[i + 1:]]
    weights = F.expr(_doubles(n / n.sum()))
    grand = F.aggregate(F.zip_with("m", weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    spread = F.aggregate(F.zip_with("m", F.expr(_doubles(n)), lambda x, c: c * (x - F.col("g")) * (x - F.col("g"))),
                         F.lit(0.0), lambda s, x: s + x)
    hot = mean.hot.withColumn("g", grand).agg(
        F.coalesce(F.sum(spread), F.lit(0.0)),
        *[F.coalesce(F.sum((F.col("m")[int(a)] - F.col("m")[int(b)]) ** 2), F.lit(0.0)) for a, b in pairs]).first()
    centre = (mean.dense * n[:, None]).sum(axis=0) / n.sum()
    between = float((n[:, None] * (mean.dense - centre) ** 2).sum()) + hot[0]
    for (a, b), x in zip(pairs, hot[1:]):
        apart[a, b] = apart[b, a] = apart[a, b] + x
    # A row's own distance and, with the spread inside each label, its silhouette.
    own = F.get("gaps", F.col(label).cast("int"))
    near = stage_table(with_distances(known, mean).select(F.col(label).cast("int").alias("label"), "gaps", own.alias("own")), "label_gaps")
    inside = np.zeros((k, 2))
    for r in near.groupBy("label").agg(F.sum("own").alias("w"), F.sum(F.sqrt("own")).alias("s")).collect():  # k rows
        inside[r["label"]] = r["w"], r["s"]
    within = inside[:, 0] / np.maximum(n, 1)
    far = [F.col("gaps")[i] + float(within[i]) for i in range(k)]
    size = F.get(F.expr(_doubles(n)), F.col("label"))
    a = F.get(F.array(*far), F.col("label"))
    a = F.try_divide(a * size, size - 1)
    b = F.array_min(F.array(*[F.when(F.col("label") != int(i), far[i]) for i in there]))
    score = F.when((size > 1) & b.isNotNull() & (F.greatest("a", b) > 0), (b - F.col("a")) / F.greatest("a", b)).otherwise(0.0)
    silhouette = near.withColumn("a", F.when(size > 1, a)).agg(F.avg(score)).first()[0]
    rows, inertia = float(n.sum()), float(inside[:, 0].sum())
    width = (inside[:, 1] / np.maximum(n, 1))[there]
    gap = np.sqrt(apart[np.ix_(there, there)])
    worst = np.divide(width[:, None] + width[None], gap, out=np.zeros_like(gap), where=gap > 0)
    np.fill_diagonal(worst, -np.inf)
    upper = between / (len(there) - 1) if len(there) > 1 else None
    lower = inertia / (rows - len(there)) if rows > len(there) else None
    return df.sparkSession.createDataFrame([(
        int(rows), len(there), inertia, silhouette, upper / lower if upper is not None and lower else None,
        float(worst.max(axis=1).mean()) if len(there) > 1 else None)], schema)


# --- K-Means --------------------------------------------------------------------------
@dataclass(frozen=True)
class SparseClustering:
    """The cheapest model: its centres, its cost, and the cost of every restart."""

    centres: Centres
    cost: float
    costs: tuple[float, ...]

    def transform(self, matrix: SparseMatrix, name: str = "cluster") -> DataFrame:
        """``matrix.df`` with the label of the nearest centre."""
        rows = with_distances(matrix, self.centres, "_gaps")
        return rows.withColumn(name, _nearest(F.col("_gaps"), 0, len(self.centres.dense))).drop("_gaps")


def _points(matrix: SparseMatrix, rows: Sequence) -> Centres:
    """Some rows of the matrix (their ``features``) as points."""
    p = len(matrix.numeric)
    cells: dict[int, list[float]] = {}
    for i, r in enumerate(rows):
        for index in r["indices"][p:]:
            cells.setdefault(index - p, [0.0] * len(rows))[i] = 1.0
    hot = matrix.df.sparkSession.createDataFrame(sorted(cells.items()), "place int, m array<double>")
    return Centres(np.array([r["values"][:p] for r in rows], float).reshape(len(rows), p), hot, len(cells))


def _starts(matrix: SparseMatrix, k: int, n_init: int, seed: int) -> Centres:
    """k-means++ over all rows for ``n_init`` models side by side: the k rows of a model stand together."""
    chosen: list[list] = [[] for _ in range(n_init)]
    for step in range(k):
        if step:
            rows = with_distances(matrix, _points(matrix, [r for c in chosen for r in c]))
            weights = [F.array_min(F.slice("gaps", i * step + 1, step)) for i in range(n_init)]
        else:
            rows, weights = matrix.df, [F.lit(1.0)] * n_init
        drawn = []
        for i, w in enumerate(weights):
            # Equal rows share a hash, so a row is drawn for its weight times the number of its equals, all at once.
            u = (F.shiftrightunsigned(F.xxhash64("_equal.features", F.lit(seed), F.lit(step), F.lit(i)), 11) + 0.5) / float(1 << 53)
            drawn.append((F.log(F.greatest(F.get("_equal.w", F.lit(i)) * F.col("_n"), F.lit(1e-300))) - F.log(-F.log(u)), i))
        equal = rows.select("features", F.array(*weights).alias("w")).groupBy("features").agg(
            F.first("w").alias("w"), F.count("*").alias("_n")).select(F.struct("features", "w").alias("_equal"), "_n")
        best = equal.agg(*[F.max_by("_equal.features", key).alias(f"r{i}") for key, i in drawn]).first()
        for i in range(n_init):
            chosen[i].append(best[f"r{i}"])
    return _points(matrix, [r for c in chosen for r in c])


def _moved(old: Centres, new: Centres, q: int) -> np.ndarray:
    """How far each point moved."""
    zero = F.array_repeat(F.lit(0.0), q)
    both = old.hot.withColumnRenamed("m", "a").join(new.hot.withColumnRenamed("m", "b"), "place", "full")
    gap = F.zip_with(F.coalesce("a", zero), F.coalesce("b", zero), lambda x, y: (x - y) * (x - y))
    total = ((old.dense - new.dense) ** 2).sum(axis=1)
    for i, x in both.select(F.posexplode(gap).alias("i", "x")).groupBy("i").agg(F.sum("x")).collect():  # q rows
        total[i] += x
    return np.sqrt(total)


def fit_sparse_kmeans(matrix: SparseMatrix, k: int, n_init: int = 10, seed: int = SEED, max_iter: int = 100,
                      tol: float = 1e-4, starts: Centres | None = None) -> SparseClustering:
    """The cheapest of ``n_init`` K-Means models, all in the same passes, until no centre moves by more than ``tol``.

    ``matrix.df`` should be a staged table of at least one row. ``starts`` gives the first centres (``n_init`` times k);
    else k-means++ draws them. A label without rows gets the row that is farthest from its centre.

    Where at most one attribute has very many levels, and centres are drawn, the passes are those of ``sparse_blocks``;
    else centres are tables that are joined.
    """
    p, q = len(matrix.numeric), k * n_init
    spans = _spans(matrix.levels, matrix.categorical) if matrix.spans is None else matrix.spans
    plain, rare = SB.rare_attribute(spans, q)
    if starts is None and plain:
        packed = SB.pack(matrix.df.select("features"), p, spans, rare, q, seed)
        costs, dense, hot = SB.fit(packed, SB.draw_starts(packed, k, n_init), max_iter, tol)
        return SparseClustering(Centres(dense, hot), float(costs.min()), tuple(map(float, costs)))
    centres = starts or _starts(matrix, k, n_init, seed)
    costs = np.full(n_init, math.inf)
    for _ in range(max_iter):
        rows = with_distances(matrix, centres)
        marks = F.array(*[F.struct(
            (_nearest(F.col("gaps"), i, k) + i * k).alias("label"),
            F.array_min(F.slice("gaps", i * k + 1, k)).alias("cost")) for i in range(n_init)])
        marked = rows.select("features", marks.alias("_marks"))
        sums = _sums(marked, "_marks", q, p)
        new = _means(sums)
        costs = sums.cost.reshape(n_init, k).sum(axis=1)
        empty = [(i, int((sums.n[i * k:(i + 1) * k] == 0).argmax())) for i in range(n_init) if (sums.n[i * k:(i + 1) * k] == 0).any()]
        if empty:
            new = _refilled(matrix, marked, new, empty, k)
        new = Centres(new.dense, stage_table(new.hot, "sparse_centres"))
        step = _moved(centres, new, q).max()
        centres = new
        if step <= tol:
            break
    best = int((costs <= costs.min() * (1 + 1e-9)).argmax())
    own = centres.hot.select("place", F.slice("m", best * k + 1, k).alias("m")).filter(F.exists("m", lambda x: x != 0))
    return SparseClustering(Centres(centres.dense[best * k:(best + 1) * k], own), float(costs[best]), tuple(map(float, costs)))


def scan_sparse(matrix: SparseMatrix, ks: Sequence[int], n_init: int = 10, seed: int = SEED,
                max_iter: int = 100, tol: float = 1e-4) -> DataFrame:
    """One row per k, with the columns of ``selection.scan_k``. ``matrix.df`` should be a staged table.

    The restarts of one k share their passes; each k has its own, as its centres are a table.
    """
    out = []
    for k in ks:
        fit = fit_sparse_kmeans(matrix, k, n_init, seed, max_iter, tol)
        rows = stage_table(fit.transform(matrix, "_label").select("features", "_label"), "sparse_labels")
        labelled = replace(matrix, df=rows)
        m = measures(labelled, "_label", k).first()
        sizes = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}  # k rows
        smallest = min(sizes.get(i, 0) for i in range(k))
        out.append((k, m["inertia"], m["silhouette"], m["calinski_harabasz"], m["davies_bouldin"], smallest, smallest / m["rows"]))
    return matrix.df.sparkSession.createDataFrame(
        out, "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double, "
        "min_cluster_size bigint, min_cluster_pct double")


def _refilled(matrix: SparseMatrix, marked: DataFrame, new: Centres, empty: Sequence[tuple[int, int]], k: int) -> Centres:
    """The farthest row of a model as the centre of its first label without rows."""
    far = marked.agg(*[F.max_by("features", F.col("_marks")[i]["cost"]).alias(f"r{i}") for i, _ in empty]).first()
    points = _points(matrix, [far[f"r{i}"] for i, _ in empty])
    dense, q = new.dense.copy(), len(new.dense)
    at = {i * k + label: j for j, (i, label) in enumerate(empty)}
    for where, j in at.items():
        dense[where] = points.dense[j]
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    both = new.hot.join(points.hot.withColumnRenamed("m", "f"), "place", "full").select(
        "place", F.coalesce("m", zeros(q)).alias("m"), F.coalesce("f", zeros(len(empty))).alias("f"))
    return Centres(dense, both.select("place", F.array(*[
        F.col("f")[at[i]] if i in at else F.col("m")[i] for i in range(q)]).alias("m")))
