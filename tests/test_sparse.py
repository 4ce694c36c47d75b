"""Sparse one-hot matrices: against the dense ones, with very many levels, and on odd input."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.config import FeatureSet
from cohortry.operators import lloyd
from cohortry.operators import sparse as SP
from cohortry.operators.matrix import build_matrix, named_matrix
from cohortry.session import stage_table

FS = FeatureSet("t", ("x", "y"), ("g", "h", "c"))


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(11)
    n = 600
    pdf = pd.DataFrame({
        "client_id": np.arange(n), "x": rng.normal(size=n) * 4, "y": rng.integers(0, 9, n).astype(float),
        "g": rng.choice(["F", "M"], n), "h": rng.choice(["it's", "b", "Ä", "a b"], n), "c": rng.choice(list("pqrstuv"), n)})
    pdf.loc[pdf.index % 7 == 0, "h"] = None
    pdf.loc[pdf.index % 3 == 0, "c"] = "hot"
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                               "client_id int, x double, y double, g string, h string, c string")
    return stage_table(df.repartition(5), "people")


def wide(matrix):
    """The sparse rows as an array in order of client_id."""
    names = {r["index"]: r["name"] for r in SP.column_names(matrix).collect()}
    rows = matrix.df.select("client_id", "features.*").orderBy("client_id").collect()
    out = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        out[i, r["indices"]] = r["values"]
    return out, [names[i] for i in range(len(names))]


@pytest.mark.parametrize("scaler", ["standard", "minmax"])
def test_sparse_rows_are_the_dense_ones(people, scaler):
    got, names = wide(SP.sparse_matrix(people, FS, scaler))
    dense = build_matrix(people, FS, scaler)
    assert names == dense.names
    want = named_matrix(dense).orderBy("client_id").toPandas()[dense.names].to_numpy()
    assert np.allclose(got, want, atol=1e-12)


def test_moments(people):
    matrix = SP.sparse_matrix(people, FS)
    x, _ = wide(matrix)
    rows = SP.moments(matrix).orderBy("index").toPandas()
    assert np.allclose(rows["mean"], x.mean(0)) and np.allclose(rows["variance"], x.var(0))


def test_distances(people):
    matrix = SP.sparse_matrix(people, FS)
    x, _ = wide(matrix)
    points = SP._points(matrix, [r[0] for r in matrix.df.filter("client_id in (3, 7, 9)").orderBy("client_id").select("features").collect()])
    got = np.array([r[0] for r in SP.with_distances(matrix, points).orderBy("client_id").select("gaps").collect()])
    assert np.allclose(got, ((x[:, None] - x[[3, 7, 9]][None]) ** 2).sum(2))


def test_measures_are_the_dense_ones(people):
    matrix = SP.sparse_matrix(people.withColumn("label", (F.col("client_id") % 4 + F.when(F.col("x") > 2, 1).otherwise(0)).cast("int")), FS)
    got = SP.measures(matrix, "label", 6).first()
    dense = build_matrix(matrix.df.drop("features"), FS)
    blocks = lloyd.pack(dense.df, [*dense.columns, "label"])
    want = lloyd.measure(blocks, [lloyd.Labeling(blocks.at(dense.columns), 6, label=int(blocks.at(["label"])[0]))])[0]
    assert (got["rows"], got["labels"]) == (600, 5)
    for name in ("inertia", "silhouette", "calinski_harabasz", "davies_bouldin"):
        assert got[name] == pytest.approx(want[name], rel=1e-9), name


def test_labels_of_one_row_and_none(spark):
    df = spark.createDataFrame([(1, 0.0, "a", 0), (2, 1.0, "b", 1), (3, 5.0, "c", None)], "client_id int, x double, g string, label int")
    matrix = SP.sparse_matrix(df, FeatureSet("t", ("x",), ("g",)))
    assert tuple(SP.measures(matrix, "label", 3).first())[:4] == (2, 2, 0.0, 0.0)
    none = SP.SparseMatrix(matrix.df.filter("false"), matrix.numeric, matrix.categorical, matrix.levels)
    assert SP.measures(none, "label", 3).first()["rows"] == 0


def test_the_same_models_as_dense_lloyd(people):
    matrix = SP.sparse_matrix(people, FS)
    matrix = SP.SparseMatrix(stage_table(matrix.df, "sparse_rows"), matrix.numeric, matrix.categorical, matrix.levels)
    x, _ = wide(matrix)
    first = matrix.df.filter("client_id in (1, 2, 5, 8, 13, 21)").orderBy("client_id").select("features").collect()
    got = SP.fit_sparse_kmeans(matrix, 3, n_init=2, starts=SP._points(matrix, [r[0] for r in first]))
    dense = build_matrix(people, FS)
    blocks = lloyd.pack(dense.df, dense.columns)
    start = lloyd.Group(blocks.at(dense.columns), x[[1, 2, 5, 8, 13, 21]].reshape(2, 3, -1), np.array([-1, -1]))
    want = lloyd.improve(blocks, [start])[0]
    assert got.costs == pytest.approx(want.cost, rel=1e-6)
    labels = [r[0] for r in got.transform(matrix).orderBy("client_id").select("cluster").collect()]
    assert labels == list(((x[:, None] - want.best[None]) ** 2).sum(2).argmin(1))


def test_drawn_starts_find_planted_groups(spark):
    df = spark.range(900).selectExpr("cast(id as int) client_id", "double(id % 3) * 10 + (id % 5) / 100 x", "concat('level ', id % 3, '_', id % 30) c")
    matrix = SP.sparse_matrix(stage_table(df, "planted"), FeatureSet("t", ("x",), ("c",)))
    fit = SP.fit_sparse_kmeans(matrix, 3, n_init=4)
    rows = fit.transform(matrix).groupBy("cluster").agg(F.collect_set(F.col("client_id") % 3).alias("s"), F.count("*").alias("n")).collect()
    assert len(rows) == 3 and all(len(r["s"]) == 1 and r["n"] == 300 for r in rows)


def test_scan_has_the_measures_of_the_dense_scan(spark):
    from cohortry.operators.selection import scan_k

    df = stage_table(spark.range(240).selectExpr(
        "cast(id as int) client_id", "double(id % 3) * 10 + (id % 5) / 100 x", "concat('c', id % 3) c", "concat('d', id % 2) d"), "scan")
    fs = FeatureSet("t", ("x",), ("c", "d"))
    matrix = SP.sparse_matrix(df, fs)
    got = {r["k"]: r for r in SP.scan_sparse(matrix, (2, 3, 6), n_init=3).collect()}
    want = {r["k"]: r for r in scan_k(build_matrix(df, fs), (2, 3, 6), n_init=10).collect()}
    assert got.keys() == want.keys() and got[6].asDict().keys() == want[6].asDict().keys()
    for name, value in want[6].asDict().items():  # the groups are plain there
        assert got[6][name] == pytest.approx(value, rel=1e-6), name
    assert got[3]["inertia"] == pytest.approx(want[3]["inertia"], rel=1e-6)


def test_more_clusters_than_different_rows(spark):
    df = spark.createDataFrame([(i, 0.0 if i < 9 else 4.0, "a" if i < 9 else "b") for i in range(10)], "client_id int, x double, c string")
    matrix = SP.sparse_matrix(df, FeatureSet("t", ("x",), ("c",)))
    fit = SP.fit_sparse_kmeans(matrix, 3, n_init=2)
    assert fit.cost == pytest.approx(0.0, abs=1e-12)
    assert fit.transform(matrix).count() == 10


def test_twenty_thousand_levels(spark):
    n = 20_000
    df = spark.range(60_000).select(
        F.col("id").cast("int").alias("client_id"), (F.col("id") % 2 * 10).cast("double").alias("x"),
        F.when(F.col("id") % 3 == 0, F.lit("level 000000")).otherwise(
            F.concat(F.lit("level "), F.lpad((F.col("id") % n).cast("string"), 6, "0"))).alias("c"))
    matrix = SP.sparse_matrix(stage_table(df, "many"), FeatureSet("t", ("x",), ("c",)), "minmax")
    levels = matrix.levels.orderBy("place").collect()
    assert [r["place"] for r in levels] == list(range(n)) and [r["level"] for r in levels] == sorted(r["level"] for r in levels)
    text = matrix.df._jdf.queryExecution().executedPlan().toString()
    assert len(text) < 20_000 and len(matrix.df.columns) == 4  # no column per level
    assert SP.entries(matrix).count() == 120_000
    matrix = SP.SparseMatrix(stage_table(matrix.df.withColumn("label", (F.col("x") / 10).cast("int")), "many_rows"),
                             matrix.numeric, matrix.categorical, matrix.levels)
    got = SP.measures(matrix, "label", 2).first()
    # Within a label the numbers are equal, so its inertia is rows less the squared counts of levels over the rows.
    pdf = df.select((F.col("client_id") % 2).alias("l"), "c").toPandas()
    want = sum(len(g) - (g["c"].value_counts() ** 2).sum() / len(g) for _, g in pdf.groupby("l"))
    assert got["inertia"] == pytest.approx(want, rel=1e-9)


def test_nothing_known(spark):
    schema = "client_id int, x double, c string, d string"
    df = spark.createDataFrame([(1, 1.0, None, "k"), (2, 2.0, None, "k")], schema)
    matrix = SP.sparse_matrix(df, FeatureSet("t", ("x",), ("c", "d")))
    assert [tuple(r) for r in matrix.levels.collect()] == [("d", "k", 0)]
    assert [r[0] for r in matrix.df.orderBy("client_id").select("features.indices").collect()] == [[0, 1], [0, 1]]
    alone = SP.sparse_matrix(df, FeatureSet("t", (), ("d",)))
    assert [r[0] for r in alone.df.select("features.values").collect()] == [[1.0], [1.0]]
    plain = SP.sparse_matrix(df, FeatureSet("t", ("x",)))
    assert plain.levels.count() == 0 and plain.df.select("features.indices").first()[0] == [0]


def test_points_over_many_levels_are_not_sent_to_all_tasks(spark):
    """The numbers of 60,000 levels are mostly zeros, so small in files, but not in memory."""
    rows = spark.range(60_000).select(
        F.col("id").alias("client_id"), (F.col("id") % 11).cast("double").alias("x"),
        F.concat(F.lit("z"), F.col("id") % 5).alias("zone"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    matrix = SP.sparse_matrix(stage_table(rows, "rows"), FeatureSet("", ("x",), ("zone", "name")), "minmax")
    assert matrix.spans == ((0, 5), (5, 60_000))
    assert plan(matrix.df).count("BroadcastHashJoin") == 1
    q = 20
    hot = matrix.levels.select("place", F.transform(F.sequence(F.lit(0), F.lit(q - 1)), lambda i: F.when(
        i == F.col("place") % q, 1.0).otherwise(0.0)).alias("m"))
    points = SP.Centres(np.zeros((q, 1)), stage_table(hot, "hot"))
    near = SP.with_distances(matrix, points)
    assert plan(near).count("SortMergeJoin") == 2 and plan(near).count("BroadcastHashJoin") == 2
    # The 3000 levels of a point's length, the row's own two ones, less twice where the point holds the row's levels.
    first = near.filter("client_id = 0").first()
    places = first["features"]["indices"]
    length = 3000 + (np.arange(q) < 5)
    want = length + 2.0 - 2 * sum(np.arange(q) == (i - 1) % q for i in places[1:])
    assert first["gaps"] == pytest.approx(list(want))


def test_block_passes_are_plain_lloyd(spark, monkeypatch):
    """Rows of rare levels, of one that many rows share, and of none, against plain steps over the wide matrix."""
    from cohortry.operators import sparse_blocks as SB

    n, k, models = 12_000, 3, 2
    df = stage_table(spark.range(n).select(
        F.col("id").cast("int").alias("client_id"), (F.hash("id") / 1e9 + F.col("id") % 3 * 3).alias("x"),
        F.concat(F.lit("g"), F.col("id") % 4).alias("g"),
        F.when(F.col("id") % 2 == 0, F.lit("shared")).when(F.col("id") % 9 > 0, F.concat(F.lit("level "), F.hash("id", F.lit(1)) % 150)).alias("c")), "rows")
    matrix = SP.sparse_matrix(df, FeatureSet("t", ("x",), ("g", "c")))
    x, _ = wide(matrix)
    monkeypatch.setattr(SB, "COMMON_BYTES", 8 * k * models * 20)
    plain, rare = SB.rare_attribute(matrix.spans, k * models)
    assert plain and rare == 1 and matrix.spans[1][1] > 100
    packed = SB.pack(matrix.df.select("features"), 1, matrix.spans, rare, k * models, 1)
    layout = packed.layout
    assert len(layout.shared) == 1
    rows = np.concatenate([np.frombuffer(r["x"], "<f8").reshape(-1, layout.width) for r in packed.df.collect()])
    assert rows[:, 0].sum() == n and (rows[:, -1] >= 0).sum() > 4000

    def broad(row):
        out = np.zeros(x.shape[1])
        out[0] = row[1]
        levels = [int(i) for i in layout.levels(row[None])[0] if i < layout.common]
        out[[layout.places()[i] + 1 for i in levels] + ([int(row[-1]) + 1] if row[-1] >= 0 else [])] = 1
        return out

    picked = rows[[5, 5, 6000, 11, 8000, 9000]]  # of two equal centres the second is left without rows
    centres = np.array([broad(r) for r in picked]).reshape(models, k, -1)
    for step in (1, 2, 40):
        costs, dense, hot = SB.fit(packed, picked.reshape(models, k, -1), step, 1e-9)
        want = []
        for c in centres:
            for _ in range(step):
                gap = np.stack([((x - a) ** 2).sum(1) for a in c], axis=1)
                label, cost = gap.argmin(1), gap.min(1).sum()
                new = np.array([x[label == j].mean(0) if (label == j).any() else x[gap.min(1).argmax()] for j in range(k)])
                if np.abs(new - c).max() < 1e-12:
                    break
                c = new
            want.append((cost, c))
        assert costs == pytest.approx([w[0] for w in want], rel=1e-9)
        best = want[int(np.argmin([w[0] for w in want]))][1]
        got = np.zeros(best.shape)
        got[:, 0] = dense[:, 0]
        for r in hot.collect():
            got[:, r["place"] + 1] = r["m"]
        assert got == pytest.approx(best, abs=1e-9)


def test_blocks_draw_the_rows_that_joins_draw(people, monkeypatch):
    from cohortry.operators import sparse_blocks as SB

    matrix = SP.sparse_matrix(people.unionByName(people.filter("client_id < 50")), FS)
    matrix = SP.SparseMatrix(stage_table(matrix.df, "drawn"), matrix.numeric, matrix.categorical, matrix.levels, matrix.spans)
    want = SP._starts(matrix, 3, 4, 7)
    for common in (SB.COMMON_BYTES, 8 * 12 * 8):
        monkeypatch.setattr(SB, "COMMON_BYTES", common)
        plain, rare = SB.rare_attribute(matrix.spans, 12)
        assert plain and (rare is None) == (common > 1000)
        got = SB.draw_starts(SB.pack(matrix.df.select("features"), 2, matrix.spans, rare, 12, 7), 3, 4)
        assert got[:, :, 1:3].reshape(12, 2) == pytest.approx(want.dense)


def test_a_pass_over_many_levels_moves_no_number_per_level(spark, monkeypatch):
    """With a level per row and 20 centres, no pass joins or stages a table of centres."""
    from cohortry.operators import sparse_blocks as SB

    rows = spark.range(30_000).select(
        F.col("id").alias("client_id"), (F.col("id") % 11).cast("double").alias("x"),
        *[F.concat(F.lit(z), F.col("id") % 4).alias(z) for z in ("zone", "branch")], F.concat(F.lit("n"), F.col("id")).alias("name"))
    matrix = SP.sparse_matrix(stage_table(rows, "rows"), FeatureSet("", ("x",), ("zone", "branch", "name")), "minmax")
    for name in ("with_distances", "_sums", "_starts"):
        monkeypatch.setattr(SP, name, None)
    monkeypatch.setattr(SB, "COMMON_BYTES", 1 << 18)
    fit = SP.fit_sparse_kmeans(matrix, 4, n_init=5)
    monkeypatch.undo()
    found = fit.transform(matrix).groupBy("cluster").agg(F.collect_set("zone").alias("z"), F.count("*").alias("n")).collect()
    assert len(found) == 4 and all(len(r["z"]) == 1 and r["n"] == 7500 for r in found)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
