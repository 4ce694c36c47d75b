"""K-Means of many models in the same scans.

All models of a search (matrices, values of K, restarts, subsamples) stand side by side.
The rows travel to numpy once per pass, packed in blocks; every pass assigns each row for
all models that still move and returns one small sum per model and label. The number of
passes is that of the slowest model, whatever the number of models.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.config import SEED
from cohortry.session import stage_table

_BLOCK_ROWS = 4096
_CELLS = 1 << 22
#: A tile's distances: few enough for a core's cache.
_TILE_ROWS, _TILE_CELLS = 1024, 1 << 17
_FAN_IN = 32
#: Subsamples in one number: bits that a double holds exactly.
RUNS_PER_COLUMN = 50


# --- blocks ---------------------------------------------------------------------
@dataclass(frozen=True)
class Blocks:
    """Rows packed as matrices of doubles, ``columns`` wide; persisted until ``release``."""

    df: DataFrame
    columns: tuple[str, ...]
    rows: int
    parts: int

    def at(self, names: Sequence[str]) -> np.ndarray:
        place = {c: i for i, c in enumerate(self.columns)}
        return np.array([place[c] for c in names], np.int64)

    def release(self) -> None:
        self.df.unpersist()


def _pack(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, width)
            cuts = range(0, len(x), _BLOCK_ROWS)
            yield pa.record_batch([pa.array([x[a:a + _BLOCK_ROWS].tobytes() for a in cuts], pa.binary())], names=["x"])
    return run


def pack(df: DataFrame, columns: Sequence[str]) -> Blocks:
    """The columns as doubles; they must not hold NULLs. Staged, so a lost executor costs a read."""
    columns = tuple(dict.fromkeys(columns))
    rows = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(2 * cores, math.ceil(rows * len(columns) * 8 / (64 << 20)))
    values = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v")).repartition(parts)
    packed = stage_table(values.mapInArrow(_pack(len(columns)), "x binary"), "packed_rows")
    return Blocks(packed.persist(StorageLevel.MEMORY_AND_DISK), columns, rows, parts)


def _arrays(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in batch.column("x"):
            yield np.frombuffer(x.as_buffer(), "<f8").reshape(-1, width)


@dataclass(frozen=True)
class _Shape:
    """Layout of one result: sums, then for each of ``keys`` a number and a vector, of which the largest number wins."""

    sums: int
    keys: int = 0
    width: int = 0

    def empty(self) -> np.ndarray:
        out = np.zeros(self.sums + self.keys * (1 + self.width))
        out[self.sums:self.sums + self.keys] = -np.inf
        return out

    def merge(self, into: np.ndarray, other: np.ndarray) -> None:
        s, m = self.sums, self.keys
        into[:s] += other[:s]
        if m:
            mine, theirs = (a[s + m:].reshape(m, self.width) for a in (into, other))
            wins = other[s:s + m] > into[s:s + m]
            mine[wins] = theirs[wins]
            into[s:s + m][wins] = other[s:s + m][wins]

    def offer(self, into: np.ndarray, keys: np.ndarray, rows: np.ndarray, some: slice) -> None:
        """``keys``: some of the keys x rows; ``rows``: the vectors of the rows."""
        best = keys.argmax(axis=1)
        top = keys[np.arange(len(best)), best]
        mine = into[self.sums:self.sums + self.keys][some]
        wins = top > mine
        mine[wins] = top[wins]
        into[self.sums + self.keys:].reshape(self.keys, self.width)[some][wins] = rows[best[wins]]


def _scan(blocks: Blocks, state: object, shapes: Sequence[_Shape],
          work: Callable[[np.ndarray, object, list[np.ndarray]], None]) -> list[np.ndarray]:
    """One pass over all rows: ``work(rows, state, results)`` per block; results are merged in tasks, then here.

    ``state`` is broadcast; it has the size of the models, not of the rows.
    """
    sent = blocks.df.sparkSession.sparkContext.broadcast(state)
    width = len(blocks.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        results = [s.empty() for s in shapes]
        for x in _arrays(batches, width):
            work(x, sent.value, results)
        part = TaskContext.get().partitionId()
        yield pa.record_batch([
            pa.array(np.full(len(results), part // _FAN_IN, np.int32)), pa.array(np.arange(len(results), dtype=np.int32)),
            pa.array([r.tobytes() for r in results], pa.binary())], names=["bucket", "slot", "r"])

    def merged(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        slot = key[1].as_py()
        total = shapes[slot].empty()
        for r in rows.column("r"):
            shapes[slot].merge(total, np.frombuffer(r.as_buffer(), "<f8"))
        return pa.table({"bucket": pa.array([0], pa.int32()), "slot": pa.array([slot], pa.int32()),
                         "r": pa.array([total.tobytes()], pa.binary())})

    schema = "bucket int, slot int, r binary"
    rows = blocks.df.mapInArrow(run, schema)
    if blocks.parts > _FAN_IN:  # the driver gets one result per so many tasks
        rows = rows.groupBy("bucket", "slot").applyInArrow(merged, schema)
    totals = [s.empty() for s in shapes]
    for r in rows.collect():
        shapes[r["slot"]].merge(totals[r["slot"]], np.frombuffer(r["r"], "<f8"))
    sent.destroy()
    return totals


# --- fits -----------------------------------------------------------------------
@dataclass(frozen=True)
class Group:
    """Models of one matrix and one K: the columns, and of each model its centres and its subsample (-1: all rows)."""

    columns: np.ndarray
    centres: np.ndarray  # models x k x columns
    runs: np.ndarray


@dataclass(frozen=True)
class Fits:
    """All models of one matrix and one K: models x k x columns, and the cost of each."""

    centres: np.ndarray
    cost: np.ndarray

    @property
    def best(self) -> np.ndarray:
        """Centres of the cheapest model; of equally cheap ones, but for rounding, the first."""
        return self.centres[int((self.cost <= self.cost.min() * (1 + 1e-9)).argmax())]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _row_hash(x: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    out = np.zeros(len(x), np.uint64)
    for j in range(x.shape[1]):
        out = _mixed(out * np.uint64(31) + bits[:, j] + np.uint64(j + 1))
    return out


def distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances: rows x models x k."""
    m, k, d = centres.shape
    flat = centres.reshape(-1, d)
    square = (v * v).sum(axis=1)[:, None] + (flat * flat).sum(axis=1)[None, :] - 2 * (v @ flat.T)
    return np.maximum(square, 0).reshape(len(v), m, k)


def _held(x: np.ndarray, bits: np.ndarray, runs: np.ndarray) -> np.ndarray | None:
    """Whether a row is in a model's subsample: models x rows; None where every model has all rows."""
    if (runs < 0).all():
        return None
    own = np.ones((len(runs), len(x)), bool)
    known, at = np.unique(runs, return_inverse=True)
    for i, run in enumerate(known):
        if run >= 0:
            own[at == i] = (x[:, bits[run // RUNS_PER_COLUMN]].astype(np.int64) >> (run % RUNS_PER_COLUMN) & 1).astype(bool)
    return own


def _pieces(x: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    step = max(1, _CELLS // max(1, cells))
    for a in range(0, len(x), step):
        yield x[a:a + step]


def _tiles(rows: int, models: int, k: int) -> Iterator[tuple[slice, slice]]:
    """Rows and models in tiles whose distances stay in a core's cache."""
    high = min(rows, _TILE_ROWS)
    wide = max(1, _TILE_CELLS // max(1, high * k))
    for a in range(0, rows, _TILE_ROWS):
        for b in range(0, models, wide):
            yield slice(a, a + _TILE_ROWS), slice(b, min(models, b + wide))


def _widened(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a column of ones, and their squared lengths."""
    return np.concatenate([v, np.ones((len(v), 1))], axis=1), (v * v).sum(axis=1)


def _slabs(wide: np.ndarray, centres: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Squared distances less the rows' squared lengths, k x models x rows: one product of widened rows and centres."""
    m, k, d = centres.shape
    flat = centres.transpose(1, 0, 2).reshape(k * m, d)
    points = np.concatenate([-2 * flat, (flat * flat).sum(axis=1)[:, None]], axis=1)
    return np.matmul(points, wide.T, out=None if out is None else out.reshape(k * m, len(wide))).reshape(k, m, len(wide))


class _Room:
    """Arrays that tiles fill one after the other, so that a tile takes no new memory."""

    def __init__(self) -> None:
        self.flat: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], kind: type) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.flat or len(self.flat[name]) < size:
            self.flat[name] = np.empty(size, kind)
        return self.flat[name][:size].reshape(shape)


def _seed_work(x: np.ndarray, state: tuple, results: list[np.ndarray]) -> None:
    """Of every model one row, drawn in proportion to its squared distance from the centres so far.

    The draw of a row and a model is the same in every group, so it is made once.
    """
    groups, shapes, bits, seed, step = state
    names = _row_hash(x)
    views = [(v, *_widened(v)) for v in (np.ascontiguousarray(x[:, g.columns]) for g in groups)]
    most = max((len(g.centres) for g in groups), default=0)
    salt = _mixed(np.arange(most, dtype=np.uint64) + np.uint64((seed * 1000 + step) % (1 << 40)) * np.uint64(1 << 20))
    r = max((g.centres.shape[1] for g in groups), default=0)
    for rows, models in _tiles(len(x), most, max(r, 1)):
        u = (_mixed(names[rows] ^ salt[models, None]) >> np.uint64(11)).astype(float) / float(1 << 53) + 2.0 ** -54
        late = np.maximum(-np.log(u), 2.0 ** -54)
        for group, shape, out, (v, wide, square) in zip(groups, shapes, results, views):
            centres = group.centres[models]
            time = late[:len(centres)]
            weight = 1.0
            if centres.shape[1]:
                weight = np.maximum(_slabs(wide[rows], centres).min(axis=0) + square[rows], 0)
            # The largest log(weight) - log(-log(u)); rows that are centres already stay behind all others, but may
            # be taken if there are no others.
            keys = weight / time
            own = _held(x[rows], bits, group.runs[models])
            shape.offer(out, keys if own is None else np.where(own, keys, -np.inf), v[rows], slice(models.start, models.start + len(centres)))


def _lloyd_work(x: np.ndarray, state: tuple, results: list[np.ndarray]) -> None:
    """Per model and label the rows and their sum; per model the cost and the farthest row."""
    groups, shapes, bits = state
    room, columns = _Room(), None
    for group, shape, out in zip(groups, shapes, results):
        m, k, d = group.centres.shape
        sums, counts = out[:m * k * d].reshape(m, k, d), out[m * k * d:m * k * (d + 1)].reshape(m, k)
        cost = out[m * k * (d + 1):shape.sums]
        if columns is None or not np.array_equal(columns, group.columns):  # groups of one matrix stand together
            columns = group.columns
            v = np.ascontiguousarray(x[:, columns])
            wide, square = _widened(v)
        for rows, models in _tiles(len(v), m, k):
            part = wide[rows]
            size = (len(group.runs[models]), len(part))
            gap = _slabs(part, group.centres[models], room("gap", (k, *size), float))
            near, hits, marks = room("near", size, float), room("hits", (k, *size), bool), room("marks", size, float)
            near[:] = gap[0]
            for g in gap[1:]:
                np.minimum(near, g, out=near)
            own = _held(x[rows], bits, group.runs[models])
            np.equal(gap, near, out=hits)
            if own is not None:
                hits &= own
            if np.count_nonzero(hits) > (near.size if own is None else np.count_nonzero(own)):
                left = np.ones(size, bool)
                for hit in hits:  # of equally near centres the first
                    hit &= left
                    left ^= hit
            for label, hit in enumerate(hits):
                marks[:] = hit
                total = marks @ part
                sums[models, label] += total[:, :-1]
                counts[models, label] += total[:, -1]
            near += square[rows]
            np.maximum(near, 0, out=near)
            if own is not None:
                near *= own
            cost[models] += near.sum(axis=1)
            shape.offer(out, near, v[rows], models)


def _seeds(blocks: Blocks, views: Sequence[np.ndarray], runs: np.ndarray, most: int, bits: np.ndarray, seed: int) -> list[np.ndarray]:
    """Starting centres of each view, models x ``most`` x columns; the first k of them serve every smaller K."""
    m = len(runs)
    found = [np.zeros((m, 0, len(v))) for v in views]
    for step in range(most):
        groups = [Group(v, c, runs) for v, c in zip(views, found)]
        shapes = [_Shape(0, m, len(v)) for v in views]
        drawn = _scan(blocks, (groups, shapes, bits, seed, step), shapes, _seed_work)
        found = [np.concatenate([c, r[m:].reshape(m, 1, -1)], axis=1) for c, r in zip(found, drawn)]
    return found


def improve(blocks: Blocks, starts: Sequence[Group], max_iter: int = 100, tol: float = 1e-4,
            bits: np.ndarray = np.zeros(0, np.int64)) -> list[Fits]:
    """Lloyd steps of all models until no centre of a model moves by more than ``tol``.

    A model that has come to rest leaves the passes. A label without rows gets the row that is
    farthest from its centre.
    """
    centres = [g.centres.copy() for g in starts]
    cost = [np.full(len(c), np.inf) for c in centres]
    moving = [np.arange(len(c)) for c in centres]
    for _ in range(max_iter):
        live = [i for i, m in enumerate(moving) if len(m)]
        if not live:
            break
        groups = [Group(starts[i].columns, centres[i][moving[i]], starts[i].runs[moving[i]]) for i in live]
        shapes = []
        for g in groups:
            m, k, d = g.centres.shape
            shapes.append(_Shape(m * k * (d + 1) + m, m, d))
        for i, g, shape, out in zip(live, groups, shapes, _scan(blocks, (groups, shapes, bits), shapes, _lloyd_work)):
            m, k, d = g.centres.shape
            sums, counts = out[:m * k * d].reshape(m, k, d), out[m * k * d:m * k * (d + 1)].reshape(m, k)
            far, row = out[shape.sums:shape.sums + m], out[shape.sums + m:].reshape(m, d)
            new = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], g.centres)
            empty = (counts == 0).any(axis=1) & (far > 0)
            new[empty, (counts == 0).argmax(axis=1)[empty]] = row[empty]
            cost[i][moving[i]] = out[m * k * (d + 1):shape.sums]
            centres[i][moving[i]] = new
            step = np.sqrt(((new - g.centres) ** 2).sum(axis=2)).max(axis=1)
            moving[i] = moving[i][step > tol]
    return [Fits(c, e) for c, e in zip(centres, cost)]


def fit_models(blocks: Blocks, views: Mapping[str, Sequence[str]], ks: Sequence[int], n_init: int, seed: int = SEED,
               max_iter: int = 100, tol: float = 1e-4, runs: Sequence[int] = (-1,),
               bits: Sequence[str] = ()) -> dict[tuple[str, int], Fits]:
    """``n_init`` models per run for every matrix (``views``: name to columns) and K, started by k-means++ over all rows.

    ``bits`` names columns with ``RUNS_PER_COLUMN`` subsamples each; run ``r`` sees the rows
    with its bit. Models of one run stand together.
    """
    names = list(views)
    places = [blocks.at(views[n]) for n in names]
    held = blocks.at(bits)
    of_model = np.repeat(np.asarray(runs, np.int64), n_init)
    seeds = _seeds(blocks, places, of_model, max(ks), held, seed)
    tasks = [(n, k) for n in names for k in ks]
    starts = [Group(places[names.index(n)], seeds[names.index(n)][:, :k].copy(), of_model) for n, k in tasks]
    return dict(zip(tasks, improve(blocks, starts, max_iter, tol, held)))


# --- a fitted model ---------------------------------------------------------------
@dataclass(frozen=True)
class Clustering:
    """Centres over named columns; gives each row the label of its nearest centre."""

    centres: np.ndarray
    columns: tuple[str, ...]
    cost: float
    prediction: str = "prediction"

    def setPredictionCol(self, name: str) -> "Clustering":
        return replace(self, prediction=name)

    def transformer(self) -> SQLTransformer:
        """The assignment as a stage that can be saved; equally near centres go to the first."""
        def square(centre: np.ndarray) -> str:
            return " + ".join(f"(`{c}` - ({float(x)!r}D)) * (`{c}` - ({float(x)!r}D))" for c, x in zip(self.columns, centre))

        gaps = ", ".join(f"{square(c)} AS _gap_{i}" for i, c in enumerate(self.centres))
        names = ", ".join(f"_gap_{i}" for i in range(len(self.centres)))
        return SQLTransformer(statement=(
            f"SELECT * EXCEPT ({names}), CAST(array_position(array({names}), array_min(array({names}))) - 1 AS INT) "
            f"AS `{self.prediction}` FROM (SELECT *, {gaps} FROM __THIS__)"))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.transformer().transform(df)


def nearest_label(centres: np.ndarray):
    """The label of the nearest of many centres, from an array column."""
    @F.pandas_udf("int")
    def label(points: pd.Series) -> pd.Series:
        if not len(points):
            return pd.Series([], dtype="int32")
        v = np.stack(points.to_list())
        parts = [distances(x, centres[None])[:, 0].argmin(axis=1) for x in _pieces(v, len(centres))]
        return pd.Series(np.concatenate(parts).astype(np.int32))

    return label


# --- measures of labelings ----------------------------------------------------------
@dataclass(frozen=True)
class Labeling:
    """A matrix and its labels 0..k-1: from centres, or from a column of the blocks."""

    columns: np.ndarray
    k: int
    centres: np.ndarray | None = None
    label: int = -1

    def of(self, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        if self.centres is None:
            return x[:, self.label].astype(np.int64)
        return distances(v, self.centres[None]).argmin(axis=2)[:, 0]


def _marks(label: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(label), k))
    out[np.arange(len(label)), label] = 1
    return out


def _moment_work(x: np.ndarray, state: tuple, results: list[np.ndarray]) -> None:
    """Per label: rows and sums of the matrix, squares around the label's centre where there is one, sums of the
    ``measured`` columns, rows by ``crossed`` value.
    """
    labelings, measured, crossed, levels = state
    cross = np.zeros((len(x), levels))
    if crossed >= 0:
        cross[np.arange(len(x)), x[:, crossed].astype(np.int64)] = 1
    extra = x[:, measured]
    for labeling, out in zip(labelings, results):
        v = x[:, labeling.columns]
        label = labeling.of(x, v)
        marks = _marks(label, labeling.k)
        near = v if labeling.centres is None else v - labeling.centres[label]
        out += np.concatenate([
            marks.sum(axis=0), (marks.T @ v).ravel(), marks.T @ (near * near).sum(axis=1), (marks.T @ extra).ravel(),
            (marks.T @ cross).ravel(), (extra * extra).sum(axis=0)])


def _spread_work(x: np.ndarray, state: tuple, results: list[np.ndarray]) -> None:
    """Per label the squared and the plain distances to its mean; the sum of the squared silhouette."""
    labelings, means, counts, inner = state
    for labeling, mean, n, within, out in zip(labelings, means, counts, inner, results):
        v = x[:, labeling.columns]
        label = labeling.of(x, v)
        marks = _marks(label, labeling.k)
        gap = distances(v, mean[None])[:, 0]
        # Differences, not products, for the distance to the own mean, which may be tiny.
        own = ((v - mean[label]) ** 2).sum(axis=1)
        gap[np.arange(len(v)), label] = own
        far = gap + within[None, :]
        size = n[label]
        a = np.take_along_axis(far, label[:, None], axis=1)[:, 0] * size / np.maximum(size - 1, 1)
        b = np.where((marks > 0) | (n == 0)[None, :], np.inf, far).min(axis=1)
        top = np.maximum(a, b)
        with np.errstate(invalid="ignore", divide="ignore"):
            s = np.where((size > 1) & np.isfinite(b) & (top > 0), (b - a) / top, 0.0)
        out += np.concatenate([marks.T @ own, marks.T @ np.sqrt(own), [s.sum()]])


def _ratio(a: float, b: float) -> float | None:
    return float(a / b) if b else None


def rand_index(cells: np.ndarray) -> float:
    """Adjusted Rand index of a contingency table; 1 when nothing could differ."""
    def pairs(x):
        return float((x * (x - 1) / 2).sum())

    n = cells.sum()
    s, sa, sb, p = pairs(cells), pairs(cells.sum(axis=1)), pairs(cells.sum(axis=0)), n * (n - 1) / 2
    expected = sa * sb / p if p else 0.0
    bottom = (sa + sb) / 2 - expected
    return float((s - expected) / bottom) if bottom else 1.0


def measure(blocks: Blocks, labelings: Sequence[Labeling], explained: Mapping[str, Sequence[str]] | None = None,
            crossed: str | None = None, levels: int = 1) -> list[dict]:
    """All measures of all labelings from two passes: a dict each.

    ``explained`` names groups of columns; each gives the mean share of variance that the labels explain,
    0 for a constant one. ``crossed`` is a column of codes 0..levels-1, compared with the labels as
    ``redundancy``. The silhouette is that on squared distances.
    """
    explained = explained or {}
    used = list(dict.fromkeys(c for group in explained.values() for c in group))
    measured = blocks.at(used)
    cross = int(blocks.at([crossed])[0]) if crossed else -1
    e = len(used)
    shapes = [_Shape(x.k * (len(x.columns) + 2 + e + levels) + e) for x in labelings]
    first = _scan(blocks, (list(labelings), measured, cross, levels), shapes, _moment_work)
    counts, means, inner, parts = [], [], [], []
    for x, out in zip(labelings, first):
        k, d = x.k, len(x.columns)
        cut = np.cumsum([k, k * d, k, k * e, k * levels, e])
        n, sums, squares, extra, table, total = np.split(out, cut[:-1])
        mean = sums.reshape(k, d) / np.maximum(n, 1)[:, None]
        counts.append(n)
        means.append(mean)
        off = mean if x.centres is None else mean - x.centres
        inner.append(np.maximum(squares / np.maximum(n, 1) - (off * off).sum(axis=1), 0))
        parts.append((extra.reshape(k, e), table.reshape(k, levels), total))
    second = _scan(blocks, (list(labelings), means, counts, inner), [_Shape(2 * x.k + 1) for x in labelings], _spread_work)
    return [_measures(x, n, mean, *part, out, explained, used, bool(crossed))
            for x, n, mean, part, out in zip(labelings, counts, means, parts, second)]


def _measures(x: Labeling, n: np.ndarray, mean: np.ndarray, extra: np.ndarray, table: np.ndarray, total: np.ndarray,
              spread: np.ndarray, explained: Mapping[str, Sequence[str]], used: Sequence[str], crossed: bool) -> dict:
    rows, there = n.sum(), np.flatnonzero(n)
    inertia = float(spread[:x.k].sum())
    grand = (mean * n[:, None]).sum(axis=0) / max(rows, 1)
    between = float((n[:, None] * (mean - grand) ** 2).sum())
    upper, lower = _ratio(between, len(there) - 1), _ratio(inertia, rows - len(there))
    width = spread[x.k:2 * x.k][there] / n[there]
    gap = np.sqrt(((mean[there][:, None] - mean[there][None]) ** 2).sum(axis=2))
    worst = np.divide(width[:, None] + width[None], gap, out=np.zeros_like(gap), where=gap > 0)
    np.fill_diagonal(worst, -np.inf)
    smallest = int(n.min()) if rows else 0
    out = {
        "k": x.k, "inertia": inertia, "silhouette": float(spread[-1] / rows) if rows else None,
        "calinski_harabasz": _ratio(upper, lower) if upper is not None and lower is not None else None,
        "davies_bouldin": float(worst.max(axis=1).mean()) if len(there) > 1 else None,
        "min_cluster_size": smallest, "min_cluster_pct": _ratio(smallest, float(rows)),
    }
    if used:
        g = extra.sum(axis=0) / rows
        whole = total - rows * g * g
        between = (n[there][:, None] * (extra[there] / n[there][:, None] - g) ** 2).sum(axis=0)
        share = dict(zip(used, np.divide(between, whole, out=np.zeros_like(whole), where=whole > 1e-9 * np.maximum(total, 1e-300))))
        out |= {name: float(np.mean([share[c] for c in group])) for name, group in explained.items()}
    if crossed:
        out["redundancy"] = rand_index(table)
    return out


# --- agreement with a base labeling, run by run ---------------------------------------
def _agreement_work(x: np.ndarray, state: tuple, results: list[np.ndarray]) -> None:
    group, base, levels, bits = state
    m, k, _ = group.centres.shape
    tables = results[0].reshape(m, k, levels)
    wide, _ = _widened(np.ascontiguousarray(x[:, group.columns]))
    other = _marks(x[:, base].astype(np.int64), levels)
    for rows, models in _tiles(len(x), m, k):
        gap = _slabs(wide[rows], group.centres[models])
        near = gap.min(axis=0)
        own = _held(x[rows], bits, group.runs[models])
        left = np.ones(near.shape, bool) if own is None else own.copy()
        for label, g in enumerate(gap):
            mark = (g == near) & left
            left ^= mark
            tables[models, label] += mark.astype(float) @ other[rows]


def agreement_by_run(blocks: Blocks, group: Group, base: str, levels: int, bits: Sequence[str]) -> np.ndarray:
    """Adjusted Rand index of each model with column ``base`` over the rows of its run, from one pass."""
    m, k, _ = group.centres.shape
    shape = _Shape(m * k * levels)
    out, = _scan(blocks, (group, int(blocks.at([base])[0]), levels, blocks.at(bits)), [shape], _agreement_work)
    return np.array([rand_index(t) for t in out.reshape(m, k, levels)])
