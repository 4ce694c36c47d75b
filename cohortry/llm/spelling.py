"""Words that are one edit apart, found by products of letter counts.

An edit of one code point changes the counts of letters by one (an insertion or a deletion:
squared distance 1) or by one down and one up (a replacement: squared distance 2), so
products of blocks of letter counts, the Gram matrix, leave few pairs to verify. Words stand in
blocks by length and by how their letters spread over a few groups of the alphabet; an
edit leads to the same block or to a known neighbour, in the same or an adjacent length.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm import hashing as H
from cohortry.llm.staging import staged

_TILE = 1024
_TILE_BYTES = 1 << 20
_GROUPS = 6
_HELD = 200_000
_SHORT = 64
# The table of the CRC-32 of zlib, from its polynomial.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> 1), _CRC >> 1).astype(np.uint32)


# --- words ----------------------------------------------------------------------
def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of ``[A-Za-z\\u00C0-\\u00FF]``; in UTF-8 these are ASCII letters and C3 with its second byte."""
    low = data | 0x20
    inside = (low >= 0x61) & (low <= 0x7A)
    lead = data == 0xC3
    inside |= lead
    inside[1:] |= lead[:-1]
    return inside


def _crc_of_runs(data: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The CRC-32 of what ``state`` has seen and each run after it; byte by byte over all short runs at once."""
    out = np.empty(len(start), np.uint32)
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = zlib.crc32(data[start[i]:start[i] + size[i]], int(state[i]))
    order = np.flatnonzero(size <= _SHORT)
    order = order[np.argsort(-size[order], kind="stable")]
    crc, at, left = ~state[order], start[order], size[order]
    for j in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -j, side="left"))
        part = crc[:live]
        crc[:live] = _CRC[(part ^ data[at[:live] + j]) & 0xFF] ^ (part >> np.uint32(8))
    out[order] = ~crc
    return out


def _counted(ids: list, texts: pa.Array, least: int, one_in: int) -> tuple[list[str], np.ndarray]:
    """Distinct words of some texts and how often they occur."""
    data, offsets = H.text_bytes(texts)
    data = data.copy()
    upper = (data >= 0x41) & (data <= 0x5A)
    data[upper] += 0x20
    inside = _letters(data)
    begins = H.run_begins(inside.astype(np.uint8), offsets)
    start = np.flatnonzero(begins)
    if not len(start):
        return [], np.zeros(0, np.int64)
    outside = np.r_[np.flatnonzero(~inside), len(data)]
    end = np.minimum(outside[np.searchsorted(outside, start)], offsets[np.searchsorted(offsets, start, side="right")])
    doc = np.searchsorted(offsets, start, side="right") - 1
    seen = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = _crc_of_runs(data, start, end - start, seen[doc])
    # Code points: all bytes but second ones, which are below C0.
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    length = points[end] - points[start]
    hit = crc % one_in == 0
    plain = ~hit & (length >= least)
    hashes, _ = H.run_hashes(data, inside, begins, H.byte_values)
    _, first, count = np.unique(hashes[plain], return_index=True, return_counts=True)
    where = np.flatnonzero(plain)[first]
    raw = data.tobytes()
    words = [raw[a:b].decode() for a, b in zip(start[where].tolist(), end[where].tolist())]
    changed = []
    for i in np.flatnonzero(hit & (length > least)).tolist():
        word = raw[start[i]:end[i]].decode()
        cut = int(crc[i]) % len(word)
        changed.append(word[:cut] + word[cut + 1:])
    return words + changed, np.r_[count, np.ones(len(changed), np.int64)]


def _count_words(least: int, one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for piece in H.slices(batch, "text"):
                words, counts = _counted(piece.column("doc_id").to_pylist(), piece.column("text"), least, one_in)
                for w, c in zip(words, counts.tolist()):
                    held[w] = held.get(w, 0) + c
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()
    return run


def word_table(docs: DataFrame, least: int = 6, occurrences: int = 5, one_in: int = 199) -> DataFrame:
    """``(word, n)`` of runs of letters in all texts, only A-Z in lower case.

    A run loses one code point where the crc32 of ``<doc_id>:<run>`` is a multiple of
    ``one_in`` (a null id is empty, ids are written as text). Words have ``least`` code points
    or more and ``occurrences`` or more. Null and empty texts have none; rows that repeat an id count as they are.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("text"))
    counted = rows.mapInArrow(_count_words(least, one_in), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


# --- blocks ---------------------------------------------------------------------
def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, one byte each (all are below 256), and where each word begins."""
    texts = words.to_pylist()
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("latin-1"), np.uint8), np.r_[0, np.cumsum(size)]


def _shapes(codes: np.ndarray, offsets: np.ndarray, groups: int) -> np.ndarray:
    """How many letters of each group of the alphabet a word has: words x groups."""
    group = ((codes.astype(np.int64) * 40503) >> 4) % groups
    word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.bincount(word * groups + group, minlength=(len(offsets) - 1) * groups).reshape(-1, groups)


def _shape_words(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = _shapes(*_codes(batch.column("word")), groups)
            yield pa.record_batch([*batch.columns, pa.array(list(shapes), pa.list_(pa.int64()))], names=["word", "n", "shape"])
    return run


def _pack_tiles(most: int):
    """Words of one block in a sorted partition, packed into tiles of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, tile, words, counts, size = None, "", [], [], 0

        def packed():
            return (list(shape), tile, "".join(words).encode("latin-1"), np.array(counts, "<i8").tobytes())

        for batch in batches:
            out = []
            for s, w, n in zip(batch.column("shape").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                if s != shape or len(words) >= most or size + len(w) > _TILE_BYTES:
                    if words:
                        out.append(packed())
                    # Tasks that hold parts of one block give their tiles different names.
                    shape, tile, words, counts, size = s, hashlib.md5(w.encode()).hexdigest(), [], [], 0
                words.append(w)
                counts.append(n)
                size += len(w)
            yield _tiles(out)
        if words:
            yield _tiles([packed()])
    return run


def _tiles(rows: list[tuple]) -> pa.RecordBatch:
    shape, tile, words, counts = zip(*rows) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(shape, pa.list_(pa.int64())), pa.array(tile, pa.string()), pa.array(words, pa.binary()),
                            pa.array(counts, pa.binary())], names=["shape", "tile", "words", "counts"])


def _neighbours(shape: Column, groups: int) -> Column:
    """Shapes that an edit can lead to, each pair of shapes from one side: itself, one letter moved to a later group, one more."""
    def moved(up: int | None, down: int | None) -> Column:
        return F.transform(shape, lambda x, i: x + (F.when(i == up, 1).otherwise(0) if up is not None else 0)
                           - (F.when(i == down, 1).otherwise(0) if down is not None else 0))

    return F.array(shape, *[moved(b, a) for a in range(groups) for b in range(a + 1, groups)],
                   *[moved(b, None) for b in range(groups)])


# --- pairs ----------------------------------------------------------------------
def _one_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of letters are one edit apart; rows of ``y`` are as long or one longer."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(axis=1) == 1
    before = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
    after = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + after >= x.shape[1]


def _near(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near pairs of two blocks of equally long words (rows of letters)."""
    wide = b.shape[1]
    # Counts are whole, and their products stay exact.
    kind = np.float32 if wide <= 1024 else np.float64
    letters, inverse = np.unique(np.r_[a.ravel(), b.ravel()], return_inverse=True)
    n = len(letters)

    def counts(part: np.ndarray, inv: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(part)), part.shape[1])
        return np.bincount(row * n + inv, minlength=len(part) * n).reshape(-1, n).astype(kind)

    p, q = counts(a, inverse[:a.size]), counts(b, inverse[a.size:])
    square = (p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * (p @ q.T)
    i, j = np.nonzero(square == (2 if wide == a.shape[1] else 1))
    if same:
        i, j = i[i < j], j[i < j]
    keep, step = [], max(1, (1 << 22) // wide)
    for s in range(0, len(i), step):
        keep.append(_one_apart(a[i[s:s + step]], b[j[s:s + step]]))
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[keep], j[keep]


def _best(place: np.ndarray, other: np.ndarray, n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place ``(place, near words, the best of them)``: largest n, then first in order."""
    rank = np.lexsort((order[other], -n[other], place))
    place, other = place[rank], other[rank]
    begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    return place[begin], np.diff(np.r_[begin, len(place)]), other[begin]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of tiles; of each word with near words there: its count, and the best of them."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            n_a, n_b = (np.frombuffer(row[c], "<i8") for c in ("counts", "counts_b"))
            a = np.frombuffer(row["words"], np.uint8).reshape(len(n_a), -1)
            b = np.frombuffer(row["words_b"], np.uint8).reshape(len(n_b), -1)
            i, j = _near(a, b, row["same"])
            if not len(i):
                continue
            if row["same"]:
                sides = [(np.r_[i, j], np.r_[j, i], a, n_a, a, n_a)]
            else:
                sides = [(i, j, a, n_a, b, n_b), (j, i, b, n_b, a, n_a)]
            for place, other, x, n_x, y, n_y in sides:
                order = np.empty(len(y), np.int64)
                order[np.argsort([z.tobytes() for z in y], kind="stable")] = np.arange(len(y))
                place, count, best = _best(place, other, n_y, order)
                text = lambda rows: pa.array([z.tobytes().decode("latin-1") for z in rows], pa.string())
                yield pa.record_batch([text(x[place]), pa.array(n_x[place]), pa.array(count.astype(np.int64)), text(y[best]), pa.array(n_y[best])],
                                      names=["word", "n", "n_near", "best", "best_n"])


def near_words(words: DataFrame, groups: int = _GROUPS, tile_words: int = _TILE) -> DataFrame:
    """``(word, n, n_near, best, best_n)`` of words that have a near word, one edit of a code point apart.

    ``words``: distinct ``(word, n)`` of code points below 256. A block of equal shape
    may be spread over many tasks and tiles; every pair of tiles in equal or neighbouring shapes
    is worked once, so the work grows with the square of a shape's words, as that of any Gram matrix does.
    """
    shaped = words.select("word", "n").mapInArrow(_shape_words(groups), "word string, n long, shape array<long>")
    order = ["shape", "word"]
    tiles = staged(shaped.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pack_tiles(tile_words), "shape array<long>, tile string, words binary, counts binary"), "tiles")
    names = tiles.select("shape", "tile")
    pairs = names.select("shape", "tile", F.explode(_neighbours(F.col("shape"), groups)).alias("shape_b")).join(
        names.select(F.col("shape").alias("shape_b"), F.col("tile").alias("tile_b")), "shape_b").filter(
        (F.col("shape") != F.col("shape_b")) | (F.col("tile") <= F.col("tile_b")))
    loaded = pairs.join(tiles, ["shape", "tile"]).join(
        tiles.select(F.col("shape").alias("shape_b"), F.col("tile").alias("tile_b"), F.col("words").alias("words_b"),
                     F.col("counts").alias("counts_b")), ["shape_b", "tile_b"])
    same = (F.col("shape") == F.col("shape_b")) & (F.col("tile") == F.col("tile_b"))
    found = loaded.select("words", "counts", "words_b", "counts_b", same.alias("same")).mapInArrow(
        _compare, "word string, n long, n_near long, best string, best_n long")
    return found.groupBy("word").agg(
        F.first("n").alias("n"), F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b")).select(
        "word", "n", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def spelling_forms(words: DataFrame, times: int = 5, **blocks) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of all ``words`` (``word, n``).

    A word's form is its near word of largest n (ties: first in code-point order) where
    that is ``times`` its own n or more. Forms grow by that factor at each step, so following them
    ends; each round doubles the steps already followed.
    """
    words = staged(words, "words")
    table = staged(words.join(near_words(words, **blocks).drop("n"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best_n") >= times * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= times * F.col("n"), F.col("best_n")).alias("form_n")), "forms")
    roots = table.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        roots = staged(roots, "roots")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = roots.join(further, "root", "left")
        if not stepped.filter("next IS NOT NULL").limit(1).count():
            break
        roots = stepped.select("word", F.coalesce("next", "root").alias("root"))
    return table.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
