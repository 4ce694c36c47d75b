"""Near duplicates by the Jaccard similarity of word shingles, with adaptive multi-match prefixes.

A text's shingles are put in one global order, rare ones first. If two sets
overlap in t of their shingles or more, the first ``n - t + l`` of each share
``l`` at least. A longer prefix (a larger ``l``) reads more postings but asks for
more shared shingles, so fewer pairs go to verification; each text takes the
``l`` with the least estimated cost, and a pair needs the smaller of its two.

Steps, all on whole texts:

1. Every text's shingle hashes are dealt by hash range, packed in arrays, and each
   range counts in how many texts each of its shingles is.
2. Shingles of two texts or more go back to their text. A text with fewer such
   shingles than a partner must share has no partner; most texts end here.
3. Equal sets collapse into classes. Texts whose prefixes share a shingle, also in
   steps, form a cluster; within its blocks prefix matches are counted, enough of
   them verified on the whole sets, and a forest of links comes out. Blocks whose
   texts are already connected are not compared, and a large cluster is dealt out
   by pairs of blocks, so copies are never expanded into all pairs.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm import hashing as H
from cohortry.llm.components import connected_components
from cohortry.llm.staging import staged

_PACKED = "bucket int, flush long, rows binary, ids binary, sizes binary, low binary, high binary, place binary"
_COUNTED = "flush long, n_packed long, rows binary, ids binary, sizes binary, token binary, place binary, df binary"
_TEXTS = ("row long, doc_id long, n_shingles long, needed int, prefix int, class_hi long, class_lo long, "
          "first array<bigint>, tokens binary")
_FORESTS = "a long, b long"
_NO_ID = np.iinfo(np.int64).min


def _pack(width: int, buckets: int, flush_tokens: int):
    """Batches of (doc_id, text) to one packed row per flush and hash range, and one row with the flush's texts."""
    schema = pa.schema([("bucket", pa.int32()), ("flush", pa.int64()), *[
        (c, pa.binary()) for c in ("rows", "ids", "sizes", "low", "high", "place")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        row = flush = size = 0
        held: list = []

        def packed() -> pa.RecordBatch:
            tokens = np.concatenate([x[0] for x in held])
            counts = np.concatenate([np.diff(x[1]) for x in held])
            ids = np.concatenate([x[2] for x in held])
            place = np.repeat(np.arange(len(counts), dtype=np.uint16), counts)
            bucket = ((tokens >> np.uint64(44)) * np.uint64(buckets) >> np.uint64(20)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            low = tokens[order].astype("<u4")
            high = (tokens[order] >> np.uint64(32)).astype("<u2")
            place = place[order].astype("<u2")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            key = (part << 24) + flush
            full = [k for k in range(buckets) if cuts[k + 1] > cuts[k]]
            rows = np.arange(row - len(ids), row, dtype=np.int64) + (part << 40)
            cut = lambda x: [None, *[x[cuts[k]:cuts[k + 1]].tobytes() for k in full]]
            none = [None] * len(full)
            return pa.record_batch([
                pa.array([key % buckets, *full], pa.int32()), pa.array([key] * (len(full) + 1), pa.int64()),
                pa.array([rows.tobytes(), *none], pa.binary()), pa.array([ids.tobytes(), *none], pa.binary()),
                pa.array([counts.astype("<i8").tobytes(), *none], pa.binary()),
                *[pa.array(cut(x), pa.binary()) for x in (low, high, place)],
            ], schema=schema)

        for batch in batches:
            for piece in H.slices(batch, "text"):
                words, first, _ = H.word_hashes(*H.text_bytes(piece.column("text")))
                tokens, bounds = H.shingle_hashes(words, first, width)
                ids = piece.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype("<i8")
                for a in range(0, len(ids), 8192):
                    b = min(len(ids), a + 8192)
                    inner = tokens[bounds[a]:bounds[b]]
                    if held and (size + len(inner) > flush_tokens or sum(len(x[2]) for x in held) + b - a > 65536):
                        yield packed()
                        held, size, flush = [], 0, flush + 1
                    held.append((inner, bounds[a:b + 1] - bounds[a], ids[a:b]))
                    row, size = row + b - a, size + len(inner)
        if held:
            yield packed()

    return run


def _count(table: pa.Table) -> pa.Table:
    """One hash range: the shingles that are in two texts or more, with their document frequency."""
    columns = {c: table.column(c).to_pylist() for c in table.column_names}
    parts = [i for i, x in enumerate(columns["low"]) if x is not None]
    sizes = np.array([len(columns["low"][i]) // 4 for i in parts], np.int64)
    read = lambda c, kind: np.frombuffer(b"".join([columns[c][i] for i in parts]), kind)
    tokens = read("low", "<u4").astype(np.uint64) | read("high", "<u2").astype(np.uint64) << np.uint64(32)
    place = read("place", "<u2")
    order = np.argsort(tokens)
    ranked = tokens[order]
    edge = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[edge, len(ranked)])
    df = np.empty(len(tokens), np.uint32)
    df[order] = np.repeat(runs, runs)
    # The range's number tells apart equal low bits of different ranges.
    salt = np.uint64((columns["bucket"][0] + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    tokens = H.mixed(tokens ^ salt)
    out = {c: [] for c in ("flush", "n_packed", "rows", "ids", "sizes", "token", "place", "df")}
    cuts = np.r_[0, np.cumsum(sizes)]
    at = dict(zip(parts, range(len(parts))))
    for i, flush in enumerate(columns["flush"]):
        out["flush"].append(flush)
        k = at.get(i)
        a, b = (cuts[k], cuts[k + 1]) if k is not None else (0, 0)
        keep = np.flatnonzero(df[a:b] > 1) + a
        out["n_packed"].append(int(b - a))
        for c in ("rows", "ids", "sizes"):
            out[c].append(columns[c][i])
        for c, x, kind in (("token", tokens, "<u8"), ("place", place, "<u2"), ("df", df, "<u4")):
            out[c].append(x[keep].astype(kind).tobytes())
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
    return pa.table([pa.array(out[c], t) for c, t in zip(out, kinds)], names=list(out))


def prefix_choice(n: int, needed: int, df: np.ndarray, most: int, weight: float) -> tuple[int, int]:
    """``(l, shared shingles in the prefix)`` with the least estimated cost.

    ``df``: frequencies of the text's shared shingles, ascending; its other
    ``n - len(df)`` shingles come first in the order and have no postings.
    Postings cost their number; at most postings / l pairs meet l times, and
    each costs ``weight`` to verify.
    """
    l = np.arange(1, max(1, min(most, needed)) + 1)
    length = np.minimum(n - needed + l - (n - len(df)), len(df))
    postings = np.r_[0, np.cumsum(df.astype(np.float64) - 1)][length]
    best = int(np.argmin(postings * (1 + weight / l)))
    return int(l[best]), int(length[best])


def _texts(percent: int, most: int, weight: float):
    """One flush: its texts, with their shared shingles (rare first) where a partner is possible."""
    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in table.column_names}
        head = next(i for i, x in enumerate(columns["rows"]) if x is not None)
        rows, ids, sizes = (np.frombuffer(columns[c][head], "<i8") for c in ("rows", "ids", "sizes"))
        if sum(columns["n_packed"]) != sizes.sum():
            raise RuntimeError("the input changed between two reads; write it as a table first")
        token, place, df = (np.frombuffer(b"".join(columns[c]), kind) for c, kind in (
            ("token", "<u8"), ("place", "<u2"), ("df", "<u4")))
        shared = np.bincount(place, minlength=len(rows))
        needed = -(-sizes * percent // 100)
        keep = (shared >= needed)[place]
        token, place, df = token[keep], place[keep], df[keep]
        order = np.lexsort((token, df, place))
        token, place, df = token[order], place[order], df[order]
        cuts = np.searchsorted(place, np.arange(len(rows) + 1))
        out = {c: [] for c in ("row", "doc_id", "n_shingles", "needed", "prefix", "class_hi", "class_lo", "first",
                             "tokens")}
        for i in range(len(rows)):
            a, b = cuts[i], cuts[i + 1]
            out["row"].append(int(rows[i]))
            out["doc_id"].append(None if ids[i] == _NO_ID else int(ids[i]))
            out["n_shingles"].append(int(sizes[i]))
            if b == a:
                choice, digest, first, mine = (None, None), (None, None), None, None
            else:
                choice = prefix_choice(int(sizes[i]), int(needed[i]), df[a:b], most, weight)
                first, mine = token[a:a + choice[1]].view(np.int64), token[a:b].tobytes()
                # Sets are equal when size and two sums of mixed shingles are; only whole shared sets can be.
                digest = tuple(int(x.sum(dtype=np.uint64).view(np.int64)) for x in (
                    token[a:b], H.mixed(token[a:b] + np.uint64(1)))) if b - a == sizes[i] else (
                        int(rows[i]), -1)
            for c, v in zip(("needed", "prefix", "class_hi", "class_lo", "first", "tokens"),
                            (*choice, *digest, first, mine)):
                out[c].append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(),
                 pa.list_(pa.int64()), pa.binary()]
        return pa.table([pa.array(out[c], t) for c, t in zip(out, kinds)], names=list(out))

    return run


def _overlaps(lists: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """How many shingles each two lists share: products of 0/1 matrices, some columns at a time."""
    out = np.zeros((len(lists), len(lists)), np.float32)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, where, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    common = count > 1
    column = np.where(common, np.cumsum(common) - 1, -1)[where]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int(common.sum()), width):
        lo, hi = np.searchsorted(column, [a, a + width])
        marks = np.zeros((len(lists), width), np.float32)
        marks[owner[lo:hi], column[lo:hi] - a] = 1
        out += marks @ marks.T
    return out


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _cells(percent: int):
    """Links within one cell of a cluster, as a forest: each text with the smallest it is connected to."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        rows, n, needed, prefix, root = (table.column(c).to_numpy() for c in (
            "row", "n_shingles", "needed", "prefix", "root"))
        block, i, j = table.column("block").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        tokens = [np.frombuffer(x, "<u8") for x in table.column("tokens").to_pylist()]
        hits = _overlaps([t[:p] for t, p in zip(tokens, prefix)])
        able = hits >= np.minimum(needed[:, None], needed[None, :])
        able &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
        able &= root[:, None] != root[None, :]
        if i != j:
            able &= block[:, None] != block[None, :]
        np.fill_diagonal(able, False)
        used = np.flatnonzero(able.any(axis=0))
        parent = list(range(len(rows)))
        if len(used):
            both = np.zeros_like(hits)
            both[np.ix_(used, used)] = _overlaps([tokens[k] for k in used])
            linked = able & (100 * both >= percent * (n[:, None] + n[None, :] - both))
            for x, y in zip(*np.nonzero(np.triu(linked))):
                x, y = _find(parent, int(x)), _find(parent, int(y))
                parent[max(x, y)] = min(x, y)
        roots = np.array([_find(parent, x) for x in range(len(rows))], np.int64)
        moved = np.flatnonzero(roots != np.arange(len(rows)))
        return pa.table([pa.array(rows[moved], pa.int64()), pa.array(rows[roots[moved]], pa.int64())], names=["a", "b"])

    return run


def _prefix_clusters(texts: DataFrame) -> DataFrame:
    """``(row, cluster)``: texts that share a shingle of their prefixes, also in steps."""
    postings = texts.select("row", F.explode("first").alias("token"))
    first = postings.groupBy("token").agg(F.min("row").alias("b"), F.max("row").alias("a")).filter("a != b")
    links = postings.join(first.select("token", "b"), "token").select(F.col("row").alias("a"), "b")
    roots = connected_components(links, name="clusters")
    return roots.select(F.col("node").alias("row"), F.col("root").alias("cluster")).unionByName(
        roots.select(F.col("root").alias("row"), F.col("root").alias("cluster")).distinct())


def row_key() -> Column:
    """The key by which ``_pack`` names a row of its input: partition and place in it."""
    at = F.monotonically_increasing_id()
    return F.shiftleft(F.shiftright(at, 33), 40) + at.bitwiseAND(F.lit((1 << 33) - 1))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                       percent: int = 80, most_matches: int = 8, verify_weight: float = 8.0,
                       block_texts: int = 512, block_tokens: int = 2_000_000,
                       range_bytes: int = 12 << 20, flush_tokens: int = 2_000_000,
                       by_row: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row of ``docs``; other columns are not read.

    Two texts link when ``100 * intersection >= percent * union`` of their
    distinct shingles of ``width`` words; ``component_id`` is the smallest id that
    links reach. A null or empty text has no shingles and no links and is its own
    component. A null id stays null; it links as others do but names no
    component. Rows that repeat an id are texts of their own. No rows give none.
    ``docs`` must come from files or another source that gives each partition the
    same rows in the same order again.

    With ``by_row`` it is ``(row, doc_id, n_shingles, group)``: the row's key as ``row_key``
    gives it, and the same number for all rows of a component, whatever their ids.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed = source.mapInArrow(_pack(width, max(1, -(-size // range_bytes)), flush_tokens), _PACKED)
    counted = packed.groupBy("bucket").applyInArrow(_count, _COUNTED)
    texts = staged(counted.groupBy("flush").applyInArrow(
        _texts(percent, most_matches, verify_weight), _TEXTS), "texts")

    live = texts.filter(F.col("tokens").isNotNull())
    classes = live.groupBy("n_shingles", "class_hi", "class_lo").agg(F.min("row").alias("row"))
    heads = live.join(classes.select("row"), "row", "left_semi").select(
        "row", "n_shingles", "needed", "prefix", "first", "tokens")
    clusters = _prefix_clusters(heads)
    sizes = clusters.join(heads.select("row", F.length("tokens").alias("bytes")), "row").groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / block_texts), F.ceil(F.sum("bytes") / (8 * block_tokens)))
        .cast("int").alias("blocks"))
    members = staged(heads.drop("first").join(clusters, "row").join(sizes, "cluster").withColumn(
        "block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")), "members")

    def forest(cells: DataFrame) -> DataFrame:
        return staged(cells.groupBy("cluster", "i", "j").applyInArrow(_cells(percent), _FORESTS), "forest")

    # First each block with itself and with block 0.
    near = members.withColumn("root", F.col("row")).withColumn("_c", F.array_distinct(F.when(
        F.col("block") == 0, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
            F.lit(0).alias("i"), k.alias("j")))).otherwise(F.array(
                F.struct(F.lit(0).alias("i"), F.col("block").alias("j")),
                F.struct(F.col("block").alias("i"), F.col("block").alias("j"))))))
    links = forest(near.select("*", F.inline("_c")).drop("_c"))
    roots = connected_components(links, name="roots")
    # Then other pairs of blocks, in clusters that are not yet one component.
    open_ = members.filter("blocks > 2")
    if not open_.isEmpty():
        known = open_.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn(
            "root", F.coalesce("root", "row"))
        parted = known.groupBy("cluster").agg((F.min("root") != F.max("root")).alias("parted")).filter("parted")
        rest = known.join(parted.select("cluster"), "cluster", "left_semi").filter("block > 0").withColumn(
            "_c", F.transform(F.filter(F.sequence(F.lit(1), F.col("blocks") - 1), lambda k: k != F.col("block")),
                              lambda k: F.struct(F.least(k, F.col("block")).alias("i"),
                                                 F.greatest(k, F.col("block")).alias("j"))))
        more = forest(rest.select("*", F.inline("_c")).drop("_c"))
        roots = connected_components(links.unionByName(more), name="roots")

    heads_of = live.select("row", "n_shingles", "class_hi", "class_lo").join(
        classes.withColumnRenamed("row", "head"), ["n_shingles", "class_hi", "class_lo"])
    grouped = heads_of.join(roots.withColumnRenamed("node", "head"), "head", "left").select(
        "row", F.coalesce("root", "head").alias("group"))
    full = texts.select("row", "doc_id", "n_shingles").join(grouped, "row", "left").withColumn(
        "group", F.coalesce("group", "row"))
    if by_row:
        return full.select("row", "doc_id", "n_shingles", "group")
    named = full.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return full.join(named, "group").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
