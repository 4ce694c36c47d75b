"""The trie of conversation prefixes, as double arrays over ranges of sorted paths.

Every conversation is a path of turns, a turn the md5 of its role and text. Paths are cut
into fragments of ``BLOCK`` turns, equal ones counted once, and dealt by range, so
a task holds neighbours in the order of the trie: prefix shards, whatever is hot. Each run of about
``SHARD_TURNS`` turns is one shard, packed as BASE and CHECK over dense turn ids and traversed. Only the
nodes on a shard's first and last path can reach into other shards; their aggregates are
merged over all shards, everything else is final where it was counted.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.double_array import DoubleArray, dense_ids
from cohortry.llm.staging import staged

BLOCK = 128
SHARD_TURNS = 500_000
_PATHS = ("block long, start string, key string, sizes array<long>, n long, conv long, own_root long, end_id string, "
          "more boolean, x_children long, x_leaves long, x_saved long")
_NODES = ("block long, start string, id string, parent_id string, above array<string>, shared boolean, root boolean, "
          "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
          "saved_tokens long, bytes long, more boolean, end_id string")


@dataclass(frozen=True)
class Trie:
    """``nodes``: one row per node, known by ``conv_id`` (its smallest member) and ``depth``; ``end_id`` where members end.

    ``ends``: ``(end_id, conv_id)`` of every conversation.
    """

    nodes: DataFrame
    ends: DataFrame


# --- turns ----------------------------------------------------------------------
def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with their number within the conversation, as far as this partition knows."""
    part, last, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
        if not len(conv):
            continue
        begin = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        size = np.diff(np.r_[begin, len(conv)])
        place = np.arange(len(conv)) - np.repeat(begin, size)
        if conv[0] == last:
            place[:size[0]] += at
        last, at = conv[-1], int(place[-1]) + 1
        yield pa.record_batch(
            [batch.column("conv_id"), pa.array(np.full(len(conv), part, np.int32)), pa.array(place),
             batch.column("key"), batch.column("n_bytes")], names=["conv_id", "part", "pos", "key", "n_bytes"])


def numbered_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, pos, key, n_bytes)`` with turns numbered from 0, and ``(conv_id, n_turns)``.

    By turn, null first; turns of one number stand in the order of the md5 of role
    and text. Null roles and texts are empty; rows without a conversation are left out.
    A conversation may be spread over many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), key.alias("key"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("at"))
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("key"), F.col("at")]
    placed = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "n_bytes").mapInArrow(
        _number, "conv_id long, part int, pos long, key string, n_bytes long"), "turns")
    spans = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = spans.select("conv_id", "part", before.alias("before")).filter("before > 0")
    numbered = placed.join(F.broadcast(shift), ["conv_id", "part"], "left").select(  # at most one row per partition
        "conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "n_bytes")
    return numbered, spans.groupBy("conv_id").agg(F.sum("n").alias("n_turns"))


def with_group_heads(numbered: DataFrame, convs: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Rows of rebuilt conversations: the first h turns of conversation ``c - c % group``, then c's own after its first h.

    h is the crc32 of the decimal c modulo ``most``; a head is fetched per
    conversation, at most ``most - 1`` rows, and own rows stay where they are.
    """
    def head(conv: str) -> Column:
        return F.crc32(F.col(conv).cast("string")) % most

    def base(conv: str) -> Column:
        return F.col(conv) - F.col(conv) % group

    sizes = convs.select("conv_id", base("conv_id").alias("base"), head("conv_id").alias("h")).join(
        convs.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("has")), "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("taken"))
    heads = numbered.filter((F.col("pos") < most - 1) & (F.col("conv_id") % group == 0)).withColumnRenamed(
        "conv_id", "base").join(sizes, "base").filter("pos < taken").select("conv_id", "pos", "key", "n_bytes")
    gaps = sizes.filter("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("gap"))
    own = numbered.filter(F.col("pos") >= head("conv_id")).join(gaps, "conv_id", "left").select(
        "conv_id", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("pos"), "key", "n_bytes")
    return heads.unionByName(own)


# --- shards ---------------------------------------------------------------------
def _node_id(block: int, start: str, key: str) -> str:
    return hashlib.md5(f"{block}/{start}/{key}".encode()).hexdigest()


def _shard(rows: pa.Table, block_turns: int) -> pa.RecordBatch:
    """All nodes of one run of sorted paths."""
    get = {c: rows.column(c).combine_chunks() for c in rows.schema.names}
    n_paths = rows.num_rows
    block = get["block"].to_numpy(zero_copy_only=False)
    starts = get["start"].to_pylist()
    keys = get["key"].to_pylist()
    size = np.array([len(k) // 32 for k in keys], np.int64)
    first = np.cumsum(size) - size
    digests = bytes.fromhex("".join(keys))
    tokens = (np.frombuffer(digests, ">u8") if digests else np.zeros(0)).reshape(-1, 2).astype(np.uint64)
    path = np.repeat(np.arange(n_paths), size)
    ids = dense_ids(tokens, np.arange(len(path)) - first[path], path)
    turn_bytes = get["sizes"].flatten().to_numpy(zero_copy_only=False)
    fresh = np.array([True, *[(a, s) != (b, t) for a, b, s, t in zip(block[1:], block[:-1], starts[1:], starts[:-1])]])
    root = np.cumsum(fresh) - 1
    trie = DoubleArray(ids, first, size, root)
    slots = len(trie.check)

    def number(name: str) -> np.ndarray:
        return get[name].fill_null(0).to_numpy(zero_copy_only=False)

    weight, conv_of = number("n"), number("conv")
    n, conv, last_bytes, depth = (np.zeros(slots, np.int64) for _ in range(4))
    any_path = np.zeros(slots, np.int64)
    begin = np.flatnonzero(fresh)
    n[:trie.roots] = np.add.reduceat(weight, begin)
    named = get["own_root"].take(pa.array(begin))
    conv[:trie.roots] = np.where(named.is_null().to_numpy(zero_copy_only=False), np.minimum.reduceat(conv_of, begin),
                                 named.fill_null(0).to_numpy(zero_copy_only=False))
    depth[:trie.roots] = block[begin] * block_turns
    any_path[:trie.roots] = begin
    end, levels = root.copy(), []
    for d, (live, parent, slot) in enumerate(trie.walk()):
        at = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        nodes = slot[at]
        n[nodes], conv[nodes] = np.add.reduceat(weight[live], at), np.minimum.reduceat(conv_of[live], at)
        last_bytes[nodes], depth[nodes] = turn_bytes[first[live[at]] + d], block[live[at]] * block_turns + d + 1
        any_path[nodes] = live[at]
        end[live] = slot
        levels.append((nodes, parent[at]))
    # Nodes on the first and the last path may belong to other shards as well.
    edges = [[root[p]] for p in (0, n_paths - 1)]
    for live, _, slot in trie.walk():
        for i, p in enumerate((0, n_paths - 1)):
            spot = np.searchsorted(live, p)
            if spot < len(live) and live[spot] == p:
                edges[i].append(slot[spot])
    shared = np.zeros(slots, bool)
    shared[np.concatenate(edges)] = True
    more = np.zeros(slots, bool)
    more[end[get["more"].to_numpy(zero_copy_only=False)]] = True
    children, leaves, saved = (np.zeros(slots, np.int64) for _ in range(3))
    for total, name in ((children, "x_children"), (leaves, "x_leaves"), (saved, "x_saved")):
        np.add.at(total, end, number(name))
    for nodes, parent in levels:
        np.add.at(children, parent, ~shared[nodes])
    every = np.concatenate([np.arange(trie.roots), *[x for x, _ in levels]])
    has = np.zeros(slots, bool)
    has[np.concatenate([np.zeros(0, np.int64), *[p for _, p in levels]])] = True
    own = every[~shared[every]]
    saved[own] += (n[own] - 1) * last_bytes[own]
    leaves[own] += ~has[own] & ~more[own]
    for nodes, parent in reversed(levels):
        np.add.at(saved, parent, saved[nodes])
        np.add.at(leaves, parent, leaves[nodes])
    is_root = every < trie.roots
    above_id, above = {}, {}
    for i, p in enumerate((0, n_paths - 1)):
        names = [_node_id(int(block[p]), starts[p], keys[p][:32 * d]) for d in range(len(edges[i]))]
        for d, slot in enumerate(edges[i]):
            above_id[int(slot)], above[int(slot)] = names[d], names[:d]
    parent = np.where(is_root, 0, trie.check[every])
    to_shared = ~is_root & shared[parent]
    ending = np.full(slots, -1)
    ends_here = get["end_id"].is_valid().to_numpy(zero_copy_only=False)
    ending[end[ends_here]] = np.flatnonzero(ends_here)
    spot = ending[every]
    mark = shared[every]
    listed = every.tolist()
    return pa.record_batch([
        pa.array(block[any_path[every]]),
        pa.array([starts[any_path[s]] if s < trie.roots else None for s in listed], pa.string()),
        pa.array([above_id.get(s) for s in listed], pa.string()),
        pa.array([above_id[p] if x else None for p, x in zip(parent.tolist(), to_shared.tolist())], pa.string()),
        pa.array([above.get(s) for s in listed], pa.list_(pa.string())),
        pa.array(mark), pa.array(is_root), pa.array(conv[every]), pa.array(depth[every]),
        pa.array(conv[parent], pa.int64(), mask=is_root | to_shared), pa.array(n[every]), pa.array(children[every]),
        pa.array(leaves[every]), pa.array(saved[every]), pa.array(last_bytes[every]), pa.array(more[every]),
        get["end_id"].take(pa.array(np.maximum(spot, 0), mask=spot < 0)),
    ], names=[x.split()[0] for x in _NODES.split(", ")])


def _shards(block_turns: int, shard_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for batch in batches:
            at = 0
            ends = np.cumsum([len(k) // 32 for k in batch.column("key").to_pylist()])
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + max(1, shard_turns - turns), side="right")))
                held.append(batch.slice(at, to - at))
                turns += int(ends[to - 1]) - before
                at = to
                if turns >= shard_turns or at < batch.num_rows:
                    yield _shard(pa.Table.from_batches(held), block_turns)
                    held, turns = [], 0
        if held:
            yield _shard(pa.Table.from_batches(held), block_turns)
    return run


def _nodes_of(paths: DataFrame, block_turns: int, shard_turns: int) -> DataFrame:
    """All nodes of the paths, fragment roots included, with the aggregates of their subtrees."""
    order = ["block", "start", "key"]
    names = [x.split()[0] for x in _PATHS.split(", ")]
    found = staged(paths.select(*names).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _shards(block_turns, shard_turns), _NODES), "trie_nodes")
    # Few: two paths of a shard.
    merged = found.filter("shared").groupBy("id").agg(
        F.first("block").alias("block"), F.max("start").alias("start"), F.max("parent_id").alias("parent_id"),
        F.first("above").alias("above"), F.first("root").alias("root"), F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.first("bytes").alias("bytes"),
        F.bool_or("more").alias("more"), F.max("end_id").alias("end_id"))
    below = merged.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("also")).filter("id IS NOT NULL")
    merged = staged(merged.join(below, "id", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("also", F.lit(0))).drop("also"), "trie_merged")
    own = merged.select(
        F.explode(F.concat("above", F.array("id"))).alias("id"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
        ((F.col("n_children") == 0) & ~F.col("more")).cast("long").alias("leaf"))
    added = own.groupBy("id").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    merged = merged.join(added, "id").withColumns({
        "saved_tokens": F.col("saved_tokens") + F.col("saved"), "n_leaves": F.col("n_leaves") + F.col("leaf")})
    heads = merged.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("head"))
    fields = ["block", "start", "root", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
              "saved_tokens", "end_id"]
    # Rows without a key get one of their own, so they are dealt evenly.
    inner = found.filter("NOT shared").withColumn(
        "parent_id", F.coalesce("parent_id", F.concat_ws("/", F.lit("own"), "conv_id", "depth"))).join(
        heads, "parent_id", "left").withColumn("parent_conv_id", F.coalesce("head", "parent_conv_id"))
    outer = merged.join(heads, "parent_id", "left").withColumnRenamed("head", "parent_conv_id")
    return inner.select(*fields).unionByName(outer.select(*fields))


# --- the whole ------------------------------------------------------------------
def _fragments(rows: DataFrame, convs: DataFrame, block_turns: int) -> DataFrame:
    """Conversations cut into blocks: ``(conv_id, block, start, key, sizes, next_start)``; every conversation has block 0."""
    marked = rows.select("conv_id", "pos", "key", "n_bytes").unionByName(convs.select(
        "conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("n_bytes")))
    turn = F.when(F.col("pos") >= 0, F.struct("pos", "key", "n_bytes"))
    blocks = staged(marked.groupBy("conv_id", F.floor(F.greatest("pos", F.lit(0)) / block_turns).alias("block")).agg(
        F.array_sort(F.collect_list(turn)).alias("t")).select(
        "conv_id", "block", F.array_join(F.transform("t", lambda x: x["key"]), "").alias("key"),
        F.transform("t", lambda x: x["n_bytes"]).alias("sizes")), "blocks")
    # Where a fragment hangs: a sum over the blocks before it, so no block waits for another.
    long = blocks.filter("block > 0").select("conv_id").distinct()
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum(F.xxhash64(F.lit(seed), "block", "key").cast("decimal(20,0)")).over(before).cast("string") for seed in (11, 12)]
    chain = blocks.join(long, "conv_id", "left_semi").select("conv_id", "block", F.concat_ws(",", *sums).alias("start")).filter("block > 0")
    return blocks.join(chain, ["conv_id", "block"], "left").join(
        chain.select("conv_id", (F.col("block") - 1).alias("block"), F.col("start").alias("next_start")), ["conv_id", "block"], "left"
    ).withColumn("start", F.coalesce("start", F.lit("")))


def conversation_trie(rows: DataFrame, convs: DataFrame, block_turns: int = BLOCK, shard_turns: int = SHARD_TURNS) -> Trie:
    """The trie of ``rows`` (``conv_id, pos, key, n_bytes``; ``pos`` from 0 without gaps) of all ``convs`` (``conv_id``).

    A conversation without rows is a member of the root only. Equal conversations are
    one path with a weight; empty tables give no nodes. A conversation of more than ``block_turns`` turns
    continues in fragments that hang below the node at their start; the totals of fragments go
    up along one sum per conversation, not round by round.
    """
    fragments = staged(_fragments(rows, convs, block_turns), "fragments")
    end_id = F.md5(F.concat_ws("/", F.col("block").cast("string"), "start", "key"))
    paths = staged(fragments.groupBy("block", "start", "key").agg(
        F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("conv"),
        F.max("next_start").alias("next_start"), F.count_if(F.col("next_start").isNull()).alias("ending")).select(
        "*", F.when(F.col("ending") > 0, end_id).alias("end_id"), F.col("next_start").isNotNull().alias("more")), "paths")
    hung = paths.filter("more").select(F.col("next_start").alias("from"), F.col("conv").alias("own_root"))
    # Rows without a key get one of their own, so they are dealt evenly.
    paths = paths.withColumn("from", F.when(F.col("block") > 0, F.col("start")).otherwise(F.concat(F.lit("/"), "key"))).join(
        hung, "from", "left").drop("from")
    none = [F.lit(None).cast("long").alias(f"x_{c}") for c in ("children", "leaves", "saved")]
    lower = _nodes_of(paths.filter("block > 0").select("*", *none), block_turns, shard_turns).filter("root").select(
        "start", "n_children", "n_leaves", "saved_tokens")
    # A fragment's totals count once, for the smallest of its conversations, and for all that is above it.
    links = fragments.filter("block > 0").select("conv_id", "block", "start")
    owners = links.groupBy("start").agg(F.min("conv_id").alias("owner")).join(lower, "start")
    rest = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    held = [F.sum(F.when(F.col("owner") == F.col("conv_id"), F.col(c)).otherwise(0)).over(rest).alias(a)
            for c, a in (("n_leaves", "x_leaves"), ("saved_tokens", "x_saved"))]
    extra = links.join(owners, "start").select("start", "n_children", *held).groupBy(F.col("start").alias("next_start")).agg(
        F.first("n_children").alias("x_children"), F.sum("x_leaves").alias("x_leaves"), F.sum("x_saved").alias("x_saved"))
    paths = paths.withColumn("next_start", F.coalesce("next_start", F.concat_ws("/", F.lit(""), "start", "key")))
    nodes = _nodes_of(paths.join(extra, "next_start", "left"), block_turns, shard_turns).filter("NOT root OR block = 0").drop(
        "block", "start", "root")
    ends = fragments.filter("next_start IS NULL").select(end_id.alias("end_id"), "conv_id")
    return Trie(nodes, ends)


# --- digests --------------------------------------------------------------------
def _joined(most: int):
    """Runs of ids of one end in a sorted partition as texts of at most ``most`` ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, convs = batch.column("end_id").to_pylist(), batch.column("conv_id").to_pylist()
            begin = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
            cut = [c for a, b in zip(begin, [*begin[1:], len(names)]) for c in range(a, b, most)]
            yield pa.record_batch([
                pa.array([names[a] for a in cut], pa.string()), pa.array([convs[a] for a in cut], pa.int64()),
                pa.array([",".join(map(str, convs[a:b])) for a, b in zip(cut, [*cut[1:], len(names)])], pa.string())],
                names=["end_id", "least", "ids"])
    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, state = None, None
    for batch in batches:
        names, out = batch.column("end_id").to_pylist(), []
        for name, ids in zip(names, batch.column("ids").to_pylist()):
            if name == last:
                state.update(b",")
            else:
                if last is not None:
                    out.append((last, state.hexdigest()))
                last, state = name, hashlib.sha256()
            state.update(ids.encode())
        yield pa.record_batch([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())],
                              names=["end_id", "ends_sha256"])
    if last is not None:
        yield pa.record_batch([pa.array([last], pa.string()), pa.array([state.hexdigest()], pa.string())],
                              names=["end_id", "ends_sha256"])


def ends_digest(ends: DataFrame, most: int = 10_000) -> DataFrame:
    """``(end_id, ends_sha256)``: the comma-joined ascending ids of the conversations of each end.

    Ids are joined to texts where they lie, by ranges that split a hot end; its digest then reads few rows.
    """
    order = ["end_id", "conv_id"]
    texts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _joined(most), "end_id string, least long, ids string")
    return texts.repartition("end_id").sortWithinPartitions("end_id", "least").mapInArrow(
        _hashed, "end_id string, ends_sha256 string")
