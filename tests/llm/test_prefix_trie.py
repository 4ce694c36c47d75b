"""The conversation trie against prefixes listed in plain Python."""
from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cohortry.llm.double_array import DoubleArray, dense_ids
from cohortry.llm.prefix_trie import conversation_trie, ends_digest, numbered_turns, with_group_heads
from cohortry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def brute_paths(rows):
    """conv_id -> list of (role, text), turns that share a number by their md5."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            md5 = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), md5, role, text))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}


def brute_rebuilt(own):
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def brute_nodes(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(paths.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        value = (len(who) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += value
            leaves[node[:d]] += not children[node]
    return sorted(
        (who[0], len(node), members[node[:-1]][0] if node else None, len(who), len(children[node]), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()) for node, who in members.items())


def nodes_of(spark, paths, **options):
    rows = [(c, i, hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest(), len(t.encode()))
            for c, turns in paths.items() for i, (r, t) in enumerate(turns)]
    trie = conversation_trie(spark.createDataFrame(rows, "conv_id long, pos long, key string, n_bytes long"),
                             spark.createDataFrame([(c,) for c in paths], "conv_id long"), **options)
    none = hashlib.sha256(b"").hexdigest()
    got = trie.nodes.join(ends_digest(trie.ends, 2), "end_id", "left").collect()
    return sorted((*(r[f] for f in FIELDS), r["ends_sha256"] or none) for r in got)


def key(row):
    return tuple((x is not None, x) for x in row)


def test_double_array_holds_what_was_packed():
    draw = np.random.default_rng(1)
    paths = sorted({tuple(draw.integers(0, 40, draw.integers(0, 7))) for _ in range(3000)})
    size = np.array([len(p) for p in paths])
    flat = np.array([x for p in paths for x in p], np.int64)
    first = np.cumsum(size) - size
    path = np.repeat(np.arange(len(paths)), size)
    ids = dense_ids(flat[:, None], np.arange(len(flat)) - first[path], path)
    assert len(set(ids)) == 40 and {(a, b) for a, b in zip(flat, ids)}.__len__() == 40
    trie = DoubleArray(ids, first, size, np.zeros(len(paths), np.int64))
    nodes = {p[:d] for p in paths for d in range(1, len(p) + 1)}
    assert (trie.check >= 0).sum() == len(nodes)
    assert sum(len(np.unique(slot)) for _, _, slot in trie.walk()) == len(nodes)


@pytest.mark.parametrize("block,shard", [(128, 500_000), (2, 500_000), (3, 7), (1, 1), (128, 5)])
def test_trie_matches_listed_prefixes(spark, block, shard):
    draw = random.Random(block * 100 + shard)
    paths = {}
    for c in range(-3, 60):
        turns = [(draw.choice("ua"), draw.choice(["x", "yé", ""])) for _ in range(draw.choice([0, 1, 2, 4, 9]))]
        paths[c] = turns
    for c in range(60, 70):  # copies of one conversation, some longer
        paths[c] = [("u", "x")] * 8 + ([("a", str(c % 3))] * (c % 4))
    assert sorted(nodes_of(spark, paths, block_turns=block, shard_turns=shard), key=key) == sorted(brute_nodes(paths), key=key)


def test_numbering_of_odd_turns(spark):
    draw = random.Random(3)
    rows = [(draw.choice([0, 1, 5, 6, 9, -1, None]), draw.choice([None, 0, 1, 2, 3]), draw.choice([None, "user", "a"]),
             draw.choice([None, "", "x", "y" * 3000, "é"])) for _ in range(400)]
    rows += [(7, None, "user", "same")] * 300  # one conversation with most rows, none of them numbered
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "'k' AS key", "2 AS part").repartition(6)
    numbered, convs = numbered_turns(turns)
    trie = conversation_trie(with_group_heads(numbered, convs), convs.select("conv_id"), 16, 100)
    got = [tuple(r) for r in trie.nodes.select(*FIELDS).collect()]
    want = [r[:-1] for r in brute_nodes(brute_rebuilt(brute_paths(rows)))]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_table(spark):
    numbered, convs = numbered_turns(spark.createDataFrame([], SCHEMA))
    assert conversation_trie(with_group_heads(numbered, convs), convs.select("conv_id")).nodes.count() == 0


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in QUERIES["op11_prefix_trie"](spark, SF).collect()]
    assert sorted(got, key=key) == sorted(brute_nodes(brute_rebuilt(brute_paths(rows))), key=key)
