"""Jaccard join, fingerprints and decontamination."""
from __future__ import annotations

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import jaccard_join as J
from cohortry.llm.components import connected_components
from cohortry.llm.decontamination import contamination
from cohortry.llm.fingerprints import fingerprints_of_edits, kind_and_anchors, likeness_of_texts
from cohortry.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def brute_components(rows, percent=80, width=5):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append({tuple(w)} if 0 < len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def test_jaccard_on_odd_rows(odd, none):
    got = sorted((tuple(r) for r in J.jaccard_components(odd).collect()), key=str)
    assert got == brute_components([(r.doc_id, r.text) for r in odd.collect()])
    assert J.jaccard_components(none).count() == 0


def test_jaccard_in_small_blocks_and_ranges(spark, tmp_path):
    """Many near copies of one text, many blocks: the links between blocks count too."""
    draw = np.random.default_rng(3)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for d in range(150):
        text = list(base) if d % 3 else [f"u{d % 7}_{i}" for i in range(120)]
        for k in draw.integers(0, 120, int(draw.integers(0, 6))):
            text[k] = f"x{d}_{k}"
        rows.append((d, " ".join(text)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = J.jaccard_components(docs, block_texts=8, range_bytes=20_000, flush_tokens=3000)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components(rows)


def test_prefix_choice_needs_no_more_matches_than_the_prefix_has():
    for n, shared in ((10, 9), (100, 85), (5, 4), (1, 1)):
        needed = -(-n * 80 // 100)
        l, length = J.prefix_choice(n, needed, np.sort(np.random.default_rng(n).integers(2, 50, shared)), 8, 8.0)
        assert 1 <= l <= length <= shared


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert connected_components(links.filter("a > 1000")).count() == 0


@pytest.mark.parametrize("name", ["op3_jaccard_join", "op9_decontamination"])
def test_queries_match_sql(spark, name):
    df = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in df.select(*columns).collect())


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def test_contamination_of_short_items_and_odd_rows(spark, odd, none):
    items = [(1, " ".join(f"w{i}" for i in range(5, 19))), (2, "One, TWO"), (3, ""), (4, None), (None, "w30 w31 w32"),
             (6, "same"), (7, "w20 w21 w22 w23 w24 w25 w26 w27"), (8, "w1 w2 w3 w4 w5"), (9, "w1 w2 w3 w4 w5")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for r in odd.collect():
        w, hit, ids = plain(r.text), set(), set()
        for i, t in items:
            x = plain(t)
            m = min(13, len(x))
            for a in range(len(x) - m + 1 if m else 0):
                for b in range(len(w) - m + 1):
                    if w[b:b + m] == x[a:a + m]:
                        hit.update(range(b, b + m))
                        ids |= {str(i)} if i is not None else set()
        want.append((r.doc_id, len(w), len(hit), sorted(ids)))
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in contamination(odd, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert contamination(none, bench).count() == 0
    assert contamination(odd, bench.filter("item_id > 99")).agg(F.sum("n_hit")).first()[0] == 0


def test_fingerprints_of_edits(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in QUERIES["op8_fingerprints"](spark, SF).collect()}
    prints = {}
    for (d, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        assert got[d].n_chars == len(text)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, got[d].fingerprint) == got[d].fingerprint
        if text != after:
            assert got[d].near_edited > got[d].near_next
    assert np.mean([r.near_edited for r in got.values()]) > 0.5
    assert np.mean([r.near_next for r in got.values()]) < 0.05
    assert len(set(prints.values())) == len(prints)
    odd_rows = fingerprints_of_edits(odd, range_rows=4).collect()
    assert len(odd_rows) == odd.count() and all(0 <= r.near_edited <= 1 and r.fingerprint for r in odd_rows)
    assert fingerprints_of_edits(none).count() == 0


def test_likeness_across_length_limits(spark):
    """A text and its shorter copy on the other side of a limit have anchors in common."""
    word = lambda k: f"{k * 7919 % 9973:x}lorem"
    texts = {n: " ".join(word(k) for k in range(n))[:n] for n in (36, 44, 300, 390, 420, 900, 5000)}
    pairs = [(44, 36), (420, 390), (390, 300), (420, 300), (900, 390), (900, 420)]
    rows = spark.createDataFrame([(a, b, texts[a], texts[b]) for a, b in pairs], "n long, m long, x string, y string")
    x, y = F.col("x"), F.col("y")
    for r in rows.select("n", "m", likeness_of_texts(x, kind_and_anchors(x), y, kind_and_anchors(y)).alias("l"),
                         likeness_of_texts(y, kind_and_anchors(y), x, kind_and_anchors(x)).alias("back")).collect():
        assert r.l == r.back and r.l > 0.6 * r.m / r.n
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id BETWEEN 3000 AND 3100")
    near = {r.doc_id: r.near_edited for r in fingerprints_of_edits(docs).collect()}
    assert near[3051] > 0.4 and near[3098] > 0.4


def test_fingerprints_of_texts_without_spaces(spark):
    """Long texts without words, or with few, keep their likeness under an edit; so does one that gets words by it."""
    draw = np.random.default_rng(5)
    kanji = "".join(chr(0x4E00 + k) for k in draw.integers(0, 3000, 4000))
    base64 = "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghij0123456789+/"[k] for k in draw.integers(0, 48, 3000))
    prose = " ".join(f"word{k}" for k in draw.integers(0, 500, 600))
    few = (" " * 60).join(f"some{k}word" for k in range(9))
    rows = [(1, kanji), (2, prose), (3, base64), (4, prose[5:]), (5, few), (6, prose[9:])]
    got = {r.doc_id: r for r in fingerprints_of_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d in (1, 3, 5):
        assert got[d].near_edited > (0.2 if d == 5 else 0.4) and len(got[d].fingerprint) > 8 * 20
        assert got[d].near_next < 0.1
