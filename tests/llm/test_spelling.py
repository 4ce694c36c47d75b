"""Spelling variants against all pairs of words in plain Python."""
from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import spelling as S
from cohortry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
FIELDS = ("word", "n", "n_near", "form", "form_n", "root")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_words(rows, least=6, occurrences=5, one_in=199):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                cut = h % len(run)
                run = run[:cut] + run[cut + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= occurrences}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_forms(words, times=5):
    near = {w: [] for w in words}
    by_cut = {}
    for w in words:  # two words are near only if they share a text with one letter left out
        for key in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by_cut.setdefault(key, []).append(w)
    pairs = {(a, b) for group in by_cut.values() for a in group for b in group if a < b}
    for a, b in pairs:
        if one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, words[w], len(near[w]), form[w], words.get(form[w]), root(w)) for w in words)


def test_words_of_odd_texts(spark):
    draw = random.Random(2)
    letters = "abcXYZéÀÿ×÷ø ,.Ā¿"
    rows = [(i, "".join(draw.choice(letters) for _ in range(draw.choice([0, 5, 300, 4000])))) for i in range(60)]
    rows += [(None, "letter " * 9), (None, None), (3, None), (4, "x" * 70_000 + " " + "y" * 400), (-5, "Éléphant élÉphant éléphant éléphant Éléphant")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'w' AS word", "3 AS n").repartition(3)
    for least, occurrences, one_in in ((6, 5, 199), (1, 1, 2), (3, 2, 7)):
        got = {r.word: r.n for r in S.word_table(docs, least, occurrences, one_in).collect()}
        assert got == brute_words(rows, least, occurrences, one_in)


def test_gram_matrices_lose_no_pair(spark):
    draw = random.Random(4)
    words = {"".join(draw.choice("abcé") for _ in range(draw.choice([1, 2, 5, 6, 7, 8]))): draw.choice([5, 6, 30, 200, 1100, 1100]) for _ in range(2500)}
    words |= {"w" * 3000: 5, "w" * 3001: 30, "w" * 2999 + "v": 30, "q" * 1025: 7, "q" * 1024: 7}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    # Blocks of many tiles.
    got = [tuple(r) for r in S.spelling_forms(rows, groups=2, tile_words=16).select(*FIELDS).collect()]
    want = brute_forms(words)
    assert sorted(got) == want
    assert max(len([1 for r in want if r[5] == x]) for x in words) > 3


def test_ties_go_to_the_first_in_order(spark):
    words = {"aaaaab": 5, "aaaaac": 50, "aaaaaa": 50, "aaaaaé": 50, "zzzzzzz": 9}
    got = {r.word: r for r in S.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["aaaaab"].form == got["aaaaab"].root == "aaaaaa" and got["aaaaab"].n_near == 3
    assert got["aaaaac"].form is None and got["aaaaac"].root == "aaaaac"
    assert got["zzzzzzz"].n_near == 0 and got["zzzzzzz"].form_n is None


def test_one_apart_by_letters():
    rows = lambda *x: np.array([list(w.encode()) for w in x])
    assert S._one_apart(rows("abcd", "abcd", "abcd"), rows("abxd", "abdc", "abcd")).tolist() == [True, False, False]
    assert S._one_apart(rows("abcd", "aaaa", "abcd"), rows("abxcd", "aaaaa", "xbcda")).tolist() == [True, True, False]


def test_no_rows(spark, none):
    assert S.spelling_forms(S.word_table(none)).count() == 0


def test_odd_documents(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert {r.word: r.n for r in S.word_table(odd, 1, 1).collect()} == brute_words(rows, 1, 1)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_spelling_variants"](spark, sf)
    assert sorted(map(tuple, got.select(*FIELDS).collect())) == brute_forms(brute_words(rows))
    assert got.filter(F.col("form").isNotNull()).count() > 0
