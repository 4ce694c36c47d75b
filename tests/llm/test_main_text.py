"""Main texts of pages: planted pages, the given ones, and the suffix array against counted runs."""
from __future__ import annotations

import contextlib
import html
import io
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from cohortry.llm import host_suffixes as X
from cohortry.llm.page_blocks import page_blocks
from cohortry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def kept(text):
    read = X._read(text)
    return read[0] if read[0] is not None else "\n".join(read[1])


@pytest.mark.parametrize("page,want", [
    ("<article><h1>A &amp;amp; B</h1><p>one\n two&nbsp;three<p><b>four<br><p>five</article><footer>x</footer>", "A &amp; B\none two three\nfour\nfive"),
    ("<body><header>Site</header><nav><ul><li>Home<li>News</ul></nav><main><p>Text</p><aside>Side</aside><p>More</p></main></body>", "Text\nMore"),
    ("<div class='cookie-notice'>We use</div><div id=content><p>Body <i>it</i>alic</p></div><div class='ad'>Buy</div>", "Body italic"),
    ("<article><p>Text</p><section class=comments><h3>Comments</h3><p>First!</p></section><p>End</p></article>", "Text\nEnd"),
    ("<article><p>Text</p><article><p>a comment</p></article></article>", "Text"),
    ("<article><header><h1>Title</h1><p>by me</p></header><p>Text</p><form>mail <input> <button>ok</button></form><footer>f</footer></article>", "Title\nText"),
    ("<script>var t='<article>no</article>';</script><style>p{}</style><article>Yes<!-- <p>no</p> --> it is</article>", "Yes it is"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul></article>", "a\nb\nc\nd\ne"),
    ("<form action=x><nav>menu</nav><article><p>In a form</p></article></form>", "In a form"),
    ("<div class='layout has-sidebar'><article class='post'><p>Kept</p><div hidden>no</div></article></div>", "Kept"),
    ("<article><p>1 < 2 &lt;b&gt; &#233;&#x41; <span class=ad>buy</span> end<div", "1 < 2 <b> éA\nend"),
    ("<p>No marks</p><div>at all</div>", "No marks\nat all"),
    ("", ""), ("<article></article><p>outside</p>", "outside"), ("<!-- never closed <p>x", ""), ("plain text", "plain text"),
    ("<title>T</title><noscript><p>enable</p></noscript><p>Body</p></div></p></article>", "Body"),
    ("<p class='ad'>buy<p>text", "text"), ("<div title='a > b' class=\"x\">text</div>", "text"),
])
def test_parts_of_pages(page, want):
    assert kept(page) == want


def test_long_and_broken_pages_take_linear_time():
    for page in ("<div>" * 50_000 + "x" + "</section>" * 50_000, "<a title=\"" * 20_000, "<" * 200_000, "<p class='ad" * 20_000, "&amp;" * 100_000):
        page_blocks(page)


def brute_runs(streams, least):
    """Runs of RUN tokens and the pages of one host that hold them, by counting; copies of a page count once."""
    held = defaultdict(set)
    for i, (tokens, _) in enumerate(streams):
        for a in range(len(tokens) - X.RUN + 1):
            held[tuple(tokens[a:a + X.RUN])].add(i)
    return {g: who for g, who in held.items() if len(who) >= least}


def brute_covered(streams, least):
    def marks(tokens, runs):
        out = [False] * len(tokens)
        for a in range(len(tokens) - X.RUN + 1):
            if tuple(tokens[a:a + X.RUN]) in runs:
                out[a:a + X.RUN] = [True] * X.RUN
        return out

    runs = brute_runs(streams, least)
    own = {i for i, (tokens, total) in enumerate(streams) if 2 * sum(marks(tokens, runs)) <= total}
    runs = {g for g, who in runs.items() if len(who & own) >= least}
    return [marks(tokens, runs) for tokens, _ in streams]


@pytest.mark.parametrize("bucket", [1 << 20, 150])
def test_boilerplate_matches_counted_runs(spark, bucket):
    draw = random.Random(bucket)
    menu, foot = [f"m{i}" for i in range(12)], [f"f{i}" for i in range(9)]
    copy = [f"c{i}" for i in range(80)]
    rows, hosts = [], defaultdict(list)
    for i in range(60):
        host = draw.choice(["a", "a", "a", "b", "c"])
        own = [f"{i}x{j}" for j in range(draw.choice([0, 3, 40, 120]))]
        body = copy[:70] + own[:5] if i % 7 == 0 else own
        tokens = draw.choice([menu, menu, []]) + body + draw.choice([foot, []])
        rows.append((f"http://{host}/{i}", host, tokens))
    for _, host, tokens in rows:
        if (tokens, len(tokens)) not in hosts[host]:
            hosts[host].append((tokens, len(tokens)))
    table = spark.createDataFrame([(i, u, " ".join(t)) for i, (u, _, t) in enumerate(rows + rows[:5])], SCHEMA)
    got = {r.page_id: r for r in X.main_text(table, bucket_tokens=bucket).collect()}
    assert len(got) == len(rows) + 5
    found = 0
    for host, streams in hosts.items():
        for (tokens, _), marks in zip(streams, brute_covered(streams, 3)):
            mine = [i for i, (_, h, t) in enumerate(rows) if h == host and t == tokens]
            for i in mine:
                assert got[i].boilerplate_tokens == sum(marks)
                assert got[i].text == ("" if 2 * sum(marks) > len(tokens) else " ".join(tokens))
            found += sum(marks)
    assert found > 100


def test_blocks_of_unmarked_pages(spark):
    """A menu and a footer without any mark go, the unique rest stays; copies of a page keep their text."""
    draw = random.Random(1)
    text = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    menu = "<div>Home</div><div>News of the day</div><div>Sport and games for all</div><div>Our imprint and contact</div>"
    foot = "<div>All rights reserved by the makers of this page since long ago</div>"
    bodies = [[text(40), text(9), f"short{i}"] for i in range(6)] + [[text(300)]] * 5
    rows = [(i, f"https://u@h.example/{i}", menu + "".join(f"<div>{b}</div>" for b in body) + foot + ("" if i < 6 else f"<div>{i}</div>"))
            for i, body in enumerate(bodies)]
    got = {r.page_id: r.text for r in X.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, body in enumerate(bodies):
        assert got[i] == "\n".join([*body, *([] if i < 6 else [str(i)])])


def test_odd_rows(spark):
    rows = [(1, None, None), (None, None, "<p>a</p>"), (2, "no url", ""), (3, "http://h/", " \n "), (3, "http://h/", " \n "),
            (4, "http://h/x", "<p>" + "w " * 200_000)]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'t' AS text", "1 AS host", "2 AS page", "3 AS tokens")
    got = sorted(((r.page_id or 0, r.text) for r in X.main_text(pages).collect()))
    assert got == [(0, "a"), (1, ""), (2, ""), (3, ""), (3, ""), (4, ("w " * 200_000).strip())]
    assert X.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark):
    """The given pages mark their article; its blocks are the headline and the paragraphs."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op13_main_text"](spark, SF).collect()}
    assert len(got) == len(pages)
    for r in pages:
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("<(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert QUERIES["op13_main_text"](spark, "/root/testdata/sf0.01").filter(F.col("boilerplate_tokens") > 0).count() > 0


@pytest.mark.parametrize("bucket,whole", [(1 << 20, 1 << 20), (400, 1 << 20), (400, 400)])
def test_articles_pass_the_suffix_array(spark, bucket, whole):
    """Marked articles are in the streams too: one that several pages repeat goes where a page has another of its own."""
    teaser = [f"t{i}" for i in range(14)]
    licence = [f"l{i}" for i in range(10)]
    rows, streams, wants = [], [], []
    for i in range(12):
        own = [f"{i}x{j}" for j in range(90)]
        blocks = [[f"n{j}" for j in range(9)], teaser, own, licence] if i < 9 else [[f"n{j}" for j in range(9)], own, licence]
        cards = f"<article class=card><p>{' '.join(teaser)}</p></article>" if i < 9 else ""
        rows.append((i, f"http://h/{i}", f"<nav>{' '.join(blocks[0])}</nav>{cards}<article><p>{' '.join(own)}</p><p>{' '.join(licence)}</p></article>"))
        streams.append((sum(blocks, []), sum(map(len, blocks))))
        wants.append(" ".join(own) + "\n" + " ".join(licence))
    for i in range(12, 15):  # an article that all its pages share stays
        rows.append((i, f"http://g/{i}", f"<article>{' '.join(teaser)}</article><div class=comments>" + " ".join(f"{i}c{j}" for j in range(90)) + "</div>"))
        wants.append(" ".join(teaser))
    got = {r.page_id: r for r in X.main_text(spark.createDataFrame(rows, SCHEMA), bucket_tokens=bucket, whole_tokens=whole).collect()}
    assert [got[i].text for i in range(15)] == wants
    assert [got[i].boilerplate_tokens for i in range(15)] == [sum(m) for m in brute_covered(streams, 3)] + [14] * 3
    assert got[0].boilerplate_tokens == 9 + 14 + 10


@pytest.mark.parametrize("bucket,whole", [(150, 300), (150, 0), (60, 0)])
def test_large_hosts_match_counted_runs(spark, bucket, whole):
    """Runs of a host in many buckets are counted over all of them, at the least number of pages too."""
    draw = random.Random(bucket + whole)
    shared = [[f"s{k}_{j}" for j in range(draw.randint(8, 12))] for k in range(30)]
    streams = []
    for i in range(50):
        tokens = []
        for run in draw.sample(shared, 3):
            tokens += run + [f"{i}u{draw.random()}" for _ in range(draw.choice([10, 30]))]
        streams.append((tokens, len(tokens)))
    pages = spark.createDataFrame([(i, "http://h/", " ".join(t)) for i, (t, _) in enumerate(streams)] * 2, SCHEMA).repartition(3)
    got = X.main_text(pages, bucket_tokens=bucket, whole_tokens=whole).collect()
    marks = brute_covered(streams, 3)
    assert len(got) == 100 and sum(map(sum, marks)) > 500
    assert all(r.boilerplate_tokens == sum(marks[r.page_id]) for r in got)


def test_pages_are_written_once(spark, monkeypatch):
    """The pages of a large host pass one shuffle, which every step reads, and are staged in no file."""
    kept_columns = []
    staged = X.staged
    monkeypatch.setattr(X, "staged", lambda df, name: (kept_columns.extend(df.columns), staged(df, name))[1])
    shared = " ".join(f"s{j}" for j in range(12))
    texts = [" ".join(f"{i}u{j}" for j in range(30)) for i in range(40)]
    pages = spark.createDataFrame([(i, f"http://{h}/{i}", f"<p>{shared}</p><p>{t}</p>") for i, t in enumerate(texts) for h in "gh"] * 2, SCHEMA)
    found = X.main_text(pages.repartition(3), bucket_tokens=400, whole_tokens=800)
    got = found.collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted([*enumerate(texts)] * 4)
    assert {r.boilerplate_tokens for r in got} == {12}
    assert not {"html_", "packed", "text"} & set(kept_columns)
    with contextlib.redirect_stdout(io.StringIO()) as said:
        found.explain("formatted")
    plan = said.getvalue().split("== Final Plan ==")[1].split("== Initial Plan ==")[0]
    assert (plan.count("MapInArrow ("), plan.count("ReusedExchange (")) == (1, 3)


def test_copies_travel_once_with_all_ids():
    """Copies of a page in a task are one row; other hosts and other pages are not mixed up."""
    rows = [(i, f"u{i}", i % 2, "<p>one two</p>" if i % 3 else f"<p>{i}</p>") for i in range(30)]
    c0, c1, host, text = zip(*rows)
    batch = pa.record_batch([pa.array(c0), pa.array(c1), pa.array(host), pa.array([None if h else -7 for h in host], pa.int64()), pa.array(text)],
                            names=["c0", "c1", "host_hash", "bucket", "html_"])
    out = pa.Table.from_batches(X._parse(5)(iter([batch.slice(0, 11), batch.slice(11)]))).to_pylist()
    assert len(out) == len({(h, t) for _, _, h, t in rows}) == len({r["page"] for r in out})
    back = [(i["c0"], i["c1"], r["host_hash"], "<p>" + X._lines(r["packed"], r["n_bytes"]).decode() + "</p>") for r in out for i in r["ids"]]
    assert sorted(back) == rows
    assert all(r["bucket"] == (r["page"] % 5 if r["host_hash"] else -7) for r in out)


@pytest.mark.parametrize("bits,parts", [(64, 1), (64, 7), (26, 5), (40, 3000)])
def test_names_by_ranges_match_counts(bits, parts):
    """Names of several buckets, the largest and smallest too, are counted over all and go back to those that have them."""
    draw = np.random.default_rng(bits + parts)
    values = np.r_[draw.integers(0, 2**64, 60, np.uint64), np.array([0, 2**64 - 1], np.uint64)] >> np.uint64(64 - bits)
    held = {b: (x := draw.choice(values, 50), draw.integers(0, 4, len(x))) for b in range(4)}
    total = defaultdict(int)
    for names, n in held.values():
        for v in np.unique(names):
            total[v] += min(3, int(n[names == v].sum()))
    sent = pa.concat_tables([X._by_ranges((pa.scalar(b),), names, n, 3, bits, parts) for b, (names, n) in held.items()])
    assert 0 <= min(sent["part"].to_pylist()) and max(sent["part"].to_pylist()) < parts
    found = pa.concat_tables([X._frequent(3)((pa.scalar(p),), sent.filter(pa.compute.equal(sent["part"], p))) for p in sorted(set(sent["part"].to_pylist()))])
    for b, (names, _) in held.items():
        got = X._names(found.filter(pa.compute.equal(found["bucket"], b)))
        assert sorted(got.tolist()) == sorted({int(v) for v in names if total[v] >= 3})
    assert {c for c in found["counts"].to_pylist()} == {b""}
