"""Main text of web pages: a suffix array of each host finds boilerplate, the page's marks check the rest.

The blocks of a page, its article among them, are a stream of tokens. The distinct streams of a host are
concatenated and their suffixes sorted; runs of ``RUN`` tokens or more that several pages repeat are
boilerplate, blocks that they cover go and the unique rest is kept. Where a page marks its article, the marked
elements in which something unique is left are taken whole and what stands outside them goes.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from cohortry.llm import hashing as H
from cohortry.llm.page_blocks import PLAIN, page_blocks
from cohortry.llm.staging import staged

RUN = 8
_BUCKET_TOKENS = 1 << 20
_WHOLE_TOKENS = 2 << 20
# About as many bytes of html make a token, never fewer than two.
_HTML_BYTES = 8
_WINDOW_BYTES = 16 << 20
_STREAM = "bucket long, host_hash long, page long, packed binary, n_bytes long, regions array<int>"
_ODD = H.mixed(np.arange(1, RUN + 1, dtype=np.uint64)) | np.uint64(1)


# --- pages ----------------------------------------------------------------------
def _lines(packed: bytes, n_bytes: int) -> bytes:
    """A page's blocks as lines; packed they take less space in shuffles than their tokens."""
    return pa.decompress(packed, n_bytes, "zstd", asbytes=True) if n_bytes else b""


def _read(html: str) -> tuple[str, list[str], list[int]]:
    """``(text, blocks, regions)``: what the page alone gives, all its blocks, and where each stands.

    Of a page with a marked article, ``regions`` are the numbers of its marked elements, else 0 for plain blocks; -1
    for blocks that stand apart or outside the article.
    """
    found = page_blocks(html)
    best = max((part for part, _, _ in found), default=PLAIN)
    blocks = [text for _, _, text in found]
    regions = [region if part == max(best, PLAIN) else -1 for part, region, _ in found]
    return _main(blocks, regions, np.zeros(0, bool)), blocks, regions


class _Window:
    """Distinct pages of some rows, each once with the ids of all its rows."""

    def __init__(self) -> None:
        self.number: dict[int, int] = {}
        self.pages: list[tuple] = []
        self.of: list[int] = []
        self.ids: list[pa.StructArray] = []
        self.n_bytes = 0

    def add(self, ids: pa.StructArray, pages: Iterator[tuple[int, int, int, bytes, list[int]]]) -> None:
        for bucket, host, page, lines, regions in pages:
            if page not in self.number:
                self.number[page] = len(self.pages)
                packed = pa.compress(lines, "zstd", asbytes=True) if lines else b""
                self.pages.append((bucket, host, page, packed, len(lines), regions))
                self.n_bytes += len(packed)
            self.of.append(self.number[page])
        self.ids.append(ids)
        self.n_bytes += ids.nbytes

    def rows(self) -> pa.RecordBatch:
        of = np.array(self.of, np.int64)
        ids = pa.concat_arrays(self.ids).take(pa.array(np.argsort(of, kind="stable")))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of))].astype(np.int32)), ids)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32())]
        return pa.record_batch([*[pa.array(x, t) for x, t in zip(zip(*self.pages), types)], lists],
                               names=[*[x.split()[0] for x in _STREAM.split(", ")], "ids"])


def _parse(buckets: int):
    """Pages as streams with their buckets; copies that come close to each other once, with all their ids."""
    def read(piece: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes, list[int]]]:
        for host, bucket, text in zip(*[piece.column(c).to_pylist() for c in ("host_hash", "bucket", "html_")]):
            _, blocks, regions = _read(text or "")
            lines = "\n".join(blocks).encode()
            name = blake2b(np.array([host, len(regions), *regions], np.int64).tobytes() + lines, digest_size=8).digest()
            page = int.from_bytes(name, "little", signed=True)
            yield page % buckets if bucket is None else bucket, host, page, lines, regions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = _Window()
        for batch in batches:
            for piece in H.slices(batch, "html_"):
                window.add(pa.StructArray.from_arrays([piece.column(c) for c in ("c0", "c1")], ["c0", "c1"]), read(piece))
                if window.n_bytes > _WINDOW_BYTES:
                    yield window.rows()
                    window = _Window()
        if window.pages:
            yield window.rows()
    return run


# --- suffixes -------------------------------------------------------------------
class _Streams:
    """The concatenated streams of a bucket; tokens of different hosts are different."""

    def __init__(self, rows: pa.Table):
        # Copies of a page in several rows count once.
        _, once, self.of = np.unique(rows.column("page").to_numpy(), return_index=True, return_inverse=True)
        rows = rows.select(["host_hash", "packed", "n_bytes", "regions"]).take(pa.array(once))
        self.regions = rows.column("regions")
        self.lines = lines = [_lines(*x) for x in zip(rows.column("packed").to_pylist(), rows.column("n_bytes").to_pylist())]
        tokens, first, _ = H.word_hashes(np.frombuffer(b"".join(lines), np.uint8), np.cumsum([0, *map(len, lines)]))
        self.first, self.size = first[:-1], np.diff(first)
        self.owner = np.repeat(np.arange(len(lines), dtype=np.int32), self.size)
        host = rows.column("host_hash").to_numpy().astype(np.int64).view(np.uint64)
        self.tokens = H.mixed(tokens ^ host[self.owner])
        # A run lies in one stream.
        self.whole = np.arange(len(tokens)) + RUN <= (self.first + self.size)[self.owner]

    def suffix_array(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of their first ``RUN`` tokens, by prefix doubling, and each place's rank."""
        rank = np.unique(self.tokens, return_inverse=True)[1].astype(np.int64)
        step = 1
        while step < RUN:
            after = np.r_[rank[step:], np.full(min(step, len(rank)), -1)] + 1
            rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64)
            step *= 2
        return np.argsort(rank, kind="stable"), rank

    def grams(self, at: np.ndarray) -> np.ndarray:
        """A name of the run that begins at each place, the same in every bucket."""
        out = np.zeros(len(at), np.uint64)
        for j in range(RUN):
            out += self.tokens[at + j] * _ODD[j]
        return H.mixed(out).view(np.int64)

    def covered(self, grams: np.ndarray) -> np.ndarray:
        """Which tokens lie in a run of ``grams``."""
        at = np.flatnonzero(self.whole)
        at = at[np.isin(self.grams(at), grams)]
        edge = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + RUN, -1)
        return np.cumsum(edge)[:-1] > 0

    def totals(self, marks: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner[marks], minlength=len(self.size))


_NAMES = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("first", pa.int64()), ("width", pa.int64()), ("size", pa.int64()),
                    ("packed", pa.binary()), ("counts", pa.binary())])


def _intervals(streams: _Streams) -> tuple[np.ndarray, np.ndarray]:
    """Runs as neighbours in the suffix array with one rank, and in how many pages each stands."""
    order, rank = streams.suffix_array()
    order = order[streams.whole[order]]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]])
    interval = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(order)]))
    new = np.r_[True, (interval[1:] != interval[:-1]) | (streams.owner[order][1:] != streams.owner[order][:-1])]
    return streams.grams(order[begin]), np.bincount(interval[new], minlength=len(begin))


def _pages_of(streams: _Streams, at: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs and in how many pages each stands, of the runs ``names`` that begin at the places ``at``."""
    pairs = np.unique(np.stack([names, streams.owner[at]]), axis=1)
    return np.unique(pairs[0], return_counts=True)


def _in_own(streams: _Streams, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs again, counted only in pages that are not mostly made of such runs (none: 0)."""
    grams = np.unique(grams)
    own = 2 * streams.totals(streams.covered(grams)) <= streams.size
    at = np.flatnonzero(streams.whole & own[streams.owner])
    names = streams.grams(at)
    hit = np.isin(names, grams)
    found, n = _pages_of(streams, at[hit], names[hit])
    out = np.zeros(len(grams), np.int64)
    out[np.searchsorted(grams, found)] = n
    return grams, out


def _cleaned(streams: _Streams, grams: np.ndarray, ids: pa.ChunkedArray) -> pa.Table:
    """The text of each row's page without the runs ``grams``, and how many of its tokens they cover."""
    marks = streams.covered(grams)
    texts = [_main(lines.decode().split("\n") if lines else [], regions, marks[a:a + n]) for lines, regions, a, n
             in zip(streams.lines, streams.regions.to_pylist(), streams.first.tolist(), streams.size.tolist())]
    return pa.table([ids, pa.array(texts, pa.string()).take(pa.array(streams.of)), pa.array(streams.totals(marks)[streams.of])],
                    names=["ids", "text", "n_covered"])


def _whole_hosts(least: int):
    """A bucket of whole hosts from its suffix array to its texts."""
    def run(rows: pa.Table) -> pa.Table:
        streams = _Streams(rows)
        grams, n = _intervals(streams)
        grams, n = _in_own(streams, grams[n >= least])
        return _cleaned(streams, grams[n >= least], rows.column("ids"))
    return run


def _all_hosts(least: int):
    """Texts of a bucket of whole hosts, and of a part of large ones by the runs found in all their buckets."""
    whole = _whole_hosts(least)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, grams: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return whole(rows)
        return _cleaned(_Streams(rows), _names(grams).view(np.int64), rows.column("ids"))
    return run


def _bytes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of the values, all lowest ones first."""
    return pa.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), "zstd", asbytes=True)


def _values(size: int, width: int, packed: bytes) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(packed, size * width, "zstd"), np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _packed(part: int, bucket: int, names: np.ndarray, n: np.ndarray | None) -> tuple:
    """Sorted names by their gaps, and how often each is there."""
    gaps = np.diff(names, prepend=names[:1])
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    first = int(names[:1].view(np.int64)[0])
    return part, bucket, first, width, len(names), _bytes(gaps, width), b"" if n is None else _bytes(n, 4)


def _unpacked(first: int, width: int, size: int, packed: bytes) -> np.ndarray:
    return np.cumsum(_values(size, width, packed), dtype=np.uint64) + np.array(first, np.int64).view(np.uint64)


def _lists(rows: pa.Table) -> list[np.ndarray]:
    return [_unpacked(*x) for x in zip(*[rows.column(c).to_pylist() for c in ("first", "width", "size", "packed")])]


def _names(rows: pa.Table) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *_lists(rows)])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(_NAMES)], schema=_NAMES)


def _by_ranges(key: tuple[pa.Scalar, ...], names: np.ndarray, n: np.ndarray, least: int, bits: int, parts: int) -> pa.Table:
    """A bucket's names of ``bits`` bits, by ranges, each with the number of pages that hold it (up to ``least``)."""
    order = np.argsort(names)
    names, n = names[order], n[order]
    at = np.flatnonzero(np.r_[True, names[1:] != names[:-1]][:len(names)])
    names, n = names[at], np.minimum(np.add.reduceat(n, at) if len(at) else n, least)
    part = (names >> np.uint64(max(0, bits - 32))) * np.uint64(parts) >> np.uint64(min(bits, 32))
    edge = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64)).tolist()
    return _table([_packed(i, key[0].as_py(), names[a:b], n[a:b]) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a])


def _frequent(least: int):
    """Names of a range that ``least`` pages or more of all buckets hold, for each bucket that has them."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        lists = _lists(rows)
        n = [_values(size, 4, x) for size, x in zip(rows.column("size").to_pylist(), rows.column("counts").to_pylist())]
        names, at = np.unique(np.concatenate(lists), return_inverse=True)
        kept = np.bincount(at, np.concatenate(n))[at] >= least
        found = [x[k] for x, k in zip(lists, np.split(kept, np.cumsum([len(x) for x in lists])[:-1]))]
        return _table([_packed(key[0].as_py(), b, x, None) for b, x in zip(rows.column("bucket").to_pylist(), found) if len(x)])
    return run


def _short_names(least: int, bits: int, parts: int):
    """The first bits of all runs of a bucket."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return _NAMES.empty_table()
        grams, n = _intervals(_Streams(rows))
        return _by_ranges(key, grams.view(np.uint64) >> np.uint64(64 - bits), n, least, bits, parts)
    return run


def _count_part(least: int, bits: int, parts: int):
    """The whole names of the runs with these first bits, and in how many pages of the bucket each stands."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, often: pa.Table) -> pa.Table:
        if not rows.num_rows or not often.num_rows:
            return _NAMES.empty_table()
        streams = _Streams(rows)
        at = np.flatnonzero(streams.whole)
        names = streams.grams(at)
        hit = np.isin(names.view(np.uint64) >> np.uint64(64 - bits), _names(often))
        names, n = _pages_of(streams, at[hit], names[hit])
        return _by_ranges(key, names.view(np.uint64), n, least, 64, parts)
    return run


def _count_in_own(least: int, parts: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, grams: pa.Table) -> pa.Table:
        if not rows.num_rows or not grams.num_rows:
            return _NAMES.empty_table()
        names, n = _in_own(_Streams(rows), _names(grams).view(np.int64))
        return _by_ranges(key, names.view(np.uint64), n, least, 64, parts)
    return run


def _schema(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in schema)


def _without_boilerplate(pages: DataFrame, least: int, bucket_tokens: int, whole_tokens: int) -> DataFrame:
    """``(ids, text, n_covered)``: the rows of a page (several rows may have the same one), its text, its covered tokens.

    ``pages``: ``(c0, c1, host, html_)``. A run is boilerplate where
    ``least`` pages of the host with different content hold it that are not themselves mostly made of repeated
    runs, so copies of one page do not turn its text into boilerplate. Hosts are dealt to buckets whole, one with
    more than a quarter of a bucket has its own; one with more than ``whole_tokens`` is dealt page by page, and its
    runs are counted over all its buckets. Tokens are guessed by the length of the html here, which moves no result.
    """
    sizes = pages.groupBy("host").agg(F.expr(f"coalesce(sum(octet_length(html_)), 0) div {_HTML_BYTES}").alias("n"))
    sizes = staged(sizes, "hosts")
    total, longest = sizes.agg(F.sum("n"), F.max("n")).first()
    buckets = max(1, -(-(total or 0) // bucket_tokens))
    large = sizes.filter(F.col("n") * 4 > bucket_tokens).select("host", (F.col("n") > whole_tokens).alias("spread"))  # at most four per bucket
    # Buckets of whole hosts are negative; those of spread hosts, from 0, go by the page.
    name = F.xxhash64("host")
    bucket = F.when(F.col("spread").isNull(), -1 - F.pmod(name, F.lit(buckets))).when(
        ~F.col("spread"), -1 - buckets - F.pmod(name, F.lit(1 << 62)))
    types = dict(pages.dtypes)
    ids = f"ids array<struct<c0:{types['c0']},c1:{types['c1']}>>"
    # One plan, so that the pages are written once: all steps below read the same shuffle.
    by = pages.join(F.broadcast(large), "host", "left").select("c0", "c1", name.alias("host_hash"), bucket.alias("bucket"), "html_").mapInArrow(
        _parse(buckets), f"{_STREAM}, {ids}").groupBy("bucket")
    cleaned = f"{ids}, text string, n_covered long"
    if (longest or 0) <= whole_tokens:
        return by.applyInArrow(_whole_hosts(least), cleaned)
    # First bits tell which runs may be in enough pages of all buckets, whole names which are; twice the buckets take a bit more.
    bits = min(64, 24 + buckets.bit_length())
    names, few = _schema(_NAMES), -(-buckets // 4)

    def frequent(counted: DataFrame) -> GroupedData:
        return counted.groupBy("part").applyInArrow(_frequent(least), names).groupBy("bucket")

    often = frequent(by.applyInArrow(_short_names(least, bits, buckets), names))
    repeated = frequent(by.cogroup(often).applyInArrow(_count_part(least, bits, few), names))
    own = frequent(by.cogroup(repeated).applyInArrow(_count_in_own(least, few), names))
    return by.cogroup(own).applyInArrow(_all_hosts(least), cleaned)


# --- the whole ------------------------------------------------------------------
def _main(blocks: list[str], regions: list[int], marks: np.ndarray) -> str:
    """The blocks that the boilerplate leaves, checked against the page's marks.

    A marked element in which a unique block is left is taken whole, so a passage that other pages repeat stays in it;
    one that is repeated throughout goes where another is left. Unique blocks outside the marked ones go.
    """
    at, unique = 0, []
    for text in blocks:
        n = text.count(" ") + 1
        unique.append(2 * int(marks[at:at + n].sum()) <= n)
        at += n
    left = {r for r, u in zip(regions, unique) if u and r > 0} or set(regions)
    return "\n".join(text for text, r, u in zip(blocks, regions, unique) if r > 0 and r in left or r == 0 and u)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 3,
              bucket_tokens: int = _BUCKET_TOKENS, whole_tokens: int = _WHOLE_TOKENS) -> DataFrame:
    """``(page_id, url, text, boilerplate_tokens)`` of every row; blocks of the text are joined by line breaks.

    Blocks that are mostly covered by the host's boilerplate go, the unique rest is kept. The marks of a page check this:
    its article is what an ``article``, else a ``main`` element, else one named like them holds, without
    the parts in it that stand apart (menus, notices, comments and so on); of several, those with a unique block. Null and empty
    pages, and pages without text, give an empty text; pages without a host are compared with each other. Repeated rows
    all stay and count once as evidence.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(page_id).alias("c0"), F.col(url).alias("c1"), host.alias("host"), F.col(html).cast("string").alias("html_"))
    found = _without_boilerplate(rows, least, bucket_tokens, whole_tokens)
    return found.select(F.explode("ids").alias("id"), "text", "n_covered").select(
        F.col("id.c0").alias("page_id"), F.col("id.c1").alias("url"), "text", F.col("n_covered").alias("boilerplate_tokens"))
