"""Token ids of all documents, in id order, in files coded by ``ans``; and their reader.

A file set is a folder with two parquet tables, so any file system that Spark
writes will do and a task that is run twice leaves one copy: ``table`` (the shared
frequencies) and ``segments``, one row per segment: its place, its documents with
their numbers of ids, the coded words, and the directory with a checkpoint and checksums
for each block.
"""
from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm import ans
from cohortry.llm import hashing as H
from cohortry.llm.staging import new_folder, remove

_HELD = "part int, doc_id long, start long, ids binary"
_SEGMENT = "part int, start long, n_ids long, doc_ids binary, lengths binary, words binary, directory binary"
_NO_ID = np.iinfo(np.int64).min
_CACHE = 1_000_000  # pieces that a worker keeps
_SLOT_BITS = 20
_SLOTS = 1 << _SLOT_BITS
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
# Kinds of bytes: letters 1, digits 2, marks 3, the apostrophe 4, all others 0; and which of them part where they meet.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A], _KIND[0x27] = 2, 4
_MEETS = np.array([a > 0 < b and min(a, 3) != min(b, 3) and (a, b) != (4, 1) for a in range(5) for b in range(5)])
# White space of Unicode beyond ASCII in UTF-8, as first, second and third bytes.
_SPACES = ((0xC2, (0x85, 0xA0), None), (0xE1, (0x9A,), (0x80,)), (0xE2, (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)),
           (0xE2, (0x81,), (0x9F,)), (0xE3, (0x80,), (0x80,)))
_tokenizers: dict = {}


class _Pieces(dict):
    """Pieces of texts by number, with their ids one after another; a new piece waits for ``learn``."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.new = tokenizer, []
        self.special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        self.line_break = tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.ids, self.ends, self.sizes = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.filled = 0
        # Whether a text can be cut at all: byte-level BPE without changes to the text before.
        rules = json.loads(tokenizer.to_str())
        first = rules.get("pre_tokenizer") or {}
        self.cuts = rules.get("normalizer") is None and first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get(
            "use_regex", True)
        # Short pieces by their bytes, as two numbers; a slot holds the last one that fell on it.
        self.head, self.tail = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.uint64)
        self.number = np.full(_SLOTS, -1, np.int64)

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number

    def learn(self) -> None:
        """Ids of the new pieces, in their order.

        Pieces without inner white space go to the tokenizer as one text with line
        breaks between, which are tokens of their own; the others one by one.
        """
        known = len(self) - len(self.new)
        joined, alone = [], []
        for i, p in enumerate(self.new):
            (joined if _one_word(p) else alone).append(i)
        sizes = np.zeros(len(self.new), np.int64)
        found: list[np.ndarray] = []
        if joined:
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(self.new[i] for i in joined)],
                                                            add_special_tokens=False)[0].ids, "<u4")
            breaks = np.flatnonzero(ids == self.line_break)
            if len(breaks) != len(joined) - 1:
                raise RuntimeError("the tokenizer does not cut at line breaks")
            sizes[joined] = np.diff(np.r_[-1, breaks, len(ids)]) - 1
            found.append(np.delete(ids, breaks))
        for i in alone:
            own = self.tokenizer.encode(self.new[i], add_special_tokens=False).ids
            sizes[i] = len(own)
            found.append(np.array(own, "<u4"))
        order = np.array(joined + alone)  # as ``found`` has them
        begin = self.filled
        ends = np.empty(len(order), np.int64)
        at = np.cumsum(sizes[order])
        total = int(at[-1])
        if begin + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (begin + total))
        if len(self) > len(self.ends):
            self.ends, self.sizes = np.resize(self.ends, 2 * len(self)), np.resize(self.sizes, 2 * len(self))
        ends[order] = begin + at
        self.ids[begin:begin + total] = np.concatenate(found)
        self.ends[known:len(self)], self.sizes[known:len(self)] = ends, sizes
        self.filled = begin + total
        self.new = []

    def look_up(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of the pieces ``data[start:start + size]``; no piece holds a zero byte."""
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        words = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
        head, tail = words[start] & _MASKS[np.minimum(size, 8)], words[start + 8 * (size > 8)] & _MASKS[np.clip(size - 8, 0, 8)]
        mixed = H.mixed(head * _ODD + tail)
        slot = (mixed >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        out = self.number[slot]
        missed = np.flatnonzero((self.head[slot] != head) | (self.tail[slot] != tail) | (out < 0) | (size > 16))
        if len(missed):
            raw = data.tobytes()
            short = missed[size[missed] <= 16]
            # Equal short pieces once; those that only share the hash one by one.
            _, first, back = np.unique(mixed[short], return_index=True, return_inverse=True)
            named = short[first]
            numbers = np.array([self[raw[a:a + n].decode()] for a, n in zip(start[named].tolist(), size[named].tolist())], np.int64)
            out[short] = numbers[back]
            same = (head[short] == head[named][back]) & (tail[short] == tail[named][back])
            for i in [*short[~same].tolist(), *missed[size[missed] > 16].tolist()]:
                out[i] = self[raw[start[i]:start[i] + size[i]].decode()]
            self.head[slot[named]], self.tail[slot[named]], self.number[slot[named]] = head[named], tail[named], numbers
        return out

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after another, and how many each has."""
        sizes = self.sizes[numbers]
        shift = np.repeat(self.ends[numbers] - np.cumsum(sizes), sizes)
        return self.ids[shift + np.arange(len(shift))], sizes


def _pieces(path: str) -> _Pieces:
    """What this Python worker has found so far; begun anew when it grows large."""
    if path not in _tokenizers or len(_tokenizers[path]) > _CACHE:
        from tokenizers import Tokenizer
        _tokenizers[path] = _Pieces(Tokenizer.from_file(path))
    return _tokenizers[path]




def _one_word(piece: str) -> bool:
    """No white space but a blank at the beginning."""
    word = piece[1:] if piece[:1] == " " else piece
    return word.split() == [word]


def _text_of(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that hold some of the places."""
    return np.unique(np.searchsorted(offsets, places, side="right") - 1)


def _loose(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with white space other than single blanks and line breaks between words, or with control characters."""
    blank = (data == 0x20) | (data == 0x0A)
    double = np.flatnonzero(blank[1:] & blank[:-1])
    filled = np.flatnonzero(np.diff(offsets))
    edges = np.r_[offsets[:-1][filled], offsets[1:][filled] - 1]
    bad = [np.flatnonzero((data < 0x20) & (data != 0x0A)), double, double + 1, edges[blank[edges]]]
    # White space beyond ASCII, by its first byte in UTF-8.
    padded = np.r_[data, np.zeros(2, np.uint8)]
    for lead, second, third in _SPACES:
        at = np.flatnonzero(data == lead)
        hit = np.isin(padded[at + 1], second) if third is None else (padded[at + 1] == second[0]) & np.isin(padded[at + 2], third)
        bad.append(at[hit])
    return _text_of(np.concatenate(bad), offsets)


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a byte-level BPE always begins a new word in texts that are not loose.

    That is before a blank, around a line break, and where letters, digits and marks meet, but for
    a letter after an apostrophe. Letters are those of ASCII and Latin-1; next to others nothing is cut.
    """
    cut = data == 0x20
    line = data == 0x0A
    cut |= line
    cut[1:] |= line[:-1]
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    cut[1:] |= _MEETS[kind[:-1] * 5 + kind[1:]]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return cut


def _blank_pieces(text: str) -> list[str]:
    """Cuts of a text with any white space: before blanks that a non-space follows."""
    first, *rest = text.split(" ")
    out = [first]
    for x in rest:
        if x and not x[0].isspace():
            out.append(" " + x)
        else:
            out[-1] += " " + x
    return out


def encode_texts(path: str, texts: pa.Array | list[str], end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts, each with ``end`` after it, one after another; and how many each has.

    Words of a text are independent of each other in byte-level BPE, so each
    different piece is given to the tokenizer once; pieces are told by their bytes. Texts with a special token, and
    all texts of another kind of tokenizer, go to it as they are.
    """
    known = _pieces(path)
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    data, offsets = H.text_bytes(texts)
    n = len(offsets) - 1
    raw = data.tobytes()
    special = np.zeros(0, np.int64)
    for token in known.special:
        at, found = -1, []
        while (at := raw.find(token.encode(), at + 1)) >= 0:
            found.append(at)
        if found:
            special = np.union1d(special, _text_of(np.array(found), offsets))
    apart = set(special.tolist()) if known.cuts else set(range(n))
    loose = [i for i in _loose(data, offsets).tolist() if i not in apart] if len(data) else []
    plain = np.ones(n, bool)
    plain[[*apart, *loose]] = False
    cut = _cuts(data, offsets) if len(data) else np.zeros(0, bool)
    start = np.flatnonzero(cut)
    size = np.diff(np.r_[start, len(data)])
    owner = np.searchsorted(offsets, start, side="right") - 1
    mine = plain[owner]
    numbers = known.look_up(data, start[mine], size[mine])
    counts = np.bincount(owner[mine], minlength=n) if n else np.zeros(0, np.int64)
    if loose:
        parts, last = [], 0
        ends = np.cumsum(counts)
        for i in loose:
            own = [known[x] for x in _blank_pieces(raw[offsets[i]:offsets[i + 1]].decode())]
            parts += [numbers[last:ends[i]], np.array(own, np.int64)]
            last, counts[i] = ends[i], len(own)
        numbers = np.concatenate([*parts, numbers[last:]])
    if known.new:
        known.learn()
    ids, sizes = known.of(numbers)
    ends = np.r_[0, np.cumsum(sizes)][np.cumsum(counts)] if n else np.zeros(0, np.int64)
    parts, last, closing = [], 0, np.array([end], "<u4")
    for i, b in enumerate(ends.tolist()):
        parts.append(np.array(known.tokenizer.encode(raw[offsets[i]:offsets[i + 1]].decode(), add_special_tokens=False).ids, "<u4")
                     if i in apart else ids[last:b])
        parts.append(closing)
        last = b
    return (np.concatenate(parts) if parts else ids), np.array([len(x) + 1 for x in parts[::2]], np.int64)


def _tokenize(path: str, narrow: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in H.slices(batch, "text"):
                ids, sizes = encode_texts(path, piece.column("text"))
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.record_batch([
                    pa.array(np.full(len(sizes), part, np.int32)), piece.column("doc_id"), pa.array(starts, pa.int64()),
                    pa.array([x.tobytes() for x in np.split(ids.astype(narrow), np.cumsum(sizes)[:-1])], pa.binary())], names=["part", "doc_id", "start", "ids"])
    return run


def _count(narrow: str, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                ids = np.frombuffer(b"".join(batch.column("ids").slice(a, 256).to_pylist()), narrow)
                total += np.bincount(ids, minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])
    return run


def _segments(table: np.ndarray, narrow: str, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ans.Coder(table)
        names = [x.split()[0] for x in _SEGMENT.split(", ")]
        held: list = []

        def packed() -> pa.RecordBatch:
            parts, docs, starts, ids = zip(*held)
            lengths = np.array([len(x) for x in ids], "<u4")
            words, directory = coder.encode(np.concatenate(ids).astype(np.int64))
            return pa.record_batch([
                pa.array([parts[0]], pa.int32()), pa.array([starts[0]], pa.int64()), pa.array([int(lengths.sum())], pa.int64()),
                *[pa.array([x], pa.binary()) for x in (
                    np.array([_NO_ID if x is None else x for x in docs], "<i8").tobytes(), lengths.tobytes(), words, directory)],
            ], names=names)

        size = 0
        for batch in batches:
            for part, doc, start, ids in zip(*[batch.column(c).to_pylist() for c in ("part", "doc_id", "start")],
                                             batch.column("ids")):
                ids = np.frombuffer(ids.as_buffer(), narrow)
                # A segment holds documents that follow each other in one part.
                if held and (size + len(ids) > segment_ids or held[-1][0] != part or held[-1][2] + len(held[-1][3]) != start):
                    yield packed()
                    held, size = [], 0
                held.append((part, doc, start, ids))
                size += len(ids)
        if held:
            yield packed()
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                      part_rows: int = 5000, segment_ids: int = 1 << 20) -> None:
    """Writes the ids of all texts in ascending id order (null ids first, null texts empty).

    The vocabulary's counts over all documents make the shared table. Rows that
    repeat an id, also very many, go by a hash of their text; no rows give empty tables.
    """
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    narrow = "<u2" if vocabulary <= 1 << 16 else "<u4"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = max(1, -(-rows.count() // part_rows))
    order = [F.asc_nulls_first("doc_id"), F.col("hash"), F.col("at")]
    ranged = rows.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("at")).repartitionByRange(
        parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    stage = new_folder(spark, "ids")
    ranged.mapInArrow(_tokenize(tokenizer, narrow), _HELD).write.option("compression", "zstd").parquet(stage)
    held = spark.read.schema(_HELD).parquet(stage)
    counts = np.zeros(vocabulary, np.int64)
    for r in held.select("ids").mapInArrow(_count(narrow, vocabulary), "id long, n long").groupBy("id").agg(
            F.sum("n").alias("n")).collect():  # one row per id of the vocabulary
        counts[r["id"]] = r["n"]
    table = ans.shared_table(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(table)], "id int, frequency int").coalesce(1).write.parquet(
        f"{path}/table")
    held.mapInArrow(_segments(table, narrow, segment_ids), _SEGMENT).write.option(
        "compression", "none").parquet(f"{path}/segments")
    remove(spark, stage)


def _read(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ans.Coder(table)
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for k in range(batch.num_rows):
                take = lambda c, kind: np.frombuffer(columns[c][k].as_buffer(), kind)  # noqa: B023, E731
                ids = coder.decode(columns["words"][k].as_py(), columns["directory"][k].as_py()).astype("<u4")
                lengths = take("lengths", "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                docs = take("doc_ids", "<i8")
                crc = [zlib.crc32(ids[b - n:b]) for b, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.record_batch([
                    pa.array(np.full(len(docs), columns["part"][k].as_py(), np.int32)),
                    pa.array(docs, pa.int64(), mask=docs == _NO_ID),
                    pa.array(columns["start"][k].as_py() + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the files."""
    rows = spark.read.parquet(f"{path}/table").orderBy("id").collect()  # one per id of the vocabulary
    table = np.array([r["frequency"] for r in rows], np.int64)
    segments = spark.read.schema(_SEGMENT).parquet(f"{path}/segments")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = segments.drop("n_ids").mapInArrow(
        _read(table), "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(base, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
