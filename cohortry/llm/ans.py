"""Static range asymmetric numeral coding of token ids with one shared frequency table.

A segment is a run of whole documents. Its ids are cut into blocks that are coded
independently, each by several interleaved lanes, so numpy decodes all blocks of a
segment side by side. The directory of a segment has a checkpoint per block: where its
words begin, the lanes' last states and checksums of its words and its ids.
"""
from __future__ import annotations

import zlib

import numpy as np

BITS = 20  # frequencies add up to 2**BITS
_LOW = np.uint64(1) << np.uint64(31)
LANES = 64
BLOCK = 16384


def shared_table(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that add up to ``2**bits``, 1 at least for every id that occurs."""
    total = 1 << bits
    counts = np.asarray(counts, np.float64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used):
        share = counts[used] / counts.sum() * (total - len(used))
        out[used] = 1 + np.floor(share).astype(np.int64)
        rest = total - int(out.sum())
        out[used[np.argsort(-(share - np.floor(share)), kind="stable")[:rest]]] += 1
    return out


class Coder:
    def __init__(self, table: np.ndarray, bits: int = BITS):
        self.bits = np.uint64(bits)
        self.mask = np.uint64((1 << bits) - 1)
        self.frequency = np.asarray(table, np.uint64)
        self.start = (np.cumsum(self.frequency) - self.frequency).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(table), dtype=np.uint32), np.asarray(table))

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """``(words, directory)`` of one segment."""
        blocks = max(1, -(-len(ids) // BLOCK))
        steps = BLOCK // LANES
        padded = np.full(blocks * BLOCK, ids[-1] if len(ids) else 0, np.int64)
        padded[:len(ids)] = ids
        grid = padded.reshape(blocks, steps, LANES)
        state = np.full((blocks, LANES), _LOW, np.uint64)
        out, spilled = np.empty((steps, blocks, LANES), np.uint32), np.empty((steps, blocks, LANES), bool)
        for t in range(steps - 1, -1, -1):
            f, s = self.frequency[grid[:, t]], self.start[grid[:, t]]
            full = state >= f << (np.uint64(63) - self.bits)
            spilled[t], out[t] = full, state.astype(np.uint32)
            state = np.where(full, state >> np.uint64(32), state)
            q = state // f
            state = (q << self.bits) + (state - q * f) + s
        words = [out[:, b][spilled[:, b]] for b in range(blocks)]  # as they are read: by step, then lane
        directory = np.zeros(blocks, [("at", "<u8"), ("words", "<u4"), ("ids", "<u4"), ("crc_words", "<u4"),
                                      ("crc_ids", "<u4"), ("state", "<u8", (LANES,))])
        directory["words"] = [len(w) for w in words]
        directory["at"] = np.cumsum(directory["words"]) - directory["words"]
        directory["ids"] = np.minimum(BLOCK, len(ids) - np.arange(blocks) * BLOCK)
        directory["crc_words"] = [zlib.crc32(w.astype("<u4").tobytes()) for w in words]
        directory["crc_ids"] = [zlib.crc32(ids[b * BLOCK:(b + 1) * BLOCK].astype("<u4").tobytes()) for b in range(blocks)]
        directory["state"] = state
        return np.concatenate(words).astype("<u4").tobytes(), directory.tobytes()

    def decode(self, words: bytes, directory: bytes, blocks: slice = slice(None)) -> np.ndarray:
        """Ids of the chosen blocks; raises when a checksum does not fit."""
        held = np.frombuffer(directory, [("at", "<u8"), ("words", "<u4"), ("ids", "<u4"), ("crc_words", "<u4"),
                                         ("crc_ids", "<u4"), ("state", "<u8", (LANES,))])[blocks]
        stream = np.frombuffer(words, "<u4")
        for d in held:
            if zlib.crc32(stream[int(d["at"]):int(d["at"]) + int(d["words"])].tobytes()) != d["crc_words"]:
                raise ValueError("a block's words do not fit their checksum")
        state, at = held["state"].copy(), held["at"].astype(np.int64)
        stream = np.append(stream, np.uint32(0)).astype(np.uint64)
        steps = BLOCK // LANES
        grid = np.empty((len(held), steps, LANES), np.uint32)
        for t in range(steps):
            slot = state & self.mask
            ids = self.symbol[slot]
            grid[:, t] = ids
            state = self.frequency[ids] * (state >> self.bits) + slot - self.start[ids]
            short = state < _LOW
            order = np.cumsum(short, axis=1)
            place = np.minimum(at[:, None] + order - 1, len(stream) - 1)
            state = np.where(short, (state << np.uint64(32)) | stream[place], state)
            at += order[:, -1]
        flat = grid.reshape(len(held), BLOCK)
        out = [flat[b, :n] for b, n in enumerate(held["ids"])]
        for x, crc in zip(out, held["crc_ids"]):
            if zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()) != crc:
                raise ValueError("a block's ids do not fit their checksum")
        return np.concatenate(out)
