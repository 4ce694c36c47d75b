"""Words of many texts at once as 64-bit hashes, in numpy over Arrow's own buffers."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_CHUNK = 1 << 20
_U = np.uint64
_rng = np.random.default_rng(20240501)
_BASE = int(_rng.integers(1 << 62, 1 << 63)) | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Kinds of bytes: words between white space.
_WORD = (~_SPACE).astype(np.uint8)
#: Digits, ASCII letters and all beyond ASCII are words.
PLAIN = np.zeros(256, np.uint8)
PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
#: Words as above, and marks as runs of their own.
WORDS_AND_MARKS = np.where(PLAIN == 1, 1, np.where(_SPACE | (np.arange(256) < 32), 0, 2)).astype(np.uint8)
# One odd value per byte, A-Z as a-z.
_BYTE = _rng.integers(1 << 62, 1 << 63, 256).astype(_U) | _U(1)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` of each at least."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, _CHUNK + (1 << 12))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``; one to one."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and where each text begins; a null is an empty text."""
    column = column.fill_null("").cast(pa.large_string()) if len(column) else pa.array([], pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def run_hashes(data: np.ndarray, inside: np.ndarray, begins: np.ndarray, value) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of elements, and where the runs begin.

    ``inside`` marks the elements of runs, ``begins`` the first of each, and
    ``value`` gives elements a 64-bit value. The hash is a polynomial over the
    run; the work goes in chunks that end between runs, so a very long text
    needs no more memory at a time.
    """
    starts = np.flatnonzero(begins)
    out = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _CHUNK)))
        lo, hi = starts[at], starts[to] if to < len(starts) else len(data)
        up, down = _power_tables(hi - lo)
        local = starts[at:to] - lo
        terms = value(data[lo:hi]) * up[:hi - lo]
        terms[~inside[lo:hi]] = 0
        out[at:to] = np.add.reduceat(terms, local) * down[local]
        at = to
    return mixed(out), starts


def run_begins(kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a run of one kind begins; kind 0 is between runs, and every text begins anew."""
    begins = kinds > 0
    begins[1:] &= kinds[1:] != kinds[:-1]
    heads = offsets[:-1][offsets[:-1] < len(kinds)]
    begins[heads] = kinds[heads] > 0
    return begins


def word_hashes(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = _WORD) -> tuple[np.ndarray, ...]:
    """``(hash of each word, each text's first word, where each word begins)``; ASCII case is folded.

    ``kinds`` gives each byte its kind; words are runs of one kind but 0, without
    more said everything that is not white space.
    """
    kind = kinds[data]
    hashes, starts = run_hashes(data, kind > 0, run_begins(kind, offsets), _BYTE.__getitem__)
    return hashes, np.searchsorted(starts, offsets), starts


_ORDER = mixed(np.arange(1, 65, dtype=_U)) | _U(1)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes per text, sorted within it, and each text's first one.

    A text with fewer words than ``width`` has its whole sequence as one
    shingle, a text without words none.
    """
    n = len(words)
    windows = np.zeros(max(0, n - width + 1), _U)
    for j in range(width):
        windows += words[j:n - width + 1 + j] * _ORDER[j] if len(windows) else windows
    windows = mixed(windows)
    parts, bounds = [], [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            part = np.sort(windows[a:b - width + 1])
            keep = np.empty(len(part), bool)
            keep[0] = True
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            parts.append(part[keep])
        elif b > a:
            short = np.array([b - a], _U) * _ORDER[63]
            short += (words[a:b] * _ORDER[:b - a]).sum(dtype=_U)
            parts.append(mixed(short))
        bounds.append(bounds[-1] + (len(parts[-1]) if b > a else 0))
    return np.concatenate(parts) if parts else np.zeros(0, _U), np.array(bounds)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about so many bytes of text, one row at least."""
    lengths = np.diff(text_bytes(batch.column(column))[1])
    ends, total = [], 0
    for i, x in enumerate(lengths.tolist()):
        if total and total + x > most_bytes:
            ends.append(i)
            total = 0
        total += x
    for a, b in zip([0, *ends], [*ends, len(lengths)]):
        if b > a:
            yield batch.slice(a, b - a)


def gram_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...], value,
                edge: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size ``(word, hash)`` of all grams of the words ``data[start:end]``, in order.

    With ``edge``, a mark before and after each word belongs to its grams.
    """
    lengths = ends - starts + 2 * edge
    total = int(lengths.sum())
    word = np.repeat(np.arange(len(starts)), lengths)
    first = np.cumsum(lengths) - lengths
    inner = np.arange(total) - first[word] - edge
    source = starts[word] + inner
    marks = (inner < 0) | (source >= ends[word])
    values = value(data[np.minimum(np.maximum(source, 0), len(data) - 1)]) if total else np.zeros(0, _U)
    values = np.where(marks, _ORDER[62], values)
    out = []
    for n in sizes:
        if total < n:
            out.append((np.zeros(0, np.int64), np.zeros(0, _U)))
            continue
        hashed = np.full(total - n + 1, n, _U)
        for j in range(n):
            hashed += values[j:total - n + 1 + j] * _ORDER[j]
        whole = word[:total - n + 1] == word[n - 1:]
        out.append((word[:total - n + 1][whole], mixed(hashed[whole])))
    return out


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]
