"""Double-array tries in numpy: BASE and CHECK over dense ids."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_WINDOW = 256


def dense_ids(tokens: np.ndarray, depth: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Ids 0.. of the tokens (columns of integers), in order of first appearance level by level.

    Children that a node sees first thus have neighbouring ids, which pack well.
    """
    if not len(tokens):
        return np.zeros(0, np.int64)
    order = np.lexsort(tokens.T[::-1])
    begins = np.r_[True, (tokens[order][1:] != tokens[order][:-1]).any(axis=1)]
    group = np.empty(len(tokens), np.int64)
    group[order] = np.cumsum(begins) - 1
    place = depth * (int(path[-1]) + 1) + path
    first = np.minimum.reduceat(place[order], np.flatnonzero(begins))
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[group]


class DoubleArray:
    """A trie of sorted paths: the child of slot ``s`` by ``id`` is ``base[s] + id`` where ``check`` says ``s``.

    Paths stand in sorted order, so those through one node are neighbours. Slots
    ``0 .. roots - 1`` are the roots, of which each path names its own.
    """

    def __init__(self, ids: np.ndarray, first: np.ndarray, size: np.ndarray, root: np.ndarray):
        self.ids, self.first, self.size, self.root = ids, first, size, root
        self.roots = int(root.max()) + 1 if len(root) else 0
        capacity = self.roots + 2 * len(ids) + _WINDOW + 1
        self.base, self.check = np.zeros(capacity, np.int64), np.full(capacity, -1)
        self.used = np.zeros(capacity, bool)
        self.used[:self.roots] = True
        self._low = self._open = self.roots
        state = root.copy()
        for d in range(int(size.max()) if len(size) else 0):
            live = np.flatnonzero(size > d)
            parent, token = state[live], ids[first[live] + d]
            new = np.r_[True, (parent[1:] != parent[:-1]) | (token[1:] != token[:-1])]
            slots = self._children(parent[new], token[new])
            state[live] = slots[np.cumsum(new) - 1]

    def _reserve(self, top: int) -> None:
        if top >= len(self.check):
            grow = max(top + 1 - len(self.check), len(self.check) // 2)
            self.base = np.r_[self.base, np.zeros(grow, np.int64)]
            self.check = np.r_[self.check, np.full(grow, -1)]
            self.used = np.r_[self.used, np.zeros(grow, bool)]

    def _fit(self, ids: np.ndarray) -> int:
        """The lowest base, from the last one found on, at which all ids meet free slots."""
        low, span = int(ids.min()), int(ids.max() - ids.min())
        at_once = max(1, min(_WINDOW, (1 << 16) // len(ids)))
        start = self._low
        while True:
            self._reserve(start + _WINDOW + span)
            free = np.flatnonzero(~self.used[start:start + _WINDOW]) + start - low
            for a in range(0, len(free), at_once):
                bases = free[a:a + at_once]
                fits = np.flatnonzero(~self.used[bases[:, None] + ids[None, :]].any(axis=1))
                if len(fits):
                    self._low = start
                    return int(bases[fits[0]])
            start += _WINDOW

    def _children(self, parent: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Slots of the children of one level; those of one parent stand together."""
        begin = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        count = np.diff(np.r_[begin, len(parent)])
        slots = np.empty(len(parent), np.int64)
        for b, n in zip(begin[count > 1].tolist(), count[count > 1].tolist()):
            ids = token[b:b + n]
            base = self._fit(ids)
            self.base[parent[b]] = base
            slots[b:b + n] = base + ids
            self.used[base + ids] = True
        # A single child can go to any free slot, so those fill the holes.
        single = begin[count == 1]
        if len(single):
            self._reserve(self._open + len(single) + int(self.used[self._open:].sum()))
            free = np.flatnonzero(~self.used[self._open:])[:len(single)] + self._open
            slots[single] = free
            self.base[parent[single]] = free - token[single]
            self.used[free] = True
            self._open = int(free[-1]) + 1
        self.check[slots] = parent
        return slots

    def walk(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Level by level ``(paths, parent slot, slot)``, as BASE leads and CHECK confirms."""
        state = self.root.copy()
        for d in range(int(self.size.max()) if len(self.size) else 0):
            live = np.flatnonzero(self.size > d)
            parent = state[live]
            slot = self.base[parent] + self.ids[self.first[live] + d]
            if not (self.check[slot] == parent).all():
                raise RuntimeError("the double array lost a child")
            state[live] = slot
            yield live, parent, slot
