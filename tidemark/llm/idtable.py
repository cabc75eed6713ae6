"""A vectorised hash table from 64-bit chunk hashes to lists of token ids, one per Python worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class IdTable:
    """Open addressing over NumPy arrays. `encode` gives the ids of one chunk; each chunk is encoded once.

    Holds at most `limit` chunks: a table that is full starts anew, which changes no result.
    """

    def __init__(self, encode: Callable[[bytes], list[int]], limit: int = 1 << 20):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << 16, np.uint64)
        self.values = np.zeros(1 << 16, np.int32)
        self.size = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.first = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int32)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int32)
        todo, slot, mask = np.arange(len(hashes)), self._slots(hashes), len(self.keys) - 1
        want = hashes
        while len(todo):
            key = self.keys[slot]
            hit = key == want
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (key != 0)
            todo, want, slot = todo[on], want[on], (slot[on] + 1) & mask
        return out

    def _place(self, hashes: np.ndarray, values: np.ndarray) -> None:
        slot, mask = self._slots(hashes), len(self.keys) - 1
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]
            won = free & (self.keys[slot] == hashes)
            self.values[slot[won]] = values[won]
            hashes, values, slot = hashes[~won], values[~won], (slot[~won] + 1) & mask

    def _add(self, hashes: np.ndarray, lists: list[list[int]]) -> None:
        n, total = self.size + len(hashes), self.used + sum(map(len, lists))
        while n > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        while total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        count = np.fromiter(map(len, lists), np.int32, len(lists))
        self.count[self.size : n] = count
        self.first[self.size : n] = self.used + np.cumsum(count) - count
        self.ids[self.used : total] = np.fromiter((i for x in lists for i in x), np.uint32, total - self.used)
        self.size, self.used = n, total
        if 2 * n > len(self.keys):
            old = self.keys != 0
            keys, values = self.keys[old], self.values[old]
            self.keys, self.values = np.zeros(4 * len(self.keys), np.uint64), np.zeros(4 * len(self.values), np.int32)
            self._place(keys, values)
        self._place(hashes, np.arange(n - len(hashes), n, dtype=np.int32))

    def entries(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Entry of each chunk raw[start:end]; unknown chunks are encoded and added."""
        hashes = np.maximum(hashes, np.uint64(1))
        if self.size > self.limit:
            self._clear()
        out = self.find(hashes)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            order = miss[np.argsort(hashes[miss], kind="stable")]
            sorted_hashes = hashes[order]
            new = np.ones(len(order), bool)
            new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
            at = order[new]
            data = raw.tobytes()
            self._add(hashes[at], [self.encode(data[a:b]) for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            out[miss] = self.find(hashes[miss])
        return out

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries, one after the other, and the number of ids before each entry (and in all)."""
        count = self.count[entries].astype(np.int64)
        before = np.zeros(len(entries) + 1, np.int64)
        np.cumsum(count, out=before[1:])
        at = np.repeat(self.first[entries] - before[:-1], count) + np.arange(before[-1])
        return self.ids[at], before
