"""Hashes of words, pretokens and shingles of whole texts with NumPy, straight from Arrow string buffers.

A range's hash is a polynomial over its bytes modulo 2**64, read off running sums, so no Python object is
made per word; the sums run over slices of bounded size, cut where a range starts. Words are maximal runs
of bytes outside space, tab, LF, VT, FF and CR, after lower-casing A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers of the hash functions.
BASE = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
SLICE = 1 << 18
BLOCK_BYTES = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


_EXACT = mix(np.arange(1, 257, dtype=np.uint64))
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse ** i for i < n, grown as needed."""
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(max(n, SLICE + 1), base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def hash_ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, table: np.ndarray | None = None) -> np.ndarray:
    """Hash of each byte range; ranges are in order and don't overlap. `lower` folds A-Z; `table` gives a value for each byte."""
    out = np.empty(len(start), np.uint64)
    table = table if table is not None else _LOWER if lower else _EXACT
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        up, down = _power(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[raw[lo:hi]] * up[: hi - lo], out=sums[1:])
        a, b = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def column_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at, raw


def blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, offsets from 0 and bytes of consecutive rows, of bounded size but for single long texts."""
    at, raw = column_buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        last = min(n, max(row + 1, int(np.searchsorted(at, at[row] + BLOCK_BYTES, "right")) - 1))
        yield row, at[row : last + 1] - at[row], raw[at[row] : at[last]]
        row = last


def word_ranges(at: np.ndarray, raw: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word, a run without bytes of `space`; a text's end ends a word."""
    word = ~space[raw]
    before = np.empty(len(raw) + 1, bool)
    before[0], before[1:] = False, word
    before[at] = False
    after = np.empty(len(raw) + 1, bool)
    after[:-1], after[-1] = word, False
    after[at] = False
    return np.flatnonzero(word & ~before[:-1]), np.flatnonzero(word & ~after[1:]) + 1


def hash_runs(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run values[start:end] of 64-bit values; runs may overlap or be empty."""
    up, down = _power(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def text_words(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """Word hashes, in order, of each text of a string column."""
    for _, at, raw in blocks(column):
        start, end = word_ranges(at, raw)
        hashes = hash_ranges(raw, start, end, lower=True)
        bound = np.searchsorted(start, at)
        for k in range(len(at) - 1):
            yield hashes[bound[k] : bound[k + 1]]


def distinct(sorted_values: np.ndarray) -> np.ndarray:
    """Distinct values of a sorted array."""
    if len(sorted_values) < 2:
        return sorted_values
    keep = np.empty(len(sorted_values), bool)
    keep[0] = True
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=keep[1:])
    return sorted_values[keep]


def shingles_of_words(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; with fewer words, of all together; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(BASE) + words[i : n - k + 1 + i]
    return distinct(np.sort(mix(out)))


def text_shingles(column: pa.Array | pa.ChunkedArray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a string column."""
    for words in text_words(column):
        yield shingles_of_words(words, size)
