"""Periodic runs of words, found by an online dynamic program over the diagonals of a text against itself.

A diagonal belongs to a lag; its match length at word i counts how many words in a row, up to i, equal the one
`lag` words before. While a text is read, each word's earlier occurrences raise the lengths of the active
diagonals, and a diagonal that ends emits its run at once if it is long enough.

The table is kept sparse. A run of period q is matched on at least max(24 - q, 2 * q) >= 16 words of its diagonal, so
cells below SEED needn't exist: a diagonal opens where the last SEED words occurred before, with its length so far.
Lags of 16 and more open only at words whose number is a multiple of the largest power of two up to the lag,
as a diagonal that counts cannot pass all of those, so that each doubling of the lag costs at most a step per word.
Multiples of an active lag whose stretch holds both occurrences have the same stretch, and never open.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import arrow_rows
from tidemark.llm.wordhash import BASE, mix

LEAST_WORDS, LEAST_PERIODS = 24, 3
SEED = 16
COLUMNS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start: long, length: long, period: long>>, collapsed string"
)
Run = tuple[int, int, int]


def _seeds(ids: np.ndarray) -> np.ndarray:
    """Hash of the SEED words that end at each word from SEED - 1 on."""
    out = np.zeros(len(ids) - SEED + 1, np.uint64)
    for k in range(SEED):
        out = out * np.uint64(BASE) + ids[k : len(ids) - SEED + 1 + k].astype(np.uint64) + np.uint64(1)
    return mix(out)


def _before(w: list[int], i: int, lag: int) -> int:
    """How many words in a row, from word i back, equal the one `lag` before."""
    k = i
    while k >= lag and w[k] == w[k - lag]:
        k -= 1
    return i - k


def find_runs(w: list[int]) -> list[Run]:
    """Every run (start, length, period) of the words, given as numbers, by start and then period."""
    n, found = len(w), []
    if n < LEAST_WORDS:
        return found
    seeds = _seeds(np.array(w, np.int64))
    order = np.argsort(seeds, kind="stable")
    fresh = np.empty(len(order), bool)
    fresh[0], fresh[1:] = True, seeds[order[1:]] != seeds[order[:-1]]
    if fresh.all():
        return found
    group = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    occurs = order.tolist()  # occurrences, those of one seed side by side and ascending
    first, place = group[place].tolist(), place.tolist()
    again = np.flatnonzero(~fresh)
    opens = np.sort(order[again]).tolist()  # where a seed occurs that occurred before

    active: dict[int, int] = {}  # lag: number of the first word of its stretch
    at, i = 0, 0
    while i < n:
        if not active:  # nothing to raise before the next seed that repeats
            while at < len(opens) and opens[at] + SEED - 1 < i:
                at += 1
            if at == len(opens):
                break
            i = opens[at] + SEED - 1
        word = w[i]
        ended = [lag for lag in active if w[i - lag] != word]
        for lag in ended:
            _emit(found, active.pop(lag), i, lag)
        s = i - SEED + 1
        if s >= 0 and place[s] > first[s]:
            _open(w, i, s, occurs, first[s], place[s], active)
        i += 1
    for lag, start in active.items():
        _emit(found, start, n, lag)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _emit(found: list[Run], start: int, end: int, lag: int) -> None:
    if end - start >= max(LEAST_WORDS, LEAST_PERIODS * lag):
        found.append((start, end - start, lag))


def _open(w: list[int], i: int, s: int, occurs: list[int], first: int, here: int, active: dict[int, int]) -> None:
    """Open the diagonals of the seed at word s that are due at word i, short lags first."""
    low = 1
    high = SEED
    while low <= s:
        # occurrences at lags from low up to high, nearest first
        p = bisect_left(occurs, s - low + 1, first, here) - 1
        while p >= first and s - occurs[p] < high:
            lag = s - occurs[p]
            if lag not in active and not any(lag % short == 0 and start <= s - lag for short, start in active.items()):
                length = _before(w, i, lag)
                if length >= SEED:  # equal hashes, and equal words
                    active[lag] = i - length - lag + 1
            p -= 1
        low, high = high, 2 * high
        if i % low:  # larger powers don't divide i either
            return


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return [x for x, drop in zip(words, gone.tolist(), strict=True) if not drop]


def longest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period, compared exactly; ties go to the smallest start, then period."""
    best = None
    for run in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In one of ten documents, by the id's CRC, the words from a place on become a repetition; a null id counts as empty."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit, rest = words[a : a + p], n - a
    return words[:a] + (unit * -(-rest // p))[:rest]


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None, keep: bool = True) -> DataFrame:
    """Runs of words that repeat with a period, and the text with each run cut down to its first period.

    A run is a stretch of words with smallest period q (words q apart are equal) and at least max(24, 3 * q) words that
    no neighbouring word extends. Words are runs of bytes outside space, tab, LF, VT, FF and CR and differ by
    their bytes. `docs` has doc_id and text; other columns are ignored, whatever their names. `change` may alter the
    words of a row beforehand; it must depend on doc_id and words alone. `start`, `length`, `period` and
    `exponent_milli` describe the run with most periods, ties to the smallest start, then period; they are null
    without runs. A null or empty text has no words and no runs. One row per input row, repeated rows and null ids
    included; none for an empty table. `runs` and `collapsed` are null unless kept. A text of n words takes memory for a
    few numbers a word and time of about n log n, however it repeats; rows never meet, so no key can be hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
        struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        kinds = [*[pa.int64()] * 6, pa.string(), pa.string(), pa.list_(struct), pa.string()]
        for batch in arrow_rows(batches, 256):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").encode().split()
                if change is not None:
                    words = change(doc_id, words)
                number: dict[bytes, int] = {}
                runs = find_runs([number.setdefault(x, len(number)) for x in words])
                best = longest(runs)
                listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
                left = b" ".join(collapse(words, runs))
                rows.append((
                    doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
                    hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest(),
                    [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] if keep else None, left.decode() if keep else None,
                ))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COLUMNS)
