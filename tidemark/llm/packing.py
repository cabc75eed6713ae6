"""Packing token sequences by minimum bin slack.

Documents are cut into full windows and one remainder each. Remainders are packed group by group: the
longest one left opens a window, a subset-sum program over bitsets finds the multiset of remaining lengths
that fills the rest best, and backtracking gives how many of each length it takes; the same filling is used
again as long as the counts allow.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.pretokens import text_ids
from tidemark.llm.tables import arrow_rows, groups_for, rows_of

#: Documents packed together; a group wastes a few windows.
GROUP_ROWS = 8192
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, padded_length long"
)


def fill_window(counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts of lengths whose sum is the closest to `room` from below.

    `counts` are the lengths at hand. Bit s of a set says that sum s can be made with the lengths seen so far.
    """
    sums, layers, mask, goal = 1, [], (1 << (room + 1)) - 1, 1 << room
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0 and not sums & goal:
            take = min(take, left)
            layers.append((length, take, sums))
            sums |= sums << (length * take) & mask
            left -= take
            take *= 2
        if sums & goal:
            break
    total, used = sums.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each length (all at most `capacity`), and the number of windows. Ties go by position."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")[::-1]
    waiting: dict[int, list[int]] = {}
    for i in order.tolist():
        waiting.setdefault(int(lengths[i]), []).append(i)
    counts = {x: len(w) for x, w in waiting.items()}
    n = 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = fill_window({x: c for x, c in counts.items() if c}, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        for _ in range(min(counts[x] // c for x, c in used.items())):
            at = 0
            for x, c in used.items():
                for _ in range(c):
                    i = waiting[x].pop()
                    window[i], offset[i] = n, at
                    at += x
            n += 1
            for x, c in used.items():
                counts[x] -= c
        counts = {x: c for x, c in counts.items() if c}
    return window, offset, n


def document_tokens(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Per document: number of ids with the end id, and the CRC-32 of each window's ids and of the remainder's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            tokens, sums = [], []
            for ids in text_ids(batch.column(1), tokenizer):
                ids = np.append(ids, end_id).astype("<u4")
                tokens.append(len(ids))
                sums.append([zlib.crc32(ids[i : i + capacity]) for i in range(0, len(ids), capacity)])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(tokens, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "sums"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, doc_tokens long, sums array<long>")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces of all documents, each in one sequence of at most `capacity` ids.

    `docs` has doc_id and text; other columns are ignored. A null text counts as empty and gives the end id alone.
    Repeated rows are packed each by itself; a null doc_id stays null. An empty table gives no rows. A piece of
    `capacity` ids is a sequence of its own. Only piece lengths and checksums are shuffled, never texts or ids;
    the groups come from a hash over doc_id and content, so that no key can fill one.
    """
    groups = groups_for(rows_of(docs), group_rows)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending")])
        tokens = rows["doc_tokens"].to_numpy()
        pieces = -(-tokens // capacity)
        doc = np.repeat(np.arange(len(tokens)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
        length = np.minimum(capacity, tokens[doc] - start)
        full = length == capacity
        window, offset = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        window[full] = np.arange(full.sum())
        w, o, n = pack_lengths(length[~full], capacity)
        window[~full], offset[~full] = w + full.sum(), o
        filled = np.bincount(window, weights=length, minlength=n + int(full.sum())).astype(np.int64)[window]
        padded = np.where(filled & (filled - 1) == 0, filled, capacity)
        base = key[0].as_py() << 32
        return pa.table(
            {
                "doc_id": rows["doc_id"].combine_chunks().take(pa.array(doc)),
                "start": start,
                "length": length,
                "ids_crc32": rows["sums"].combine_chunks().flatten(),
                "doc_tokens": tokens[doc],
                "sequence_id": base + window,
                "offset": offset,
                "sequence_length": filled,
                "padded_length": padded,
            }
        )

    found = document_tokens(docs, tokenizer, end_id, capacity)
    slot = F.pmod(F.xxhash64("doc_id", "doc_tokens", "sums"), F.lit(groups)).alias("slot")
    return found.select(slot, "doc_id", "doc_tokens", "sums").groupBy("slot").applyInArrow(run, PIECES)
