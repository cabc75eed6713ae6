"""Token counts of SentencePiece BPE by a deterministic transducer, compiled as it is needed.

The tokenization of every prefix of a text ends in one last token, and a token can end a prefix exactly if it
forms a stable pair with the last token of what precedes it: a pair is stable if the merges leave it as it is.
So a state needs, for each suffix of the text that begins some piece, the last token before that suffix and how
many tokens ago it ended. These states are finite in number. A transition reads one character and carries the
change of the token count. Pieces don't cross a white-space mark that follows another character, so there the
state is always the same.

A text is cut into chunks that run side by side. A chunk's map leads from its state at entry to its state at
exit and its count. Behind a mark the entry is known and the map is constant; other chunks begin with a guess,
and a scan along the text hands each exit on as the next entry, asking for the missing values of the maps until
all of them fit together. Counts then add up along the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spmodel import MARK, mergeable_pieces
from tidemark.llm.tables import arrow_rows
from tidemark.llm.wordhash import blocks

CHUNK = 512
SHIFT = 64  # change of count is kept as change + SHIFT in the low 8 bits
MAX_STATES = 200_000  # a worker that holds more begins anew; this changes no result
FEW = 4

_state: dict = {}


def merge(pieces: dict[str, float], text: str) -> list[str]:
    """Pieces of a short text: merge the best scored adjacent pair, the leftmost of equal ones, until none is left."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            score = pieces.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """States and transitions of one model; `pieces` maps each mergeable piece to its score (see `mergeable_pieces`)."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.child: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for p in pieces:
            node = 0
            for c in p:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.piece.append(None)
                node = self.child[node][c]
            self.piece[node] = p if len(p) == 1 or merge(pieces, p) == [p] else None
        # pieces that lie below a node, where they are few: a suffix that none of them can end is forgotten
        self.below: list[list[str] | None] = [None] * len(self.child)
        for node in reversed(range(len(self.child))):
            found = [p for to in self.child[node].values() for p in ([self.piece[to]] if self.piece[to] else []) + (self.below[to] or [])]
            if len(found) <= FEW and all(self.below[to] is not None for to in self.child[node].values()):
                self.below[node] = found
        self.stable: dict[tuple[str, str], bool] = {}
        self.open: dict[tuple[int, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all states and transitions; they are compiled again as they are met."""
        self.states: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.symbols: list[str] = []
        self.symbol_of = np.full(0x110000, -1, np.int16)
        self.table = np.full((1 << 10, 64), -1, np.int32)
        self.start = self._state_id(self._step((0, None, 0), MARK)[0])

    def _state_id(self, state: tuple) -> int:
        if state not in self.index:
            if len(self.states) == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.index[state] = len(self.states)
            self.states.append(state)
        return self.index[state]

    def _fits(self, left: str | None, right: str) -> bool:
        if left is None or right[0] == MARK and left[-1] != MARK:
            return True
        if (left, right) not in self.stable:
            self.stable[left, right] = merge(self.pieces, left + right) == [left, right]
        return self.stable[left, right]

    def _leads_on(self, node: int, before: str | None) -> bool:
        """Whether a piece that goes on from `node` can follow the token before it; True if there are many to try."""
        if before is None or self.below[node] is None:
            return bool(self.child[node])
        key = node, before
        if key not in self.open:
            self.open[key] = any(self._fits(before, p) for p in self.below[node])
        return self.open[key]

    def _step(self, state: tuple, c: str) -> tuple[tuple, int]:
        """Next state and change of the count. A state lists trie node, last token before it, count before it, and so on.

        None as last token fits with everything: the text's begin, a character outside the vocabulary, and
        whatever a mark follows that begins a word.
        """
        after, last, change = [], None, None
        for node, before, count in zip(state[::3], state[1::3], state[2::3], strict=True):
            to = self.child[node].get(c)
            if to is None:
                continue
            if change is None and self.piece[to] is not None and self._fits(before, self.piece[to]):
                last, change = self.piece[to], count + 1
            if self._leads_on(to, before):
                after.append((to, before, count))
        if change is None:
            if c in self.pieces:
                raise AssertionError(f"no last token at {c!r}")
            return (0, None, 0), len(c.encode())
        out: list = []
        for node, before, count in after:
            word = c == MARK and before is not None and before[-1] != MARK
            out += [node, None if word else before, count - change]
        return (*out, 0, last, 0), change

    def symbol_ids(self, points: np.ndarray) -> np.ndarray:
        """Symbol of each code point. Characters outside the vocabulary share one symbol for each UTF-8 length."""
        out = self.symbol_of[points]
        if len(points) and out.min() < 0:
            for point in np.unique(points[out < 0]).tolist():
                c = chr(point)
                c = c if c in self.pieces else {1: "\0", 2: "\x80", 3: "￿", 4: "\U0010ffff"}[len(c.encode())]
                if c not in self.symbols:
                    self.symbols.append(c)
                self.symbol_of[point] = self.symbols.index(c)
            while len(self.symbols) > self.table.shape[1]:
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
            out = self.symbol_of[points]
        return out

    def _compile(self, state: np.ndarray, symbol: np.ndarray) -> None:
        for s, x in set(zip(state.tolist(), symbol.tolist(), strict=True)):
            after, change = self._step(self.states[s], self.symbols[x])
            to = self._state_id(after)
            self.table[s, x] = to << 8 | change + SHIFT

    def run(self, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and count of each chunk from its entry state; all chunks advance together."""
        order = np.argsort(-length, kind="stable")
        at, state = begin[order].astype(np.int64), entry[order].astype(np.int64)
        count, size = np.zeros(len(order), np.int64), length[order]
        live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for m in live.tolist():
            x = symbols[at[:m]]
            step = self.table[state[:m], x]
            if step.min() < 0:
                miss = step < 0
                self._compile(state[:m][miss], x[miss])
                step = self.table[state[:m], x]
            state[:m] = step >> 8
            count[:m] += step & 255
            at[:m] += 1
        exits, counts = np.empty_like(state), np.empty_like(count)
        exits[order], counts[order] = state, count - SHIFT * size
        return exits, counts

    def counts(self, at: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Tokens of each text, whose code points are points[at[k]:at[k + 1]]."""
        if len(self.states) > MAX_STATES:
            self.clear()
        points = np.where(points == 32, np.uint32(ord(MARK)), points)
        symbols = self.symbol_ids(points)
        size = np.diff(at)
        mark = points == ord(MARK)
        fresh = np.flatnonzero(mark[1:] & ~mark[:-1]) + 2  # behind a mark that begins a word
        chunks = -(-size // CHUNK)
        text = np.repeat(np.arange(len(size)), chunks)
        begin = at[text] + CHUNK * (np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks))
        first = begin == at[text]
        known = np.searchsorted(fresh, begin)
        moved = np.append(fresh, len(points) + 1)[known]
        near = ~first & (moved < np.minimum(begin + CHUNK, at[text + 1]))
        begin = np.where(near, moved, begin)
        open_ = ~first & ~near
        length = np.append(begin[1:], len(points))[: len(begin)] - begin
        entry = np.full(len(begin), self.start)
        exits, counts = self.run(symbols, begin, length, entry)
        seen = {}
        while True:
            # the scan: an open chunk's entry is the exit before it
            want = np.where(open_, np.concatenate([[self.start], exits[:-1]]), self.start)[: len(begin)]
            wrong = np.flatnonzero(want != entry)
            if not len(wrong):
                break
            for k in wrong.tolist():
                seen[k, int(entry[k])] = int(exits[k]), int(counts[k])
            entry[wrong] = want[wrong]
            todo = np.array([k for k in wrong.tolist() if (k, int(want[k])) not in seen], np.int64)
            for k in wrong.tolist():
                if (k, int(want[k])) in seen:
                    exits[k], counts[k] = seen[k, int(want[k])]
            if len(todo):
                exits[todo], counts[todo] = self.run(symbols, begin[todo], length[todo], entry[todo])
        return (size > 0) + np.bincount(text, weights=counts, minlength=len(size)).astype(np.int64)


def load(path: str) -> Transducer:
    """Transducer of a SentencePiece BPE model, one per Python worker."""
    if path not in _state:
        _state[path] = Transducer(mergeable_pieces(path))
    return _state[path]


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Bytes, tokens, and whether tokens exceed `limit`, of every text.

    `docs` has doc_id and text; other columns are ignored. A null text counts as empty and has no tokens. Repeated
    rows give repeated rows; an empty table gives none. Texts of any length run in chunks side by side. Nothing is
    shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(model)
        for batch in arrow_rows(batches):
            sizes, counts = [], []
            for _, at, raw in blocks(batch.column(1)):
                points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
                first = np.searchsorted(np.flatnonzero((raw & 0xC0) != 0x80), at)
                sizes.append(np.diff(at))
                counts.append(machine.counts(first, points))
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
