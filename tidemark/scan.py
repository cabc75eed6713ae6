"""Exact scans of x -> max(a * x + b, c) along series of any length.

Such maps compose to such maps while a >= 0. A chunk of a series is composed to one map, the few maps of a series are
followed in order to get each chunk's first value, and each chunk is replayed from its own. Rows are dealt out by chunk and
sorted; a task steps through all chunks of a batch at the same time, the k-th rows of all of them in one NumPy operation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.layout import CHUNK_ROWS, DAY, index_bars
from tidemark.session import materialise

Map = tuple[float, float, float]
IDENTITY: Map = (1.0, 0.0, -math.inf)


def compose(first: Map, then: Map) -> Map:
    """The map that applies `first` and then `then`."""
    (a1, b1, c1), (a2, b2, c2) = first, then
    return a2 * a1, a2 * b1 + b2, max(b2 if a2 == 0 else a2 * c1 + b2, c2)


def apply(m: Map, x: float) -> float:
    return max(m[0] * x + m[1], m[2])


def _begins(rows: pa.Table) -> np.ndarray:
    """Rows that begin a chunk, in rows sorted by symbol and chunk."""
    out = np.ones(rows.num_rows, bool)
    ids = rows["symbol"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    ck = rows["_ck"].to_numpy()
    out[1:] = (ids[1:] != ids[:-1]) | (ck[1:] != ck[:-1])
    return np.flatnonzero(out)


def _by_chunk(made: Callable[[pa.Table, np.ndarray], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`made` from whole chunks of sorted rows and the places where they begin; a chunk that a batch cuts waits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if not held or (batch is not None and not batch.num_rows):
                continue
            rows = pa.Table.from_batches(held)
            begin = _begins(rows)
            whole = rows.num_rows if batch is None else int(begin[-1])
            if whole:
                yield from made(rows.slice(0, whole), begin[begin < whole]).combine_chunks().to_batches()
            held = rows.slice(whole).to_batches()

    return run


def _turns(begin: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each step k, the chunks of more than k rows, longest first, and their k-th rows."""
    size = np.diff(np.append(begin, n))
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
    for k, m in enumerate(live):
        yield order[:m], begin[order[:m]] + k


def _arrays(rows: pa.Table) -> list[np.ndarray]:
    return [rows[k].to_numpy() for k in ("_a", "_b", "_c")]


def _composed(rows: pa.Table, begin: np.ndarray) -> pa.Table:
    """The map of each chunk."""
    a, b, c = _arrays(rows)
    ta, tb, tc = (np.full(len(begin), v) for v in IDENTITY)
    with np.errstate(invalid="ignore"):
        for at, row in _turns(begin, rows.num_rows):
            low = np.where(a[row] == 0, b[row], a[row] * tc[at] + b[row])
            tc[at] = np.where(c[row] > low, c[row], low)
            ta[at], tb[at] = a[row] * ta[at], a[row] * tb[at] + b[row]
    first = rows.select(["symbol", "_ck"]).take(pa.array(begin))
    return first.append_column("_a", pa.array(ta)).append_column("_b", pa.array(tb)).append_column("_c", pa.array(tc))


def max_affine_scan(
    df: DataFrame, a: Column, b: Column, c: Column | None, name: str, start: float = 0.0, *, bar_seconds: int = DAY, chunk_rows: int = CHUNK_ROWS, max_bars: int | None = None
) -> DataFrame:
    """Add `name`: x[t] = max(a[t] * x[t-1] + b[t], c[t]) in each symbol by time, from x = `start` before the first row.

    `df` has symbol and time, a time at most once a symbol; `a`, `b` and `c` may change by row. Without `c`, or where it is
    null, there is no floor; where `a` or `b` is null x stays as it was, but for the floor. A negative `a` is an error. All
    columns stay; `bar` and `n_bars` are added if they lack. `max_bars` is taken for symmetry with other calculations and
    not needed. Equal to a plain loop but for rounding where chunks meet.
    """
    indexed = df if {"bar", "n_bars"} <= set(df.columns) else index_bars(df, bar_seconds)
    undefined = a.isNull() | b.isNull()
    factor = F.when(a < 0, F.raise_error(F.lit("factors of a scan must not be negative")).cast("double")).otherwise(a.cast("double"))
    floor = F.lit(None) if c is None else c
    rows = materialise(
        indexed.withColumns({
            "_a": F.when(undefined, F.lit(1.0)).otherwise(factor), "_b": F.when(undefined, F.lit(0.0)).otherwise(b.cast("double")),
            "_c": F.coalesce(floor.cast("double"), F.lit(-math.inf)), "_bar": F.col("bar"), "_ck": F.floor(F.col("bar") / F.lit(chunk_rows)),
        })
    )

    def follow(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.rename_columns(["symbol", "_ck", "_a", "_b", "_c"]).sort_by("_ck")
        x, at = start, []
        for m in zip(*(v.tolist() for v in _arrays(rows)), strict=True):
            at.append(x)
            x = apply(m, x)
        return pa.table({"symbol": rows["symbol"], "_ck": rows["_ck"], "_x": pa.array(at, pa.float64())})

    dealt = ["symbol", "_ck"]
    steps = rows.select(*dealt, "_bar", "_a", "_b", "_c").repartition(*dealt).sortWithinPartitions(*dealt, "_bar").drop("_bar")
    chunks = steps.mapInArrow(_by_chunk(_composed), rows.select(*dealt, "_a", "_b", "_c").schema)
    # a row a chunk
    starts = materialise(chunks.groupBy("symbol").applyInArrow(follow, "symbol string, _ck long, _x double"))

    def replay(rows: pa.Table, begin: np.ndarray) -> pa.Table:
        (a, b, c), x = _arrays(rows), rows["_x"].to_numpy()[begin]
        out = np.empty(rows.num_rows)
        for at, row in _turns(begin, rows.num_rows):
            y = a[row] * x[at] + b[row]
            out[row] = x[at] = np.where(c[row] > y, c[row], y)
        return rows.drop_columns(["_a", "_b", "_c", "_bar", "_ck", "_x"]).append_column(name, pa.array(out))

    kept = indexed.columns
    schema = indexed.select(*kept, F.lit(0.0).alias(name)).schema
    found = rows.join(starts, dealt).select(*kept, "_a", "_b", "_c", "_bar", "_ck", "_x")
    return found.repartition(*dealt).sortWithinPartitions(*dealt, "_bar").mapInArrow(_by_chunk(replay), schema)
