"""Sequence windows as strided views over chunks of a series.

A chunk's feature matrix is held once. A window is a view of `window` of its rows, so rows x columns are held where a
window column would hold rows x window x columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.layout import CHUNK_ROWS, DAY, Frames, lay_out

#: Values of the windows that are written out at a time.
CELLS = 1 << 20


def _laid(df: DataFrame, window: int, allowed: Column | None, layout: dict) -> tuple[DataFrame, list[str], list[str]]:
    """The frame with halo rows and `_ends` (rows that may end a window), its group keys, and the columns to return."""
    if window < 1:
        raise ValueError("window must be >= 1")
    options = {"bar_seconds": DAY, "max_bars": None, "chunk_rows": CHUNK_ROWS} | layout
    laid = lay_out(df, window - 1, **options)
    core = F.col("_core") if "_core" in laid.columns else F.lit(True)
    ends = core if allowed is None else core & F.coalesce(allowed, F.lit(False))
    shown = [c for c in laid.columns if c not in ("chunk", "_core")]
    return laid.withColumn("_ends", ends), list(Frames.of(laid).keys), shown


def _in_order(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    """The rows of one chunk by time; a chunk and its halo are bounded by the layout."""
    return pa.Table.from_batches(batches).sort_by("time")


def _matrix(rows: pa.Table, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Float values and a mask of the undefined ones, (row, column)."""
    parts = [rows[c].combine_chunks().cast(pa.float64()) for c in cols]
    null = np.column_stack([p.is_null().to_numpy(zero_copy_only=False) for p in parts])
    return np.column_stack([p.fill_null(0.0).to_numpy() for p in parts]).astype(np.float32), null


def _ends(rows: pa.Table, window: int) -> np.ndarray:
    """Positions in the chunk of the rows that end a full window."""
    at = np.flatnonzero(rows["_ends"].to_numpy())
    return at[at >= window - 1]


def sequence_windows(df: DataFrame, cols: Sequence[str], window: int, allowed: Column | None = None, **layout) -> DataFrame:
    """`seq`: the last `window` feature rows as array<array<float>>, for end rows with a full window.

    Windows never cross a series; `allowed` restricts the end rows, null is no. Undefined features stay null. An empty
    table gives no rows. Windows are written in slices of CELLS values; a task holds the matrix of one chunk.
    """
    laid, keys, shown = _laid(df, window, allowed, layout)
    cols = list(cols)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.select(*shown).schema.fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _in_order(batches)
        values, null = _matrix(rows, cols)
        ends = _ends(rows, window)
        step = max(1, CELLS // (window * len(cols)))
        for i in range(0, len(ends), step):
            at = ends[i : i + step]
            pick = at[:, None] + np.arange(1 - window, 1)
            flat = pa.array(values[pick].ravel(), pa.float32(), mask=null[pick].ravel())
            inner = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(cols), dtype=np.int32), flat)
            seq = pa.ListArray.from_arrays(np.arange(0, len(inner) + 1, window, dtype=np.int32), inner)
            own = rows.select(shown).take(at).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(own[c].combine_chunks() for c in shown), seq], [*shown, "seq"])

    return laid.groupBy(*keys).applyInArrow(cut, f"{columns}, seq array<array<float>>")


BLOCKS = "symbol string, first_bar long, n_rows int, n_cols int, data binary, ends array<int>, end_times array<long>"


def sequence_blocks(df: DataFrame, cols: Sequence[str], window: int, allowed: Column | None = None, **layout) -> DataFrame:
    """One row per chunk: its matrix of little-endian 32-bit floats by rows (undefined: NaN), and of each window the
    row it ends at and that row's time, which map windows back to bars.

    The same windows as `sequence_windows`, stored once for each chunk; `block_windows` reads them. Chunks in which no
    window ends are left out.
    """
    laid, keys, _ = _laid(df, window, allowed, layout)
    cols = list(cols)
    types = pa.schema(
        [("symbol", pa.string()), ("first_bar", pa.int64()), ("n_rows", pa.int32()), ("n_cols", pa.int32()), ("data", pa.binary()),
         ("ends", pa.list_(pa.int32())), ("end_times", pa.list_(pa.int64()))]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _in_order(batches)
        ends = _ends(rows, window)
        if len(ends):
            values, null = _matrix(rows, cols)
            values[null] = np.nan
            row = {
                "symbol": rows["symbol"][0].as_py(), "first_bar": rows["bar"][0].as_py(), "n_rows": len(values), "n_cols": len(cols),
                "data": values.astype("<f4").tobytes(), "ends": ends.tolist(), "end_times": rows["time"].take(ends).to_pylist(),
            }
            yield pa.RecordBatch.from_pylist([row], types)

    names = [*dict.fromkeys(["symbol", "time", "bar", "_ends", *keys, *cols])]
    return laid.select(*names).groupBy(*keys).applyInArrow(pack, BLOCKS)


def block_windows(data: bytes, n_cols: int, window: int, ends: Sequence[int]) -> Iterator[np.ndarray]:
    """Windows (window, n_cols) of a block in the order of `ends`, as views that copy nothing."""
    matrix = np.frombuffer(data, "<f4").reshape(-1, n_cols)
    for end in ends:
        yield matrix[end + 1 - window : end + 1]
