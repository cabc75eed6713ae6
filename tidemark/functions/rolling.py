"""Window primitives as stage columns on a laid-out frame.

Nulls mark warm-up. `min` and `max` skip nulls, which is what comparisons against an undefined value do.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.looks import Each, Look, each, position
from tidemark.layout import Frames


def sma(fr: Frames, s: int, col: str = "close") -> list[dict[str, Look | Each]]:
    """Mean of the last s values, `_sma_<col>_<s>`; null for the first s-1 bars.

    The sum is made of block sums over these s values alone, so it is the same wherever a series is cut, and a flat
    stretch has one and the same mean throughout.
    """
    stages, total = window_sum(fr, col, s)
    return [*stages, {f"_sma_{col}_{s}": each(lambda bar, x: np.where(bar >= s - 1, x / float(s), np.nan), "bar", total)}]


def extent_stages(fr: Frames, col: str, lb: int) -> list[dict[str, Look | Each]]:
    """Trailing minimum and maximum over up to lb bars (partial at the start), as `_lo_<col>_<lb>`, `_hi_...`.

    Nulls are skipped, which keeps partial windows and undefined history right.
    """
    return [{f"_lo_{col}_{lb}": Look("min", col, lb), f"_hi_{col}_{lb}": Look("max", col, lb)}]


def window_sum(fr: Frames, col: str, n: int) -> tuple[list[dict[str, Look | Each]], str]:
    """Sum of the last n values from block sums; null unless all n are there. Zeros stay exactly zero."""
    out = f"_total{n}_{col}"
    return [{out: Look("sum", col, n)}], out


def window_std(fr: Frames, col: str, n: int) -> tuple[list[dict[str, Look | Each]], str]:
    """Population standard deviation of the last n values; null unless all n are there.

    Mean and squared deviations of blocks are merged pairwise, so nothing large cancels and a flat window is exactly 0.
    """
    out = f"_std{n}_{col}"
    if n == 1:
        return [{out: each(lambda x: np.where(np.isnan(x), np.nan, 0.0), col)}], out
    squares = f"_squares{n}_{col}"
    return [{squares: Look("squares", col, n)}, {out: each(lambda x: np.sqrt(x / float(n)), squares)}], out


def window_slope(fr: Frames, col: str, n: int) -> tuple[list[dict[str, Look | Each]], str]:
    """Least-squares slope per bar over the last n values, from block sums and block sums weighted by age."""
    if n < 2:
        raise ValueError("a slope needs at least 2 bars")
    total, aged, out = f"_tot{n}_{col}", f"_aged{n}_{col}", f"_slope{n}_{col}"
    spread = n * (n * n - 1) / 12.0
    stages = [{total: Look("sum", col, n), aged: Look("aged", col, n)}, {out: each(lambda t, a: (t * ((n - 1) / 2.0) - a) / spread, total, aged)}]
    return stages, out


def pir(col: str, lb: int) -> Each:
    """Position in range from the columns of `extent_stages`."""
    return each(position, col, f"_lo_{col}_{lb}", f"_hi_{col}_{lb}")


def rolling(fr: Frames, fn, col: Column, n: int) -> Column:
    """fn over the last n bars, null unless all n are present and not null."""
    w = fr.w(-(n - 1))
    return F.when(F.count(col).over(w) == n, fn(col).over(w))


def rolling_mean(fr: Frames, col: Column, n: int) -> Column:
    return rolling(fr, F.avg, col, n)


def rolling_std(fr: Frames, col: Column, n: int) -> Column:
    """Population standard deviation."""
    return rolling(fr, F.stddev_pop, col, n)


def rolling_max(fr: Frames, col: Column, n: int) -> Column:
    return rolling(fr, F.max, col, n)


def log_return(close: np.ndarray, prev: np.ndarray) -> np.ndarray:
    """ln(close / prev); undefined at the first bar and on non-positive prices."""
    return np.where((close > 0) & (prev > 0), np.log(close / prev), np.nan)
