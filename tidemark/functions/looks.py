"""Looks along a series: values of rows before and after, as NumPy over sorted Arrow batches.

A `Look` is one column made from another column of the same series, an `Each` one made from columns of the same row.
Spark lays the series out, partitions and sorts them; `with_looks` then makes all of them in one streaming pass, where a
Window operator or a pass for each stage copies every wide row again. Nulls are NaN here and come back as null.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Kinds that look ahead.
AHEAD = ("lead", "min_after", "max_after")


@dataclass(frozen=True)
class Look:
    """One column: `kind` over `n` rows of `col`; `a` is the factor of a recursion, `m` the rows of a second window."""

    kind: str
    col: str
    n: int
    a: float = 0.0
    m: int = 0

    @property
    def reach(self) -> int:
        return self.n + self.m

    @property
    def needs(self) -> tuple[str, ...]:
        return (self.col, "bar") if self.kind == "stance" else (self.col,)


@dataclass(frozen=True, eq=False)
class Each:
    """One column from NumPy columns of the same rows; a `boolean` may be made of truth values or of 0, 1 and NaN."""

    fn: Callable[..., np.ndarray]
    cols: tuple[str, ...]
    kind: str = "double"

    @property
    def needs(self) -> tuple[str, ...]:
        return self.cols


def each(fn: Callable[..., np.ndarray], *cols: str, kind: str = "double") -> Each:
    return Each(fn, cols, kind)


def same(col: str) -> Each:
    return Each(lambda x: x, (col,))


# --------------------------------------------------------------------------- rows


def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b; undefined where b is 0."""
    return np.where(b == 0, np.nan, a / b)


def log_ratio(num: np.ndarray, den: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """ln(max(num, floor) / max(den, floor))."""
    return np.log(np.fmax(num, floor) / np.fmax(den, floor))


def unit(x: np.ndarray) -> np.ndarray:
    """Clamped to [-1, 1]; undefined stays undefined."""
    return np.where(np.isnan(x), np.nan, np.fmax(-1.0, np.fmin(1.0, x)))


def position(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where x sits between lo and hi; flat gives 0.5, undefined x stays undefined."""
    return np.where(np.isnan(x), np.nan, np.where(hi != lo, (x - lo) / (hi - lo), 0.5))


def known(test: np.ndarray, *xs: np.ndarray) -> np.ndarray:
    """A comparison as 0 and 1; undefined where one of its sides is."""
    out = test.astype(np.float64)
    for x in xs:
        out = np.where(np.isnan(x), np.nan, out)
    return out


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a and b, each 0, 1 or undefined: 0 if one is 0, else undefined if one is."""
    return np.where((a == 0) | (b == 0), 0.0, a * b)


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """x rounded as Spark's `round` does: ties of its shortest decimal form away from zero. No negative zero."""
    scale = 10.0**digits
    y = x * scale
    whole = np.rint(y)
    sure = (np.abs(y) < 1e12) & (np.abs(y - whole) < 0.499)
    out = np.where(sure, whole / scale, x)
    exact = decimal.Context(prec=400, rounding=decimal.ROUND_HALF_UP)
    for i in np.flatnonzero(~sure & np.isfinite(x)):
        out[i] = float(decimal.Decimal(repr(float(x[i]))).quantize(decimal.Decimal(1).scaleb(-digits), context=exact))
    return out + 0.0


def rounded(x: Each, digits: int) -> Each:
    return Each(lambda *xs: half_up(x.fn(*xs), digits), x.cols) if x.kind == "double" else x


def blocks(n: int) -> list[tuple[int, int]]:
    """(width, offset) of power-of-two blocks that tile the last n rows, newest and widest first."""
    out, off = [], 0
    for bit in range(n.bit_length() - 1, -1, -1):
        if n >> bit & 1:
            out.append((1 << bit, off))
            off += 1 << bit
    return out


class _Rows:
    """Columns of sorted rows with the place of each row in its series; ladders are built once."""

    def __init__(self, values: dict[str, np.ndarray], place: np.ndarray, left: np.ndarray) -> None:
        self.values, self.place, self.left = values, place, left
        self.made: dict[tuple, np.ndarray] = {}
        self.outside: dict[int, np.ndarray] = {}

    def back(self, x: np.ndarray, k: int, fill: float = np.nan) -> np.ndarray:
        """x of k rows before (k < 0: after); `fill` outside the series."""
        if k == 0:
            return x
        if abs(k) >= len(x):
            return np.full(len(x), fill)
        out = np.empty(len(x))
        if k not in self.outside:
            self.outside[k] = np.flatnonzero(self.place < k if k > 0 else self.left < -k)
        if k > 0:
            out[k:] = x[:-k]
        else:
            out[:k] = x[-k:]
        out[self.outside[k]] = fill
        return out

    def get(self, kind: str, col: str, n: int, a: float = 0.0, m: int = 0) -> np.ndarray:
        key = (kind, col, n, a, m)
        if key not in self.made:
            more = [x for x in (a, m) if x]
            self.made[key] = getattr(self, f"_{kind}")(col, n, *more)
        return self.made[key]

    def _lag(self, col: str, k: int) -> np.ndarray:
        return self.back(self.values[col], k)

    def _lead(self, col: str, k: int) -> np.ndarray:
        return self.back(self.values[col], -k)

    def _extent(self, best, kind: str, col: str, n: int, sign: int) -> np.ndarray:
        """Best of up to n rows: two overlapping stretches of a power of two."""
        if n == 1:
            return self.values[col]
        half = 1 << ((n - 1).bit_length() - 1)
        x = self.get(kind, col, half)
        return best(x, self.back(x, sign * (n - half)))

    def _min(self, col: str, n: int) -> np.ndarray:
        return self._extent(np.fmin, "min", col, n, 1)

    def _max(self, col: str, n: int) -> np.ndarray:
        return self._extent(np.fmax, "max", col, n, 1)

    def _min_from(self, col: str, n: int) -> np.ndarray:
        return self._extent(np.fmin, "min_from", col, n, -1)

    def _max_from(self, col: str, n: int) -> np.ndarray:
        return self._extent(np.fmax, "max_from", col, n, -1)

    def _min_before(self, col: str, n: int) -> np.ndarray:
        return self.back(self.get("min", col, n), 1)

    def _max_before(self, col: str, n: int) -> np.ndarray:
        return self.back(self.get("max", col, n), 1)

    def _min_after(self, col: str, n: int) -> np.ndarray:
        return self.back(self.get("min_from", col, n), -1)

    def _max_after(self, col: str, n: int) -> np.ndarray:
        return self.back(self.get("max_from", col, n), -1)

    def _stance(self, col: str, n: int, m: int) -> np.ndarray:
        """Position of col / mean of n in the range of its last m values.

        The ratio is 1 where the mean is undefined or not positive, and before the first bar; a flat range gives 0.5.
        """
        avg = np.where(self.values["bar"] >= n - 1, self.get("sum", col, n) / float(n), np.nan)
        x = np.where(avg > 0, self.values[col] / avg, 1.0)
        within = _Rows({"x": x}, self.place, self.left)
        lo, hi = within.get("min", "x", m), within.get("max", "x", m)
        pad = self.values["bar"] < m - 1
        lo, hi = np.where(pad, np.fmin(lo, 1.0), lo), np.where(pad, np.fmax(hi, 1.0), hi)
        flat = np.isnan(lo) | np.isnan(hi) | (hi == lo)
        return np.where(flat, 0.5, (x - lo) / (hi - lo))

    def _block(self, col: str, w: int) -> np.ndarray:
        """Sum of w values, w a power of two."""
        if w == 1:
            return self.values[col]
        x = self.get("block", col, w // 2)
        return x + self.back(x, w // 2)

    def _sum(self, col: str, n: int) -> np.ndarray:
        terms = [self.back(self.get("block", col, w), off) for w, off in blocks(n)]
        return sum(terms[1:], terms[0])

    def _total(self, col: str, n: int) -> np.ndarray:
        """Sum of the defined among up to n values, oldest first; NaN without any."""
        x = self.values[col]
        zeros, out = np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf), np.zeros(len(x))
        for k in range(n - 1, -1, -1):
            out += self.back(zeros, k, 0.0)
        out[self.get("defined", col, n) == 0] = np.nan
        return out

    def _defined(self, col: str, n: int) -> np.ndarray:
        """How many of up to n values are defined."""
        on = ~np.isnan(self.values[col])
        if on.all():
            return np.minimum(self.place + 1, n).astype(np.float64)
        on = on.astype(np.float64)
        return sum((self.back(on, k, 0.0) for k in range(1, n)), on)

    def _mean(self, col: str, n: int) -> np.ndarray:
        """Mean of the defined among up to n values."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.get("total", col, n) / self.get("defined", col, n)

    def _moments(self, col: str, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean and sum of squared deviations of w values, w a power of two."""
        if w == 1:
            return self.values[col], np.zeros(len(self.place))
        m, q = self.get("moments", col, w // 2)
        return _merged(w // 2, w // 2, m, self.back(m, w // 2), q, self.back(q, w // 2))

    def _squares(self, col: str, n: int) -> np.ndarray:
        """Sum of squared deviations of the last n values."""
        (have, _), *rest = blocks(n)
        m, q = self.get("moments", col, have)
        for w, off in rest:
            bm, bq = self.get("moments", col, w)
            m, q = _merged(have, w, m, self.back(bm, off), q, self.back(bq, off) if w > 1 else 0.0)
            have += w
        return q

    def _ages(self, col: str, w: int) -> np.ndarray:
        """Sum of w values times their age, w a power of two."""
        if w == 1:
            return np.zeros(len(self.place))
        half = w // 2
        v = self.get("ages", col, half)
        older = self.back(v, half) if half > 1 else 0.0
        return v + older + float(half) * self.back(self.get("block", col, half), half)

    def _aged(self, col: str, n: int) -> np.ndarray:
        """Sum of the last n values times their age."""
        terms = []
        for w, off in blocks(n):
            if w > 1:
                terms.append(self.back(self.get("ages", col, w), off))
            if off:
                terms.append(float(off) * self.back(self.get("block", col, w), off))
        return sum(terms[1:], terms[0])

    def _scan(self, col: str, n: int, a: float) -> np.ndarray:
        """x[t] = a * x[t-1] + col[t], over the last n rows, n a power of four."""
        x, width = self.values[col], 1
        while width < n:
            zeros = np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf)
            old = [self.back(zeros, k * width, 0.0) for k in (1, 2, 3)]
            x = x + a ** width * old[0] + a ** (2 * width) * old[1] + a ** (3 * width) * old[2]
            width *= 4
        return x


def _merged(na: int, nb: int, ma, mb, qa, qb) -> tuple[np.ndarray, np.ndarray]:
    d, tot = mb - ma, na + nb
    return ma + d * (nb / tot), qa + qb + d * d * (na * nb / tot)


def series_begin(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether a row begins a series."""
    out = np.zeros(rows.num_rows, bool)
    out[:1] = True
    for k in keys:
        ids = rows[k].combine_chunks().dictionary_encode(null_encoding="encode")
        ids = (ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids).indices.to_numpy(zero_copy_only=False)
        out[1:] |= ids[1:] != ids[:-1]
    return out


def _reaches(looks: dict[str, Look | Each]) -> tuple[dict[str, int], dict[str, int]]:
    """How many rows back and ahead each column depends on, through all columns it is made of."""
    back: dict[str, int] = {}
    ahead: dict[str, int] = {}
    for name, x in looks.items():
        far = isinstance(x, Look) and x.kind in AHEAD
        back[name] = max((back.get(c, 0) for c in x.needs), default=0) + (x.reach if isinstance(x, Look) and not far else 0)
        ahead[name] = max((ahead.get(c, 0) for c in x.needs), default=0) + (x.n if far else 0)
    return back, ahead


_KINDS = {"double": T.DoubleType(), "boolean": T.BooleanType(), "int": T.IntegerType()}


def _column(x: np.ndarray, kind: str) -> pa.Array:
    if kind == "boolean":
        return pa.array(x) if x.dtype == bool else pa.array(x == 1, mask=np.isnan(x))
    return pa.array(x.astype(np.int32)) if kind == "int" else pa.array(x, pa.float64(), from_pandas=True)


def with_looks(df: DataFrame, keys: Sequence[str], looks: dict[str, Look | Each], keep: Sequence[str] | None = None, only: str | None = None, count: bool = False) -> DataFrame:
    """Add looks to rows that lie series by series, each sorted by time.

    Each may use columns named before it; those not in `keep` (by default all) stay inside. Rows whose column `only`
    is false serve the others and are left out. Batches stream through: of a series that goes on, no more rows are kept
    than the looks reach back and ahead. With `count`, for series that fit in memory, `bar` and `n_bars` (position and
    length of the series) are added first, and a series is kept until it is whole.
    """
    keep = list(looks if keep is None else keep)
    need = sorted({c for x in looks.values() for c in x.needs} & {*df.columns} - {*looks})
    counted = ["bar", "n_bars"] if count else []
    back, front = _reaches(looks)
    reach, ahead = max(back.values(), default=0), max(front.values(), default=0)
    keys = list(keys)
    kinds = {n: getattr(looks[n], "kind", "double") if isinstance(looks[n], Each) else "double" for n in keep}
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in counted), *(T.StructField(n, _KINDS[kinds[n]]) for n in keep)])

    def made(values: dict[str, np.ndarray], place: np.ndarray, left: np.ndarray) -> dict[str, np.ndarray]:
        rows = _Rows(values, place, left)
        for name, x in looks.items():
            if isinstance(x, Each):
                rows.values[name] = x.fn(*(rows.values[c] for c in x.cols))
            else:
                rows.values[name] = rows.get(x.kind, x.col, x.n, x.a, x.m)
        return rows.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sent = None, 0
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                new = pa.Table.from_batches([batch])
                rows = new if rows is None else pa.concat_tables([rows, new])
            if rows is None:
                return
            n = rows.num_rows
            begin = np.flatnonzero(series_begin(rows, keys))
            until = n if batch is None else int(begin[-1]) if count else max(sent, int(begin[-1]), n - ahead)
            if until > sent:
                at = np.arange(n)
                size = np.diff(np.append(begin, n))
                place = at - np.repeat(begin, size)
                length = np.repeat(size, size)
                own = {"bar": place, "n_bars": length} if count else {}
                with np.errstate(all="ignore"):
                    values = {c: rows[c].cast(pa.float64(), safe=False).to_numpy() for c in need}
                    values = made(values | {c: x.astype(np.float64) for c, x in own.items()}, place, length - 1 - place)
                    cols = [pa.array(x[sent:until]) for x in own.values()] + [_column(values[c][sent:until], kinds[c]) for c in keep]
                out = rows.slice(sent, until - sent).combine_chunks()
                for name, col in zip([*own, *keep], cols, strict=True):
                    out = out.append_column(name, col)
                yield from (out if only is None else out.filter(out[only])).to_batches()
            back_to = until if count else max(int(begin[-1]), until - reach, 0)
            rows, sent = (rows.slice(back_to), until - back_to) if back_to < n else (None, 0)

    return df.mapInArrow(run, schema)
