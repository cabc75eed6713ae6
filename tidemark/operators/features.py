"""Causal features of a bar series. Every builder returns a `Calc` for one laid-out frame."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.functions.looks import Each, Look, both, each, known, log_ratio, over, same, unit
from tidemark.functions.scalars import safe_log_ratio
from tidemark.layout import Calc, Frames, Spec, affine_scan_stages, compute, decay_rows, running_carry

# GARCH and HAR coefficients, floors and normalisers.
GJR_ALPHA, GJR_BETA, GJR_GAMMA = 0.03, 0.90, 0.08
LONG_RUN_WINDOW, HAR_WEEK, HAR_MONTH = 252, 5, 22
GJR_FLOOR, GK_FLOOR = 1e-12, 1e-10
GJR_NORM, HAR_NORM = 0.1, 0.5
HAR_W = (0.36, 0.28, 0.28)
VOLA_METHODS = ("ATR", "StdDev", "Intraday")


def close_() -> Column:
    return F.col("close")


def _seq(*parts: list[dict[str, Look | Each]]) -> list[dict[str, Look | Each]]:
    """Concatenate stage lists."""
    return [d for part in parts for d in part]


def _together(*parts: list[dict[str, Look | Each]]) -> list[dict[str, Look | Each]]:
    """Run independent stage lists side by side."""
    return [
        {k: v for p in parts if d < len(p) for k, v in p[d].items()} for d in range(max(len(p) for p in parts))
    ]


# --------------------------------------------------------------------------- averages, position in range


def running_sum(bars: DataFrame, col: str = "close", name: str = "csum", **layout) -> DataFrame:
    """Inclusive running sum of each series from its first bar; chunks hand their totals on."""
    keep = {k: layout[k] for k in ("chunk_rows", "max_bars") if k in layout}
    return running_carry(compute(bars, [], **layout), {name: F.col(col)}, **keep)


def sma(s: int, col: str = "close", name: str | None = None) -> Spec:
    def spec(fr: Frames) -> Calc:
        return Calc(
            R.sma(fr, s, col), {name or f"sma_{s}": same(f"_sma_{col}_{s}")}, lookback=s
        )

    return spec


def pir_of(col: str, lb: int, name: str | None = None) -> Spec:
    """Position of a column in its trailing lb-bar range; partial windows count."""

    def spec(fr: Frames) -> Calc:
        return Calc(R.extent_stages(fr, col, lb), {name or f"pir_{col}_{lb}": R.pir(col, lb)}, lookback=lb)

    return spec


def scale_pir_stages(fr: Frames, s: int, lb: int) -> tuple[list[dict[str, Look | Each]], str]:
    """Position of close / SMA(s) in its lb-bar history.

    The ratio is 1.0 where the average is undefined or not positive, and the history before the first bar counts as
    1.0 too, so there is no warm-up.
    """
    name = f"_stance{s}_{lb}"
    return [{name: Look("stance", "close", s, m=lb)}], name


def pir_for_scale(s: int, lb: int, name: str | None = None) -> Spec:
    def spec(fr: Frames) -> Calc:
        stages, out = scale_pir_stages(fr, s, lb)
        return Calc(stages, {name or f"pir_s{s}": same(out)}, lookback=s + lb)

    return spec


def agreement(start: int, end: int, step: int, pct: float, prefix: str = "agree", counts: bool = False) -> Spec:
    """Share of SMA scales whose position in range is above pct (high) or below 1 - pct (low)."""
    scales = list(range(start, end + 1, step))

    def spec(fr: Frames) -> Calc:
        built = [scale_pir_stages(fr, s, max(s, 20)) for s in scales]
        depth = max(len(st) for st, _ in built)
        stages = [{k: v for st, _ in built if d < len(st) for k, v in st[d].items()} for d in range(depth)]
        out = shares([p for _, p in built], pct, prefix, counts)
        return Calc(stages, out, lookback=2 * max([20, *scales]))

    return spec


def shares(places: list[str], pct: float, prefix: str, counts: bool) -> dict[str, Each]:
    """Shares of the positions in range above pct and below 1 - pct, and with `counts` how many they are."""
    n = len(places)

    def high(bar: np.ndarray, *xs: np.ndarray) -> np.ndarray:
        return sum((x > pct for x in xs), np.zeros(len(bar)))

    def low(bar: np.ndarray, *xs: np.ndarray) -> np.ndarray:
        return sum((x < 1.0 - pct for x in xs), np.zeros(len(bar)))

    out = {f"{prefix}_high": each(lambda *xs: high(*xs) / float(max(n, 1)), "bar", *places)}
    out[f"{prefix}_low"] = each(lambda *xs: low(*xs) / float(max(n, 1)), "bar", *places)
    if counts:
        out[f"{prefix}_n_high"] = each(high, "bar", *places, kind="int")
        out[f"{prefix}_n_low"] = each(low, "bar", *places, kind="int")
        out[f"{prefix}_n"] = each(lambda bar: np.full(len(bar), float(n)), "bar", kind="int")
    return out


# --------------------------------------------------------------------------- efficiency ratio


def efficiency_ratio(p: int, directional: bool, name: str | None = None) -> Spec:
    """Net move over path length of p bars; flat path gives 0, the first p bars are null."""

    def spec(fr: Frames) -> Calc:
        sums, path = R.window_sum(fr, "_move", p)

        def er(bar, net, far):
            return np.where(bar >= p, np.where(far > 0, (net if directional else np.abs(net)) / far, 0.0), np.nan)

        return Calc(
            [
                {"_pc": Look("lag", "close", 1), f"_cl{p}": Look("lag", "close", p)},
                {"_move": each(lambda c, pc: np.abs(c - pc), "close", "_pc"), f"_net{p}": each(lambda c, far: c - far, "close", f"_cl{p}")},
                *sums,
            ],
            {name or f"er_{'dir' if directional else 'abs'}_p{p}": each(er, "bar", f"_net{p}", path)},
            lookback=p + 1,
        )

    return spec


# --------------------------------------------------------------------------- volatility


def true_range_stages(fr: Frames) -> list[dict[str, Look | Each]]:
    """High - low, widened by the gap to the previous close; the first bar has no gap."""
    widest = each(lambda h, lo, pc: np.fmax(h - lo, np.fmax(np.abs(h - pc), np.abs(lo - pc))), "high", "low", "_pc")
    return [{"_pc": Look("lag", "close", 1)}, {"_tr": widest}]


def true_range(name: str = "true_range") -> Spec:
    return lambda fr: Calc(true_range_stages(fr), {name: same("_tr")}, lookback=1)


def rma_stages(fr: Frames, col: str, n: int, tag: str) -> tuple[list[dict[str, Look | Each]], Each]:
    """Wilder average, seeded with the mean of the first n values; null before."""
    if n == 1:
        return [], same(col)

    # the head is read at bar n-1 only, where the last n values are exactly the first
    def b(bar, x, head):
        return np.where(bar < n - 1, 0.0, np.where(bar == n - 1, head / float(n), x / float(n)))

    stages, out = affine_scan_stages(fr, tag, (n - 1) / n, each(b, "bar", col, f"_{tag}_head"))
    return [{f"_{tag}_head": Look("total", col, n)}, *stages], each(lambda bar, x: np.where(bar >= n - 1, x, np.nan), "bar", out)


def rma(col: str, n: int, name: str | None = None) -> Spec:
    def spec(fr: Frames) -> Calc:
        stages, out = rma_stages(fr, col, n, f"rma_{col}_{n}")
        reach = n + (decay_rows((n - 1) / n) if n > 1 else 0)
        return Calc(stages, {name or f"rma_{col}_{n}": out}, lookback=reach)

    return spec


def vola_raw_stages(fr: Frames, method: str, n: int) -> tuple[list[dict[str, Look | Each]], Each, int]:
    """Raw volatility by method name (any case): stages, value, lookback."""
    kind = method.casefold()
    if kind == "atr":
        stages, out = rma_stages(fr, "_tr", n, f"atr{n}")
        return true_range_stages(fr) + stages, out, 1 + n + (decay_rows((n - 1) / n) if n > 1 else 0)
    if kind == "stddev":
        stages, std = R.window_std(fr, "close", n)
        return stages, same(std), n
    if kind == "intraday":
        share = each(lambda h, lo, c: np.where(c > 0, (h - lo) / c, 0.0), "high", "low", "close")
        return [{"_ir": share}, {f"_intra{n}": Look("mean", "_ir", n)}], each(lambda bar, x: np.where(bar >= n - 1, x, np.nan), "bar", f"_intra{n}"), n
    raise KeyError(f"unknown volatility method {method!r}; known: {', '.join(VOLA_METHODS)}")


def vola_raw(method: str, n: int, name: str | None = None) -> Spec:
    def spec(fr: Frames) -> Calc:
        stages, out, reach = vola_raw_stages(fr, method, n)
        return Calc(stages, {name or f"{method.lower()}_{n}": out}, lookback=reach)

    return spec


def atr(n: int, name: str | None = None) -> Spec:
    return vola_raw("ATR", n, name)


def stdev(n: int, name: str | None = None) -> Spec:
    return vola_raw("StdDev", n, name)


def intraday_range(n: int, name: str | None = None) -> Spec:
    return vola_raw("Intraday", n, name)


def vola_position(method: str, n: int, range_len: int, name: str | None = None) -> Spec:
    def spec(fr: Frames) -> Calc:
        stages, raw, reach = vola_raw_stages(fr, method, n)
        col = f"_vr_{method.lower()}{n}"
        stages = _seq(stages, [{col: raw}], R.extent_stages(fr, col, range_len))
        return Calc(stages, {name or f"vola_pos_{method}_l{n}": R.pir(col, range_len)}, lookback=reach + range_len)

    return spec


# --------------------------------------------------------------------------- trend, momentum


def slope_delta(s: int) -> int:
    """Quarter of the scale, rounded half up, at least 2."""
    return max(math.floor(s / 4 + 0.5), 2)


def sma_slope(s: int, name: str | None = None) -> Spec:
    """Relative change of the SMA over slope_delta(s) bars, per mille per bar; non-positive SMA gives 0."""
    d = slope_delta(s)

    def spec(fr: Frames) -> Calc:
        def val(cur, prev):
            return np.where(np.isnan(cur) | np.isnan(prev), np.nan, np.where(cur > 0, (cur - prev) / (float(d) * cur) * 1000.0, 0.0))

        return Calc(
            [*R.sma(fr, s), {f"_sma_close_{s}_d": Look("lag", f"_sma_close_{s}", d)}],
            {name or f"sma_slope_s{s}": each(val, f"_sma_close_{s}", f"_sma_close_{s}_d")},
            lookback=s + d,
        )

    return spec


def linreg_slope(s: int, name: str | None = None) -> Spec:
    """Least-squares slope of the last s closes over their SMA, per mille; non-positive SMA gives 0."""

    def spec(fr: Frames) -> Calc:
        stages, slope = R.window_slope(fr, "close", s)

        def val(bar, total, steep):
            avg = total / float(s)
            return np.where(bar >= s - 1, np.where(avg > 0, steep / avg * 1000.0, 0.0), np.nan)

        return Calc(stages, {name or f"linreg_slope_s{s}": each(val, "bar", f"_tot{s}_close", slope)}, lookback=s)

    return spec


def _ret_stages(fr: Frames, lb: int) -> list[dict[str, Look | Each]]:
    return [
        {f"_cl{lb}": Look("lag", "close", lb), f"_vl{lb}": Look("lag", "volume", lb)},
        {f"_ret{lb}": each(lambda c, far: over(c - far, far), "close", f"_cl{lb}")},
    ]


def price_return(lb: int, name: str | None = None) -> Spec:
    return lambda fr: Calc(_ret_stages(fr, lb), {name or f"price_return_L{lb}": same(f"_ret{lb}")}, lookback=lb)


def mom_divergence(lb: int, name: str | None = None) -> Spec:
    """Price return times relative volume change; the volume base is at least 1."""

    def spec(fr: Frames) -> Calc:
        val = each(lambda ret, v, far: ret * ((v - far) / np.fmax(far, 1.0)), f"_ret{lb}", "volume", f"_vl{lb}")
        return Calc(_ret_stages(fr, lb), {name or f"mom_divergence_L{lb}": val}, lookback=lb)

    return spec


def mom_velocity(lb: int, name: str | None = None) -> Spec:
    """Change of the price return against the previous bar."""

    def spec(fr: Frames) -> Calc:
        stages = [*_ret_stages(fr, lb), {f"_pret{lb}": Look("lag", f"_ret{lb}", 1)}]
        return Calc(
            stages, {name or f"mom_velocity_L{lb}": each(lambda a, b: a - b, f"_ret{lb}", f"_pret{lb}")}, lookback=lb + 1
        )

    return spec


# --------------------------------------------------------------------------- GARCH, HAR


def gjr_asym(name: str = "gjr_asym") -> Spec:
    """Leverage-aware against symmetric conditional variance, squeezed to [-1, 1]; null until 252 returns.

    Both variances follow v[t] = 0.9 v[t-1] + b[t] with b >= 1e-12, so the 1e-12 floor never binds.
    """

    def spec(fr: Frames) -> Calc:
        n = LONG_RUN_WINDOW
        sum_st, total = R.window_sum(fr, "_r2", n)

        def lr_var(bar, r2, t):
            return np.fmax(np.where(bar >= n - 1, t / float(n), r2), GJR_FLOOR)

        def b(bar, lrv, pr2, plr, leverage):
            first = bar == 0
            omega = np.fmax(lrv * (1.0 - GJR_ALPHA - GJR_BETA - GJR_GAMMA / 2.0), GJR_FLOOR)
            share = GJR_ALPHA + GJR_GAMMA * (np.where(plr < 0, 1.0, 0.0) if leverage else 0.5)
            return omega + share * np.where(first, lrv, pr2) + np.where(first, GJR_BETA * lrv, 0.0)

        inputs = ("bar", "_lrv", "_pr2", "_plr")
        g_st, g = affine_scan_stages(fr, "gjr", GJR_BETA, each(lambda *x: b(*x, True), *inputs))
        s_st, s = affine_scan_stages(fr, "sym", GJR_BETA, each(lambda *x: b(*x, False), *inputs))
        stages = [
            {"_pc": Look("lag", "close", 1)},
            {"_lr": each(lambda c, pc: log_ratio(c, np.where(np.isnan(pc), c, pc)), "close", "_pc")},
            {"_r2": each(lambda x: x * x, "_lr")},
            {"_plr": Look("lag", "_lr", 1), "_pr2": Look("lag", "_r2", 1), **sum_st[0]},
            {"_lrv": each(lr_var, "bar", "_r2", total)},
            *[x | y for x, y in zip(g_st, s_st)],
        ]
        out = each(lambda bar, x, y: np.where(bar >= n - 1, unit((over(x, y) - 1.0) / GJR_NORM), np.nan), "bar", g, s)
        return Calc(stages, {name: out}, lookback=n + 2 + decay_rows(GJR_BETA))

    return spec


def gk_variance() -> Column:
    """Garman-Klass variance of one bar, floored."""
    hl = safe_log_ratio(F.col("high"), F.col("low"))
    co = safe_log_ratio(close_(), F.col("open"))
    return F.greatest(F.lit(0.5) * hl * hl - F.lit(2.0 * math.log(2.0) - 1.0) * co * co, F.lit(GK_FLOOR))


def har_vol(name: str = "har_vol") -> Spec:
    """Day / week / month variance forecast against today's variance, in [-1, 1]; null before 22 bars."""

    def spec(fr: Frames) -> Calc:
        def gk(h, lo, c, o):
            hl, co = log_ratio(h, lo), log_ratio(c, o)
            return np.fmax(0.5 * hl * hl - (2.0 * math.log(2.0) - 1.0) * co * co, GK_FLOOR)

        def val(bar, day, week, month):
            fc = np.fmax(HAR_W[0] * day + HAR_W[1] * np.where(bar >= HAR_WEEK - 1, week, day) + HAR_W[2] * month, GK_FLOOR)
            return np.where(bar >= HAR_MONTH - 1, unit((np.sqrt(fc) / np.sqrt(day) - 1.0) / HAR_NORM), np.nan)

        return Calc(
            [{"_gk": each(gk, "high", "low", "close", "open")}, {"_gkw": Look("mean", "_gk", HAR_WEEK), "_gkm": Look("mean", "_gk", HAR_MONTH)}],
            {name: each(val, "bar", "_gk", "_gkw", "_gkm")},
            lookback=HAR_MONTH,
        )

    return spec


# --------------------------------------------------------------------------- pivots


def pivots(lb: int, high: str = "pivot_high", low: str = "pivot_low") -> Spec:
    """Strict extreme of the symmetric window of lb bars on each side; incomplete windows are no pivots."""

    def spec(fr: Frames) -> Calc:
        def extreme(bar, n, x, before, after):
            full = ((bar >= lb) & (bar + lb < n)).astype(np.float64)
            return both(both(full, known(x > before, x, before)), known(x > after, x, after))

        return Calc(
            [
                {
                    f"_ph_b{lb}": Look("max_before", "high", lb),
                    f"_ph_a{lb}": Look("max_after", "high", lb),
                    f"_pl_b{lb}": Look("min_before", "low", lb),
                    f"_pl_a{lb}": Look("min_after", "low", lb),
                }
            ],
            {
                high: each(extreme, "bar", "n_bars", "high", f"_ph_b{lb}", f"_ph_a{lb}", kind="boolean"),
                low: each(lambda bar, n, *xs: extreme(bar, n, *(-x for x in xs)), "bar", "n_bars", "low", f"_pl_b{lb}", f"_pl_a{lb}", kind="boolean"),
            },
            lookback=lb,
            lead=lb,
        )

    return spec


# --------------------------------------------------------------------------- overextension


def dist_above_sma_z(length: int, z_win: int, name: str | None = None) -> Spec:
    """tanh of the distance above the long mean in trailing standard deviations; flat window gives 0."""

    def spec(fr: Frames) -> Calc:
        stages, sd = R.window_std(fr, "close", z_win)
        total, m = R.window_sum(fr, "close", length)
        stages = _together(stages, total)

        def z(c, s, d):
            far = s / float(length)
            return np.where(np.isnan(far) | np.isnan(d), np.nan, np.where(d > 0, np.tanh((c - far) / d), 0.0))

        return Calc(stages, {name or f"dist_above_sma_z_l{length}": each(z, "close", m, sd)}, lookback=max(length, z_win))

    return spec


def drawdown_from_high(lb: int, name: str | None = None) -> Spec:
    """Distance below the highest close of the last lb bars, <= 0."""

    def spec(fr: Frames) -> Calc:
        def val(bar, c, top):
            return np.where(bar >= lb - 1, np.where(top > 0, (c - top) / top, 0.0), np.nan)

        return Calc(
            R.extent_stages(fr, "close", lb),
            {name or f"drawdown_from_high_l{lb}": each(val, "bar", "close", f"_hi_close_{lb}")},
            lookback=lb,
        )

    return spec


def realized_vol_stages(fr: Frames, win: int) -> list[dict[str, Look | Each]]:
    stages, std = R.window_std(fr, "_logret", win)
    return [{"_pc": Look("lag", "close", 1)}, {"_logret": each(R.log_return, "close", "_pc")}, *stages, {f"_rv{win}": same(std)}]


def realized_vol(win: int, name: str = "realized_vol") -> Spec:
    return lambda fr: Calc(realized_vol_stages(fr, win), {name: same(f"_rv{win}")}, lookback=win + 1)


def log_returns(name: str = "log_return") -> Spec:
    return lambda fr: Calc([{"_pc": Look("lag", "close", 1)}], {name: each(R.log_return, "close", "_pc")}, lookback=1)


def realized_vol_pct(win: int, range_len: int, name: str = "realized_vol_pct") -> Spec:
    def spec(fr: Frames) -> Calc:
        stages = _seq(realized_vol_stages(fr, win), R.extent_stages(fr, f"_rv{win}", range_len))
        return Calc(stages, {name: R.pir(f"_rv{win}", range_len)}, lookback=win + 1 + range_len)

    return spec


def vol_of_vol(win: int, name: str = "vol_of_vol") -> Spec:
    def spec(fr: Frames) -> Calc:
        vov = f"_vov{win}"
        more, std = R.window_std(fr, f"_rv{win}", win)
        stages = _seq(
            realized_vol_stages(fr, win),
            more,
            [{vov: same(std)}],
            R.extent_stages(fr, vov, win),
        )
        return Calc(stages, {name: R.pir(vov, win)}, lookback=3 * win + 1)

    return spec


def up_streak_norm(cap: int, name: str = "up_streak_norm") -> Spec:
    """Consecutive rising closes, saturated at cap, over cap; only the last cap bars can matter."""

    def spec(fr: Frames) -> Calc:
        fall = each(lambda bar, c, pc: np.where(np.isnan(pc) | (c <= pc), bar, np.nan), "bar", "close", "_pc")
        run = each(lambda bar, at: np.fmin(bar - np.where(np.isnan(at), -cap, at), cap) / float(cap), "bar", f"_fall{cap}")
        return Calc(
            [{"_pc": Look("lag", "close", 1)}, {"_fell": fall}, {f"_fall{cap}": Look("max", "_fell", cap + 1)}],
            {name: run},
            lookback=cap + 1,
        )

    return spec
