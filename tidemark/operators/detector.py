"""Rule detector: hard gates, a vote count and a cooldown, per preset, side and bar."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.functions.looks import Each, Look, each, over, same
from tidemark.layout import CHUNK_ROWS, DAY, Calc, Frames, Spec, asof_backward, carry_states, compute, running_carry
from tidemark.operators import features as X
from tidemark.session import materialise, spread

VOTES = ("trend", "pivot_drift", "volume", "momentum", "momentum_velocity", "volatility", "gjr_asym", "har_vol")
PIVOT_LB = 20


@dataclass(frozen=True)
class SidePreset:
    """Parameters of one side (high or low) of a preset."""

    side: str
    s_detect: int
    scale_start: int
    scale_end: int
    scale_step: int
    min_duration: int
    cooldown: int
    price_lb: int
    vola_range: int
    er_period: int
    pct_extreme: float
    min_agreement: float
    dur_pct: float
    confirm_count: int
    vol_surge: float
    scale_div: float
    slope: float
    vola_high: float
    drift_lb: int
    drift_thr: float
    drift_gate: float
    drift_bias: int
    gjr_thr: float
    har_thr: float
    velocity_mode: str
    velocity_thr: float
    vola_method: str
    use_edge: bool
    edge_window: int
    er_gate: bool
    er_directional: bool
    votes: tuple[str, ...]
    price_gate: bool = True
    strict_scales: tuple[int, ...] = ()

    @property
    def high(self) -> bool:
        return self.side == "high"

    @property
    def fast_len(self) -> int:
        return max(math.floor(self.s_detect / 4 + 0.5), 2)


# The default preset.
DEFAULT_HIGH = SidePreset(
    side="high", s_detect=44, scale_start=10, scale_end=179, scale_step=20, min_duration=20, cooldown=14,
    price_lb=97, vola_range=120, er_period=58, pct_extreme=0.7440, min_agreement=0.3703, dur_pct=0.6365,
    confirm_count=2, vol_surge=1.5240, scale_div=0.1563, slope=0.2371, vola_high=0.5283, drift_lb=14,
    drift_thr=0.0478, drift_gate=1.0751, drift_bias=0, gjr_thr=0.1227, har_thr=0.3990, velocity_mode="Reversal",
    velocity_thr=0.0295, vola_method="StdDev", use_edge=True, edge_window=28, er_gate=False, er_directional=False,
    votes=("trend", "pivot_drift", "volume", "momentum_velocity", "volatility"),
)
DEFAULT_LOW = SidePreset(
    side="low", s_detect=52, scale_start=13, scale_end=215, scale_step=5, min_duration=4, cooldown=3,
    price_lb=60, vola_range=184, er_period=36, pct_extreme=0.7297, min_agreement=0.5595, dur_pct=0.6241,
    confirm_count=2, vol_surge=1.8537, scale_div=0.3094, slope=0.3338, vola_high=0.71, drift_lb=4,
    drift_thr=0.0364, drift_gate=5.4354, drift_bias=0, gjr_thr=0.3361, har_thr=0.4080, velocity_mode="Trend",
    velocity_thr=0.0127, vola_method="ATR", use_edge=False, edge_window=11, er_gate=True, er_directional=True,
    votes=("trend", "pivot_drift", "volume", "momentum_velocity"),
)
DEFAULT_PRESET = (DEFAULT_HIGH, DEFAULT_LOW)


def preset_grid(base: SidePreset, **axes: Sequence) -> list[tuple[str, SidePreset]]:
    """Named variants of a side: every combination of the given field values."""
    out: list[tuple[str, SidePreset]] = [("base", base)]
    for field, values in axes.items():
        out = [(f"{n}|{field}={v}", replace(p, **{field: v})) for n, p in out for v in values]
    return out


# --------------------------------------------------------------------------- pieces as calculations


def agreement_spec(p: SidePreset) -> Spec:
    if p.strict_scales:
        return strict_agreement(p.strict_scales, p.pct_extreme)
    return X.agreement(p.scale_start, p.scale_end, p.scale_step, p.pct_extreme, "agree", counts=True)


def strict_agreement(scales: Sequence[int], pct: float, prefix: str = "agree") -> Spec:
    """Agreement over a fixed list of scales whose ratio is undefined until its average is."""

    def spec(fr: Frames) -> Calc:
        stages: list[dict[str, Look | Each]] = []
        places = []

        def ratio(c, avg):
            return np.where(np.isnan(avg), np.nan, np.where(avg > 0, c / avg, 1.0))

        def put(depth: int, cols: dict[str, Look | Each]) -> None:
            stages.extend({} for _ in range(depth + 1 - len(stages)))
            stages[depth].update(cols)

        for s in scales:
            lb, col, place = max(s, 20), f"_q{s}", f"_qp{s}"
            for d, st in enumerate([*R.sma(fr, s), {col: each(ratio, "close", f"_sma_close_{s}")}, *R.extent_stages(fr, col, lb), {place: R.pir(col, lb)}]):
                put(d, st)
            places.append(place)
        out = X.shares(places, pct, prefix, True)
        return Calc(stages, out, lookback=2 * max([20, *scales]))

    return spec


def detect_pir(s: int, name: str = "pir_detect") -> Spec:
    """Position of close / SMA(s) in its history, undefined while the average is."""
    lb = max(s, 20)

    def spec(fr: Frames) -> Calc:
        col = f"_rd{s}"
        ratio = {col: each(over, "close", f"_sma_close_{s}")}
        stages = [*R.sma(fr, s), ratio, *R.extent_stages(fr, col, lb)]
        return Calc(stages, {name: R.pir(col, lb)}, lookback=s + lb)

    return spec


def volume_surge(fast: int, slow: int, name: str = "vol_surge") -> Spec:
    """Short over long mean volume."""

    def spec(fr: Frames) -> Calc:
        val = each(lambda bar, a, b: np.where((bar >= fast - 1) & (bar >= slow - 1), over(a, b), np.nan), "bar", f"_vm{fast}", f"_vm{slow}")
        return Calc([{f"_vm{n}": Look("mean", "volume", n) for n in (fast, slow)}], {name: val}, lookback=slow)

    return spec


def price_gate(lb: int, high: bool, name: str = "price_ok") -> Spec:
    """High at or above the highest of the lb bars before (low mirrored); false until they exist."""
    col = "high" if high else "low"

    def spec(fr: Frames) -> Calc:
        fn = "_hi" if high else "_lo"
        ref = f"{fn}_{col}_{lb}_p"
        stages = [*R.extent_stages(fr, col, lb), {ref: Look("lag", f"{fn}_{col}_{lb}", 1)}]
        val = each(lambda bar, x, at: (bar >= lb) & (x >= at if high else x <= at), "bar", col, ref, kind="boolean")
        return Calc(stages, {name: val}, lookback=lb + 1)

    return spec


def er_falling(p: int, directional: bool, name: str = "er_ok", value: str = "er_val") -> Spec:
    """Efficiency ratio below that of the bar before; undefined counts as 0."""
    now = f"_er0_{p}_{int(directional)}"

    def spec(fr: Frames) -> Calc:
        base = X.efficiency_ratio(p, directional, "_er_val")(fr)
        er = base.out["_er_val"]
        stages = [*base.stages, {now: each(lambda *xs: np.nan_to_num(er.fn(*xs), nan=0.0, posinf=np.inf, neginf=-np.inf), *er.cols)}]
        stages.append({f"{now}_p": Look("lag", now, 1)})
        falling = each(lambda x, before: x < np.where(np.isnan(before), 0.0, before), now, f"{now}_p", kind="boolean")
        return Calc(stages, {value: same(now), name: falling}, lookback=p + 2)

    return spec


def momentum_inputs(s: int, divergence: str = "mom_div", velocity: str = "mom_vel") -> Spec:
    """Momentum divergence and velocity with undefined values as 0."""

    def spec(fr: Frames) -> Calc:
        div = X.mom_divergence(s, "d")(fr)
        d = div.out["d"]

        def zero(x):
            return np.where(np.isnan(x), 0.0, x)

        stages = [*div.stages, {f"_r0_{s}": each(zero, f"_ret{s}")}, {f"_r0p_{s}": Look("lag", f"_r0_{s}", 1)}]
        out = {divergence: each(lambda *xs: zero(d.fn(*xs)), *d.cols), velocity: each(lambda a, b: zero(a - b), f"_r0_{s}", f"_r0p_{s}")}
        return Calc(stages, out, lookback=s + 2)

    return spec


def side_specs(p: SidePreset) -> list[Spec]:
    """All windowed inputs of one side; blocks that no vote uses are left out."""
    specs = [
        agreement_spec(p),
        detect_pir(p.s_detect),
        X.sma_slope(p.s_detect, "slope_val"),
        X.linreg_slope(p.s_detect, "linreg_val"),
        volume_surge(p.fast_len, p.s_detect),
        momentum_inputs(p.s_detect),
        price_gate(p.price_lb, p.high),
        er_falling(p.er_period, p.er_directional),
        X.pivots(PIVOT_LB),
    ]
    if "volatility" in p.votes:
        specs.append(X.vola_position(p.vola_method, p.s_detect, p.vola_range, "vola_pos"))
    if "gjr_asym" in p.votes:
        specs.append(X.gjr_asym())
    if "har_vol" in p.votes:
        specs.append(X.har_vol())
    return specs


# --------------------------------------------------------------------------- stateful pieces


def duration_at_extreme(df: DataFrame, hit: Column, **layout) -> DataFrame:
    """`duration`: hits since the last two misses in a row.

    Hits up to now minus hits up to the last reset; both run across chunks. Needs `bar` and the previous hit.
    """
    return durations_at_extreme(df, {"duration": hit}, **layout)


def durations_at_extreme(df: DataFrame, hits: dict[str, Column], **layout) -> DataFrame:
    """A column for each of `hits`, see `duration_at_extreme`; all in the same passes."""
    kw = {k: layout[k] for k in ("max_bars", "chunk_rows") if k in layout}
    flagged = df.withColumns({f"_hit_{n}": F.coalesce(hit, F.lit(False)) for n, hit in hits.items()})

    def prev(fr: Frames) -> Calc:
        reset = {f"_reset_{n}": ~F.col(f"_hit_{n}") & ~F.coalesce(f"_prev_{n}", F.lit(True)) for n in hits}
        return Calc([{f"_prev_{n}": fr.lag(f"_hit_{n}", 1) for n in hits}], reset, lookback=1)

    flagged = compute(flagged, [prev], **layout)
    counted = running_carry(flagged, sums={f"_h_{n}": F.col(f"_hit_{n}").cast("long") for n in hits}, **kw)
    reset = running_carry(counted, maxs={f"_hr_{n}": F.when(F.col(f"_reset_{n}"), F.col(f"_h_{n}")) for n in hits}, **kw)
    out = reset.withColumns({n: F.col(f"_h_{n}") - F.coalesce(f"_hr_{n}", F.lit(0)) for n in hits})
    return out.drop(*(f"_{k}_{n}" for n in hits for k in ("hit", "reset", "h", "hr")))


def pivot_table(df: DataFrame, lb: int = PIVOT_LB) -> DataFrame:
    """Confirmed pivots (symbol, confirm_bar, kind, value): known `lb` bars after the extreme, high before low."""
    both = F.array(
        F.when(F.col("pivot_high"), F.struct(F.lit(0).alias("kind"), F.col("high").alias("value"))),
        F.when(F.col("pivot_low"), F.struct(F.lit(1).alias("kind"), F.col("low").alias("value"))),
    )
    flat = df.select("symbol", (F.col("bar") + lb).alias("confirm_bar"), F.explode(both).alias("_p")).filter("_p is not null")
    return flat.select("symbol", "confirm_bar", "_p.kind", "_p.value")


def pivot_drift(pivots: DataFrame, lookback: int, chunk_rows: int = CHUNK_ROWS, max_bars: int | None = None) -> DataFrame:
    """Mean relative step over the last max(lookback, 2) confirmed pivots; null while there are fewer.

    The pivot list is a series of its own, ordered by (confirm_bar, kind), and is laid out like one.
    """
    n = max(lookback, 2)
    series = pivots.withColumn("time", F.col("confirm_bar") * 2 + F.col("kind"))

    def spec(fr: Frames) -> Calc:
        start = F.col("_start")
        val = (F.col("value") - start) / F.greatest(F.abs(start), F.lit(1e-9)) / F.lit(float(n - 1))
        return Calc([{"_start": fr.lag("value", n - 1)}], {"drift": val}, lookback=n)

    bound = None if max_bars is None else 2 * max_bars + 2
    return compute(series, [spec], bar_seconds=1, chunk_rows=chunk_rows, max_bars=bound)


def with_drift(df: DataFrame, lookback: int, max_bars: int | None = None, chunk_rows: int = CHUNK_ROWS, **_) -> DataFrame:
    """`pivot_drift` as known before the bar: latest pivot confirmed strictly earlier, undefined as 0."""
    drift = pivot_drift(pivot_table(df), lookback, chunk_rows, max_bars).select("symbol", "time", "drift")
    left = df.withColumnsRenamed({"time": "_time"}).withColumn("time", F.col("bar") * 2)
    bound = None if max_bars is None else 3 * max_bars
    out = asof_backward(left, drift, ["drift"], bar_seconds=1, chunk_rows=chunk_rows, max_bars=bound)
    return out.drop("time").withColumnRenamed("_time", "time").withColumn("pivot_drift", F.coalesce("drift", F.lit(0.0))).drop("drift")


def fire_with_cooldown(candidates: DataFrame, cooldown: int, by: Sequence[str] = (), segment_bars: int = 4_096, column: str | None = None) -> DataFrame:
    """Candidates (by, symbol, bar) that fire: more than `cooldown` bars after the previous fire of the series.

    With `column` each series has its own cooldown there, the same in all its rows and at most `cooldown`.

    Segment by segment: what a segment hands on is only how many of its successor's first bars are still blocked, so
    the possible hand-overs are tabulated per segment, chained, and each segment is replayed from its own start.
    """
    keys = [*by, "symbol"]
    size = max(segment_bars, cooldown + 1)
    segs = spread(materialise(
        candidates.withColumn("_seg", F.floor(F.col("bar") / F.lit(size)))
        .withColumn("_wait", F.lit(cooldown) if column is None else F.col(column).cast("int"))
        .groupBy(*keys, "_seg", "_wait")
        .agg(F.sort_array(F.collect_list(F.col("bar").cast("long"))).alias("_bars"))
    ), *keys, "_seg")
    begin = F.col("_seg") * F.lit(size)

    def replay(state: Column) -> Column:
        none = F.expr("cast(array() as array<bigint>)")
        zero = F.struct((begin + state - 1).cast("long").alias("free"), none.alias("fired"))

        def step(acc: Column, b: Column) -> Column:
            hit = F.struct((b + F.col("_wait") + 1).alias("free"), F.array_append(acc["fired"], b).alias("fired"))
            return F.when(b >= acc["free"], hit).otherwise(acc)

        return F.aggregate("_bars", zero, step)

    def handed(state: Column) -> Column:
        left = replay(state)["free"] - (begin + F.lit(size))
        return (F.greatest(left, F.lit(0)) + 1).cast("int")

    maps = segs.withColumn("_end", F.transform(F.sequence(F.lit(1), F.col("_wait") + 1), handed))
    starts = carry_states(maps, keys, "_seg", "_end", idle=1)
    fired = segs.join(starts, [*keys, "_seg"]).withColumn("bar", F.explode(replay(F.col("start"))["fired"]))
    return fired.select(*keys, "bar")


# --------------------------------------------------------------------------- votes, gates, signals


def vote_states(p: SidePreset) -> dict[str, Column]:
    """State of every vote the preset uses."""
    hi = p.high

    def beyond(col: str, thr: float) -> Column:
        return F.col(col) > thr if hi else F.col(col) < -thr

    vel, t = F.col("mom_vel"), abs(p.velocity_thr)
    upward = (p.velocity_mode == "Trend") == hi
    all_votes = {
        "trend": lambda: beyond("slope_val", p.slope) & beyond("linreg_val", p.slope),
        "pivot_drift": lambda: F.col("pivot_drift") < -p.drift_thr if hi else F.col("pivot_drift") > p.drift_thr,
        "volume": lambda: F.col("vol_surge") < 1.0 / p.vol_surge if hi else F.col("vol_surge") > p.vol_surge,
        "momentum": lambda: F.col("mom_div") < 0,
        "momentum_velocity": lambda: vel >= t if upward else vel <= -t,
        "volatility": lambda: F.col("vola_pos") > p.vola_high,
        "gjr_asym": lambda: F.col("gjr_asym") <= -p.gjr_thr if hi else F.col("gjr_asym") >= p.gjr_thr,
        "har_vol": lambda: F.col("har_vol") >= p.har_thr,
    }
    return {f"vote_{v}": F.coalesce(all_votes[v](), F.lit(False)) for v in VOTES if v in p.votes}


def edge_spec(names: Sequence[str], window: int) -> Spec:
    """Votes that were not already set `window` bars ago."""

    def spec(fr: Frames) -> Calc:
        stage = {f"_{n}_old": fr.lag(n, window) for n in names}
        out = {f"{n}_eff": F.col(n) & ~F.coalesce(F.col(f"_{n}_old"), F.lit(False)) for n in names}
        return Calc([stage], out, lookback=window)

    return spec


def windowed_inputs(bars: DataFrame, p: SidePreset, **layout) -> DataFrame:
    """All windowed inputs of one side, written once."""
    return materialise(compute(bars, side_specs(p), **layout))


def inputs_key(p: SidePreset) -> SidePreset:
    """The preset with everything blanked that the windowed inputs do not depend on."""
    windowed = tuple(v for v in p.votes if v in ("volatility", "gjr_asym", "har_vol"))
    return replace(
        p, min_duration=0, cooldown=0, min_agreement=0.0, dur_pct=0.0, confirm_count=0, vol_surge=0.0, scale_div=0.0,
        slope=0.0, vola_high=0.0, drift_lb=0, drift_thr=0.0, drift_gate=0.0, drift_bias=0, gjr_thr=0.0, har_thr=0.0,
        velocity_mode="", velocity_thr=0.0, use_edge=False, edge_window=0, er_gate=False, votes=windowed, price_gate=False,
    )


def side_frame(bars: DataFrame, p: SidePreset, inputs: DataFrame | None = None, **layout) -> DataFrame:
    """Every intermediate value of one side per bar, up to the candidate flag.

    The stateful steps read back only the columns they need from the written inputs.
    """
    agree = F.col("agree_high" if p.high else "agree_low")
    df = windowed_inputs(bars, p, **layout) if inputs is None else inputs
    # the drift's union first: the windows after it stay on its partitions
    df = with_drift(df, p.drift_lb, **layout)
    df = duration_at_extreme(df, agree > p.dur_pct, **layout)
    votes = vote_states(p)
    df = df.withColumns(votes)
    if p.use_edge:
        df = compute(df, [edge_spec(list(votes), p.edge_window)], **layout)
    else:
        df = df.withColumns({f"{v}_eff": F.col(v) for v in votes})
    drift_up = F.col("pivot_drift") > p.drift_thr
    pir = F.col("pir_detect") if p.high else F.lit(1.0) - F.col("pir_detect")
    counted = len([v for v in p.votes if v != "pivot_drift"])
    bias = 0
    if "pivot_drift" in p.votes:
        bias = F.when(drift_up, F.lit(p.drift_bias if p.high else -p.drift_bias)).otherwise(F.lit(0))
    need = F.greatest(F.lit(1), F.least(F.lit(max(counted, 1)), F.lit(p.confirm_count) + bias))
    df = df.withColumns(
        {
            "scale_divergence": pir - agree,
            "ms_agree": agree >= p.min_agreement,
            "dur_flag": F.col("duration") >= p.min_duration,
            "confirms": sum((F.col(f"{v}_eff").cast("int") for v in votes), F.lit(0)),
            "required": need,
        }
    )
    gate = F.col("ms_agree") & F.col("dur_flag")
    gate = gate & ~F.coalesce(F.abs("scale_divergence") > p.scale_div, F.lit(False))
    if p.price_gate:
        gate = gate & F.col("price_ok")
    if p.er_gate:
        gate = gate & F.col("er_ok")
    if p.high and "pivot_drift" in p.votes:
        gate = gate & ~(F.col("pivot_drift") > p.drift_thr * p.drift_gate)
    df = df.withColumn("gate", F.coalesce(gate, F.lit(False)))
    return df.withColumn("candidate", F.col("gate") & (F.col("confirms") >= F.col("required")))


def rising(fired: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fires whose bar before did not fire."""
    keys = [*by, "symbol", "bar"]
    return fired.join(fired.withColumn("bar", F.col("bar") + 1).select(*keys), keys, "left_anti")


def detect_side(bars: DataFrame, p: SidePreset, **layout) -> DataFrame:
    """side_frame plus `fired` and `signal` (rising edge) and bars since the last fire."""
    df = side_frame(bars, p, **layout)
    fired = fire_with_cooldown(df.filter("candidate").select("symbol", "bar"), p.cooldown)
    edges = rising(fired).withColumn("_edge", F.lit(True))
    marks = fired.join(edges, ["symbol", "bar"], "left").select("symbol", F.col("bar").alias("time"), F.col("bar").alias("_last"), F.coalesce("_edge", F.lit(False)).alias("_edge"))
    kw = {k: layout[k] for k in ("max_bars", "chunk_rows") if k in layout}
    # every bar meets the latest fire up to it in one pass: that of its own bar says whether it fired
    left = df.withColumnRenamed("time", "_time").withColumn("time", F.col("bar"))
    out = asof_backward(left, marks, ["_last", "_edge"], strict=False, bar_seconds=1, **kw).drop("time").withColumnRenamed("_time", "time")
    now = F.coalesce(F.col("_last") == F.col("bar"), F.lit(False))
    since = F.coalesce(F.col("bar") - F.col("_last"), F.col("bar") + F.lit(1000))
    return out.withColumns({"fired": now, "signal": now & F.coalesce("_edge", F.lit(False)), "bars_since_fire": since}).drop("_last", "_edge")


def fires(bars: DataFrame, p: SidePreset, inputs: DataFrame | None = None, **layout) -> DataFrame:
    """(symbol, bar, time) of the fires of one side."""
    df = side_frame(bars, p, inputs, **layout).filter("candidate").select("symbol", "bar", "time")
    fired = fire_with_cooldown(df.select("symbol", "bar"), p.cooldown)
    return df.join(fired, ["symbol", "bar"])


def detect_turns(bars: DataFrame, preset: Sequence[SidePreset] = DEFAULT_PRESET, **layout) -> DataFrame:
    """Signals of all sides: (symbol, time, bar, side, fired, signal)."""
    parts = [
        detect_side(bars, p, **layout).select("symbol", "time", "bar", F.lit(p.side).alias("side"), "fired", "signal")
        for p in preset
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sweep(bars: DataFrame, presets: Sequence[tuple[str, SidePreset]], **layout) -> DataFrame:
    """(preset, side, symbol, bar, time) of the fires of many presets.

    Presets that differ only in thresholds share one table of windowed inputs.
    """
    inputs: dict[SidePreset, DataFrame] = {}
    parts = []
    for n, p in presets:
        key = inputs_key(p)
        if key not in inputs:
            inputs[key] = windowed_inputs(bars, p, **layout)
        hit = fires(bars, p, inputs[key], **layout)
        parts.append(hit.select(F.lit(n).alias("preset"), F.lit(p.side).alias("side"), "symbol", "bar", "time"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
