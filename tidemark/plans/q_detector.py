"""Rule detector: every piece on its own, then the whole chain."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.functions import scalars as C
from tidemark.layout import Calc, compute
from tidemark.operators import detector as D
from tidemark.operators import events as EV
from tidemark.operators import features as X
from tidemark.operators import labels as L
from tidemark.operators import presets as PS
from tidemark.plans import base as B
from tidemark.plans import sqltext as Q
from tidemark.plans.base import SUPP, query, r6, rounded
from tidemark.plans.q_features import feature
from tidemark.plans.q_labels_splits import LOOSE
from tidemark.session import materialise

HIGH, LOW = D.DEFAULT_PRESET
# rougher thresholds than the default, so that the chain fires on the test series
EASY_HIGH = replace(
    HIGH, scale_start=5, scale_end=45, scale_step=10, min_duration=2, cooldown=5, price_lb=5, pct_extreme=0.6,
    min_agreement=0.4, dur_pct=0.3, scale_div=0.9, confirm_count=1, drift_bias=1, drift_lb=3, vola_method="ATR",
    s_detect=12, vola_range=40, edge_window=4, er_gate=True, er_period=10, drift_gate=50.0,
    votes=D.VOTES,
)
EASY_LOW = replace(
    LOW, scale_start=5, scale_end=45, scale_step=10, min_duration=1, cooldown=3, price_lb=5, pct_extreme=0.6,
    min_agreement=0.4, dur_pct=0.3, scale_div=0.9, confirm_count=1, drift_bias=1, drift_lb=3, vola_method="Intraday",
    s_detect=16, vola_range=40, use_edge=True, edge_window=3, er_gate=False, er_period=10, votes=D.VOTES,
)


# --------------------------------------------------------------------------- SQL pieces


def agree_sql(p: D.SidePreset) -> list[dict[str, str]]:
    return Q.agreement(p.scale_start, p.scale_end, p.scale_step, p.pct_extreme, "agree_high", "agree_low")


def detect_pir_sql(s: int) -> list[dict[str, str]]:
    return [Q.csum(), Q.sma(s), {f"rd{s}": f"close / NULLIF(sma_close_{s}, 0)"}, *Q.pir(f"rd{s}", max(s, 20), "pir_detect")]


def surge_sql(p: D.SidePreset) -> list[dict[str, str]]:
    f, s = p.fast_len, p.s_detect
    a = f"CASE WHEN bar >= {f - 1} THEN {Q.over('avg(volume)', -(f - 1))} END"
    b = f"CASE WHEN bar >= {s - 1} THEN {Q.over('avg(volume)', -(s - 1))} END"
    return [{"vf": a, "vs": b}, {"vol_surge": "vf / NULLIF(vs, 0)"}]


def mom_sql(s: int) -> list[dict[str, str]]:
    return [
        *Q.momentum(s)[:2],
        {f"mom_divergence_L{s}": Q.momentum(s)[2][f"mom_divergence_L{s}"], "r0": f"coalesce(price_return_L{s}, 0)"},
        {"mom_div": f"coalesce(mom_divergence_L{s}, 0)", "r0p": Q.lag("r0")},
        {"mom_vel": "coalesce(r0 - r0p, 0)"},
    ]


def gate_sql(p: D.SidePreset) -> list[dict[str, str]]:
    lb = p.price_lb
    if p.high:
        return [{"pref": Q.over("max(high)", -lb, -1)}, {"price_ok": f"coalesce(bar >= {lb} AND high >= pref, false)"}]
    return [{"pref": Q.over("min(low)", -lb, -1)}, {"price_ok": f"coalesce(bar >= {lb} AND low <= pref, false)"}]


def er_sql(p: D.SidePreset) -> list[dict[str, str]]:
    return [
        *Q.er(p.er_period, p.er_directional, "er_raw"),
        {"er_val": "coalesce(er_raw, 0)"},
        {"er_prev": f"coalesce({Q.lag('er_val')}, 0)"},
        {"er_ok": "er_val < er_prev"},
    ]


def vola_sql(p: D.SidePreset) -> list[dict[str, str]]:
    """vola_pos for the non-recursive methods."""
    n = p.s_detect
    if p.vola_method == "StdDev":
        return [{"vr": f"CASE WHEN bar >= {n - 1} THEN {Q.over('stddev_pop(close)', -(n - 1))} END"}, *Q.pir("vr", p.vola_range, "vola_pos")]
    ir = "CASE WHEN close > 0 THEN (high - low) / close ELSE CAST(0 AS DOUBLE) END"
    return [{"ir": ir}, {"vr": f"CASE WHEN bar >= {n - 1} THEN {Q.avg_in_order('ir', n)} END"}, *Q.pir("vr", p.vola_range, "vola_pos")]


def duration_sql(hit: str) -> list[dict[str, str]]:
    return [
        {"hit": f"CASE WHEN coalesce({hit}, false) THEN 1 ELSE 0 END"},
        {"reset": f"CASE WHEN hit = 0 AND {Q.lag('hit')} = 0 THEN 1 ELSE 0 END"},
        {"isl": Q.over("sum(reset)")},
        {"duration": "CAST(sum(hit) OVER (PARTITION BY symbol, isl ORDER BY time) AS BIGINT)"},
    ]


def pivots_sql(base: str, n: int, lb: int = D.PIVOT_LB, name: str = "dr") -> str:
    """CTEs ending in `<name>`(symbol, bar, pivot_drift): drift known before each bar."""
    full = f"bar >= {lb} AND bar + {lb} < n_bars"
    return f"""pv_{name} AS (SELECT symbol, time, bar, n_bars, high, low, {Q.over('max(high)', -lb, -1)} AS hb, {Q.over('max(high)', 1, lb)} AS ha,
  {Q.over('min(low)', -lb, -1)} AS lb_, {Q.over('min(low)', 1, lb)} AS la FROM {base}),
pt_{name} AS (
  SELECT symbol, bar + {lb} AS confirm_bar, 0 AS kind, high AS value FROM pv_{name} WHERE {full} AND high > hb AND high > ha
  UNION ALL SELECT symbol, bar + {lb}, 1, low FROM pv_{name} WHERE {full} AND low < lb_ AND low < la),
ps_{name} AS (SELECT *, lag(value, {n - 1}) OVER (PARTITION BY symbol ORDER BY confirm_bar, kind) AS start FROM pt_{name}),
pd_{name} AS (SELECT symbol, confirm_bar, kind, value, (value - start) / greatest(abs(start), 1e-9) / {Q.d(float(n - 1))} AS drift FROM ps_{name}),
{name} AS (SELECT b.symbol, b.bar, coalesce(arg_max(coalesce(p.drift, 0), p.confirm_bar * 2 + p.kind), 0) AS pivot_drift
  FROM {base} b LEFT JOIN pd_{name} p ON p.symbol = b.symbol AND p.confirm_bar < b.bar GROUP BY 1, 2)"""


def cooldown_sql(src: str, cd: int, name: str = "fire") -> str:
    """Recursive CTE walking bar by bar; `<name>` holds (symbol, bar, fired, since)."""
    hit = f"b.candidate AND r.since + 1 > {cd}"
    return f"""{name} AS (
  SELECT symbol, bar, candidate AS fired, CASE WHEN candidate THEN 0 ELSE 1000 END AS since FROM {src} WHERE bar = 0
  UNION ALL
  SELECT b.symbol, b.bar, {hit}, CASE WHEN {hit} THEN 0 ELSE r.since + 1 END
  FROM {name} r JOIN {src} b ON b.symbol = r.symbol AND b.bar = r.bar + 1)"""


# --------------------------------------------------------------------------- single pieces

feature("d3_side_agreement", dict.fromkeys(("agree_high", "agree_low"), D.agreement_spec(HIGH)), agree_sql(HIGH), reads=("close",))
_strict = tuple(range(17, 80, 7))


def _strict_sql(scales, pct: float) -> list[dict[str, str]]:
    parts = []
    for s in scales:
        a = f"sma_close_{s}"
        q = f"CASE WHEN {a} IS NULL THEN NULL WHEN {a} > 0 THEN close / {a} ELSE {Q.d(1.0)} END"
        parts.append([Q.csum(), Q.sma(s), {f"q{s}": q}, *Q.pir(f"q{s}", max(s, 20), f"f{s}")])
    n = Q.d(float(len(scales)))
    up = " + ".join(f"CASE WHEN f{s} > {Q.d(pct)} THEN 1 ELSE 0 END" for s in scales)
    dn = " + ".join(f"CASE WHEN f{s} < {Q.d(1.0 - pct)} THEN 1 ELSE 0 END" for s in scales)
    return [*Q.merge(*parts), {"agree_high": f"({up}) / {n}", "agree_low": f"({dn}) / {n}"}]


feature("d3b_strict_scale_flags", dict.fromkeys(("agree_high", "agree_low"), D.strict_agreement(_strict, 0.74)), _strict_sql(_strict, 0.74), reads=("close",))


def _bool_feature(name: str, specs: list, flags: dict, stages, fixture=SUPP, load=B.bars_supp) -> None:
    """Register boolean columns computed from specs."""
    text, last = Q.chain(stages)
    sel = ", ".join(f"{sql} AS {c}" for c, (_, sql) in flags.items())

    @query(name, f"WITH {fixture},\n{text} SELECT symbol, time, {sel} FROM {last}")
    def _(spark, sf_dir):
        bars, lay = load(spark, sf_dir)
        df = compute(bars, specs, **lay)
        return df.select("symbol", "time", *[f().alias(c) for c, (f, _) in flags.items()])


_bool_feature(
    "d4_agreement_gate", [D.agreement_spec(EASY_HIGH)],
    {"ms_agree": (lambda: F.col("agree_high") >= 0.4, f"agree_high >= {Q.d(0.4)}")}, agree_sql(EASY_HIGH),
)
_div = [*Q.merge(agree_sql(HIGH), detect_pir_sql(HIGH.s_detect)), {"scale_divergence": "pir_detect - agree_high"}]


@query("d5_scale_divergence", f"WITH {SUPP},\n{Q.chain(_div)[0]} SELECT symbol, time, {r6('scale_divergence')} AS scale_divergence, coalesce(abs(scale_divergence) > {HIGH.scale_div}, false) AS veto FROM {Q.chain(_div)[1]}")
def d5(spark, sf_dir):
    bars, lay = B.bars_supp(spark, sf_dir)
    df = compute(bars, [D.agreement_spec(HIGH), D.detect_pir(HIGH.s_detect)], **lay)
    div = F.col("pir_detect") - F.col("agree_high")
    df = df.select("symbol", "time", div.alias("scale_divergence"), F.coalesce(F.abs(div) > HIGH.scale_div, F.lit(False)).alias("veto"))
    return rounded(df, "scale_divergence")


_bool_feature(
    "d6_trend_flag", [X.sma_slope(44, "slope_val"), X.linreg_slope(44, "linreg_val")],
    {
        "trend_up": (lambda: F.coalesce((F.col("slope_val") > 0.2371) & (F.col("linreg_val") > 0.2371), F.lit(False)),
                     "coalesce(slope_val > 0.2371 AND linreg_val > 0.2371, false)"),
        "trend_down": (lambda: F.coalesce((F.col("slope_val") < -0.2371) & (F.col("linreg_val") < -0.2371), F.lit(False)),
                       "coalesce(slope_val < -0.2371 AND linreg_val < -0.2371, false)"),
    },
    Q.merge(Q.slope(44, "slope_val"), Q.linreg(44, "linreg_val")),
)
_dur = [*agree_sql(EASY_HIGH), *duration_sql("agree_high > 0.3")]


@query("d7_duration_at_extreme", f"WITH {SUPP},\n{Q.chain(_dur)[0]} SELECT symbol, time, duration FROM {Q.chain(_dur)[1]}")
def d7(spark, sf_dir):
    bars, lay = B.bars_supp(spark, sf_dir)
    df = compute(bars, [D.agreement_spec(EASY_HIGH)], **lay)
    return D.duration_at_extreme(df, F.col("agree_high") > 0.3, **lay).select("symbol", "time", "duration")


_bool_feature(
    "d8_volume_surge", [D.volume_surge(HIGH.fast_len, HIGH.s_detect)],
    {
        "slow": (lambda: F.coalesce(F.col("vol_surge") < 1.0 / 1.524, F.lit(False)), f"coalesce(vol_surge < {Q.d(1.0 / 1.524)}, false)"),
        "surge": (lambda: F.coalesce(F.col("vol_surge") > 1.524, F.lit(False)), f"coalesce(vol_surge > {Q.d(1.524)}, false)"),
    },
    surge_sql(HIGH),
)
_bool_feature("d9_momentum_divergence_vote", [D.momentum_inputs(44)], {"vote": (lambda: F.col("mom_div") < 0, "mom_div < 0")}, mom_sql(44))
_bool_feature(
    "d10_momentum_velocity_vote", [D.momentum_inputs(44)],
    {
        "reversal_high": (lambda: F.col("mom_vel") <= -0.0295, "mom_vel <= -0.0295"),
        "trend_high": (lambda: F.col("mom_vel") >= 0.0295, "mom_vel >= 0.0295"),
        "reversal_low": (lambda: F.col("mom_vel") >= 0.0127, "mom_vel >= 0.0127"),
        "trend_low": (lambda: F.col("mom_vel") <= -0.0127, "mom_vel <= -0.0127"),
    },
    mom_sql(44),
)
_bool_feature(
    "d11_volatility_vote", [X.vola_position("StdDev", 44, 120, "vola_pos")],
    {"elevated": (lambda: F.coalesce(F.col("vola_pos") > 0.5283, F.lit(False)), "coalesce(vola_pos > 0.5283, false)")}, vola_sql(HIGH),
)
_bool_feature("d12_price_gate", [D.price_gate(20, True, "hi"), D.price_gate(20, False, "lo")],
              {"hi": (lambda: F.col("hi"), "price_ok"), "lo": (lambda: F.col("lo"), "low_ok")},
              Q.merge(gate_sql(replace(HIGH, price_lb=20)),
                      [{"lref": Q.over("min(low)", -20, -1)}, {"low_ok": "coalesce(bar >= 20 AND low <= lref, false)"}]))
_bool_feature("d13_er_gate", [D.er_falling(58, False)], {"er_ok": (lambda: F.col("er_ok"), "er_ok")}, er_sql(HIGH))
_gj_text, _gj_last = Q.chain(Q.merge(Q.GJR_INPUT, Q.har()))


@query(
    "d14_gjr_har_votes",
    f"""WITH RECURSIVE {SUPP},\n{_gj_text},\n{Q.gjr_rec(_gj_last)},
gj AS (SELECT t.*, {Q.GJR_OUT.replace('bar', 't.bar')} AS gjr_asym FROM {_gj_last} t LEFT JOIN rec_gjr r ON r.symbol = t.symbol AND r.bar = t.bar)
SELECT symbol, time, coalesce(gjr_asym <= -0.1227, false) AS gjr_high, coalesce(gjr_asym >= 0.3361, false) AS gjr_low,
  coalesce(har_vol >= 0.399, false) AS har_high, coalesce(har_vol >= 0.408, false) AS har_low FROM gj""",
)
def d14(spark, sf_dir):
    bars, lay = B.bars_supp(spark, sf_dir)
    df = compute(bars, [X.gjr_asym(), X.har_vol()], **lay)
    out = {}
    for p in D.DEFAULT_PRESET:
        v = D.vote_states(replace(p, votes=("gjr_asym", "har_vol")))
        out |= {f"gjr_{p.side}": v["vote_gjr_asym"], f"har_{p.side}": v["vote_har_vol"]}
    return df.select("symbol", "time", *[c.alias(n) for n, c in out.items()])


@query("d15_pivot_drift", f"WITH {SUPP},\n{pivots_sql('bars', 4)} SELECT symbol, bar, {r6('pivot_drift')} AS pivot_drift FROM dr")
def d15(spark, sf_dir):
    bars, lay = B.bars_supp(spark, sf_dir)
    df = D.with_drift(compute(bars, [X.pivots(D.PIVOT_LB)], **lay), 4, lay["max_bars"])
    return rounded(df.select("symbol", "bar", "pivot_drift"), "pivot_drift")


@query("f24_pivot_drift", f"WITH {SUPP},\n{pivots_sql('bars', 3, 5)} SELECT symbol, confirm_bar, kind, {r6('drift')} AS drift FROM pd_dr")
def f24(spark, sf_dir):
    bars, lay = B.bars_supp(spark, sf_dir)
    piv = D.pivot_table(compute(bars, [X.pivots(5)], **lay), 5)
    out = D.pivot_drift(piv, 3, max_bars=lay["max_bars"]).select("symbol", "confirm_bar", "kind", "drift")
    return rounded(out, "drift")




def _rise_edges(fr):
    """A vote that is set on rising closes, and its edges over 5 bars."""
    edges = D.edge_spec(["_v"], 5)(fr)
    stages = [{"_pc": fr.lag("close", 1)}, {"_v": F.coalesce(F.col("close") > F.col("_pc"), F.lit(False))}, *edges.stages]
    return Calc(stages, {"v": F.col("_v"), "v_eff": edges.out["_v_eff"]}, lookback=7)


_bool_feature(
    "d16_edge_votes", [_rise_edges],
    {"v": (lambda: F.col("v"), "v"), "v_eff": (lambda: F.col("v_eff"), "v_eff")},
    [{"pc": Q.lag("close")}, {"v": "coalesce(close > pc, false)"}, {"vo": Q.lag("v", 5)}, {"v_eff": "v AND NOT coalesce(vo, false)"}],
)


# --------------------------------------------------------------------------- the chain


def side_sql(p: D.SidePreset, fixture: str) -> str:
    """CTEs ending in `cand` with every value of the side up to the candidate flag."""
    agree = "agree_high" if p.high else "agree_low"
    s = p.s_detect
    parts = [
        agree_sql(p), detect_pir_sql(s), Q.slope(s, "slope_val"), Q.linreg(s, "linreg_val"), surge_sql(p), mom_sql(s),
        gate_sql(p), er_sql(p), Q.har(), Q.GJR_INPUT, Q.TRUE_RANGE,
    ]
    if p.vola_method != "ATR":
        parts.append(vola_sql(p))
    text, last = Q.chain(Q.merge(*parts))
    text = text.replace(f"{last} AS (", f"{last} AS MATERIALIZED (")
    recs = [Q.gjr_rec(last)]
    extra = ""
    joins = f"LEFT JOIN rec_gjr ON rec_gjr.symbol = t.symbol AND rec_gjr.bar = t.bar JOIN dr ON dr.symbol = t.symbol AND dr.bar = t.bar"
    if p.vola_method == "ATR":
        recs.append(Q.rma_rec("tr", s, last, "atr"))
        joins += " LEFT JOIN rec_atr ON rec_atr.symbol = t.symbol AND rec_atr.bar = t.bar"
        extra = ", rec_atr.atr AS vr"
    cmp_, sign = (">", "") if p.high else ("<", "-")
    vel, t = "mom_vel", abs(p.velocity_thr)
    upward = (p.velocity_mode == "Trend") == p.high
    votes = {
        "trend": f"slope_val {cmp_} {sign}{p.slope} AND linreg_val {cmp_} {sign}{p.slope}",
        "pivot_drift": f"pivot_drift < -{p.drift_thr}" if p.high else f"pivot_drift > {p.drift_thr}",
        "volume": f"vol_surge < {Q.d(1.0 / p.vol_surge)}" if p.high else f"vol_surge > {Q.d(p.vol_surge)}",
        "momentum": "mom_div < 0",
        "momentum_velocity": f"{vel} >= {t}" if upward else f"{vel} <= -{t}",
        "volatility": f"vola_pos > {Q.d(p.vola_high)}",
        "gjr_asym": f"gjr_asym <= -{p.gjr_thr}" if p.high else f"gjr_asym >= {p.gjr_thr}",
        "har_vol": f"har_vol >= {p.har_thr}",
    }
    used = [v for v in D.VOTES if v in p.votes]
    state = {f"vote_{v}": f"coalesce({votes[v]}, false)" for v in used}
    old = {f"old_{v}": Q.lag(f"vote_{v}", p.edge_window) for v in used}
    eff = {
        f"vote_{v}_eff": f"vote_{v} AND NOT coalesce(old_{v}, false)" if p.use_edge else f"vote_{v}" for v in used
    }
    counted = max(len([v for v in used if v != "pivot_drift"]), 1)
    bias = p.drift_bias if p.high else -p.drift_bias
    shift = f"CASE WHEN pivot_drift > {p.drift_thr} THEN {bias} ELSE 0 END" if "pivot_drift" in used else "0"
    pir = "pir_detect" if p.high else "(1 - pir_detect)"
    gates = ["ms_agree", "dur_flag", f"NOT coalesce(abs(scale_divergence) > {p.scale_div}, false)", "price_ok"]
    if p.er_gate:
        gates.append("er_ok")
    if p.high and "pivot_drift" in used:
        gates.append(f"NOT (pivot_drift > {Q.d(p.drift_thr * p.drift_gate)})")
    tail = [
        *(Q.pir("vr", p.vola_range, "vola_pos") if p.vola_method == "ATR" else [{"_z": "0"}]),
        *duration_sql(f"{agree} > {Q.d(p.dur_pct)}"),
        {"gjr_asym": Q.GJR_OUT, "scale_divergence": f"{pir} - {agree}", "ms_agree": f"{agree} >= {Q.d(p.min_agreement)}"},
        state | {"dur_flag": f"duration >= {p.min_duration}"},
        old | {"required": f"greatest(1, least({counted}, {p.confirm_count} + {shift}))"},
        eff | {"gate": f"coalesce({' AND '.join(gates)}, false)"},
        {"confirms": " + ".join(f"CAST(vote_{v}_eff AS INTEGER)" for v in used)},
        {"candidate": "gate AND confirms >= required"},
    ]
    body, end = Q.chain(tail, "joined", "dt")
    return f"""{fixture},\n{text},\n{pivots_sql('bars', max(p.drift_lb, 2))},\n{', '.join(recs)},
joined AS (SELECT t.*, g, s, pivot_drift{extra} FROM {last} t {joins}),
{body},
cand AS MATERIALIZED (SELECT * FROM {end})"""


def _side_query(name: str, p: D.SidePreset, cols: list[str], doubles: list[str], load, fixture: str) -> None:
    sel = ", ".join(f"{r6(c)} AS {c}" if c in doubles else c for c in cols)

    @query(name, f"WITH RECURSIVE {side_sql(p, fixture)} SELECT symbol, time, {sel} FROM cand")
    def _(spark, sf_dir):
        bars, lay = load(spark, sf_dir)
        return rounded(D.side_frame(bars, p, **lay).select("symbol", "time", *cols), *doubles)


_side_query("d17_votes_high", EASY_HIGH, ["confirms", "required", *[f"vote_{v}_eff" for v in D.VOTES]], [], B.bars_supp, SUPP)
_side_query("d17_votes_low", EASY_LOW, ["confirms", "required", *[f"vote_{v}_eff" for v in D.VOTES]], [], B.bars_supp, SUPP)
_side_query("d18_gates_high", EASY_HIGH, ["ms_agree", "dur_flag", "price_ok", "er_ok", "gate", "candidate"], [], B.bars_supp, SUPP)
_side_query("d18_gates_low", EASY_LOW, ["ms_agree", "dur_flag", "price_ok", "gate", "candidate"], [], B.bars_supp, SUPP)


def _cand_base(spark, sf_dir):
    """Bars with a plain candidate flag: falling closes."""
    bars, lay = B.bars_supp(spark, sf_dir)
    return compute(bars, [X.price_return(3)], **lay).withColumn("candidate", F.coalesce(F.col("price_return_L3") < -0.2, F.lit(False)))


_cd = Q.chain([*Q.momentum(3)[:2], {"candidate": "coalesce(price_return_L3 < -0.2, false)"}])


@query("d19_cooldown", f"WITH RECURSIVE {SUPP},\n{_cd[0]},\n{cooldown_sql(_cd[1], 14)} SELECT symbol, bar FROM fire WHERE fired")
def d19(spark, sf_dir):
    return D.fire_with_cooldown(_cand_base(spark, sf_dir).filter("candidate").select("symbol", "bar"), 14)


@query("d20_rising_edges", f"WITH RECURSIVE {SUPP},\n{_cd[0]},\n{cooldown_sql(_cd[1], 0)}, e AS (SELECT *, lag(fired) OVER (PARTITION BY symbol ORDER BY bar) AS pf FROM fire) SELECT symbol, bar FROM e WHERE fired AND NOT coalesce(pf, false)")
def d20(spark, sf_dir):
    return D.rising(D.fire_with_cooldown(_cand_base(spark, sf_dir).filter("candidate").select("symbol", "bar"), 0))


DEBUG = [
    "agree_high", "agree_low", "pir_detect", "scale_divergence", "slope_val", "linreg_val", "vol_surge", "mom_div", "mom_vel",
    "er_val", "vola_pos", "gjr_asym", "har_vol", "pivot_drift",
]


def _debug_query(name: str, p: D.SidePreset) -> None:
    flags = ["ms_agree", "dur_flag", "price_ok", "gate", "candidate", "fired", "signal"]
    nums = ["confirms", "required", "duration", "bars_since_fire"]
    sel = ", ".join(f"{r6('c.' + c)} AS {c}" for c in DEBUG)
    cols = ", ".join(f"c.{c}" for c in ["ms_agree", "dur_flag", "price_ok", "gate", "candidate", "confirms", "required", "duration"])
    sql = f"""WITH RECURSIVE {side_sql(p, SUPP)},\n{cooldown_sql('cand', p.cooldown)},
edge AS (SELECT *, lag(fired) OVER (PARTITION BY symbol ORDER BY bar) AS pf FROM fire)
SELECT c.symbol, c.time, {sel}, {cols}, e.fired, e.fired AND NOT coalesce(e.pf, false) AS signal,
  CASE WHEN e.since >= 1000 THEN 1000 + c.bar ELSE e.since END AS bars_since_fire
FROM cand c JOIN edge e ON e.symbol = c.symbol AND e.bar = c.bar"""

    @query(name, sql)
    def _(spark, sf_dir):
        bars, lay = B.bars_supp(spark, sf_dir)
        return rounded(D.detect_side(bars, p, **lay).select("symbol", "time", *DEBUG, *flags, *nums), *DEBUG)


_debug_query("d21_debug_table_high", EASY_HIGH)
_debug_query("d21_debug_table_low", EASY_LOW)


def _default_sql(p: D.SidePreset) -> str:
    return f"WITH RECURSIVE {side_sql(p, SUPP)},\n{cooldown_sql('cand', p.cooldown)} SELECT symbol, bar FROM fire WHERE fired"


@query("d1_default_preset_high", _default_sql(HIGH))
def d1h(spark, sf_dir):
    bars, lay = B.bars_supp(spark, sf_dir)
    return D.fires(bars, HIGH, **lay).select("symbol", "bar")


@query("d1_default_preset_low", _default_sql(LOW))
def d1l(spark, sf_dir):
    bars, lay = B.bars_supp(spark, sf_dir)
    return D.fires(bars, LOW, **lay).select("symbol", "bar")


#: Presets of both sides by rule: the default and two rougher ones, with other confirmations and cooldowns.
PRESETS = [
    (f"{name}|{n}|{wait}", replace(p, confirm_count=n, cooldown=wait))
    for name, pair in (("default", (HIGH, LOW)), ("easy", (EASY_HIGH, EASY_LOW)), ("plain", (replace(EASY_HIGH, use_edge=False, er_gate=False), replace(EASY_LOW, use_edge=False, er_gate=True, votes=D.VOTES[:4]))))
    for n, wait in ((1, 3), (2, 9))
    for p in pair
]
_FIRES = " UNION ALL ".join(f"SELECT '{n}' AS preset, '{p.side}' AS side, symbol, bar FROM ({_default_sql(p)})" for n, p in PRESETS)


@query("d22_preset_fires", _FIRES)
def d22_fires(spark, sf_dir):
    """Fires of a parameter table of presets, both sides, over one table of shared inputs."""
    bars, lay = B.bars_supp(spark, sf_dir)
    presets = PS.read_presets(PS.preset_table(spark, PRESETS))
    return PS.sweep_presets(bars, presets, **lay).select("preset", "side", "symbol", "bar")


@query("d22_preset_sweep")
def d22(spark, sf_dir):
    """Event scores of the presets, both sides, in one job, deflated by the number of presets."""
    bars, lay = B.bars_supp(spark, sf_dir)
    bars = materialise(bars)
    hits = PS.sweep_presets(bars, PRESETS, **lay).select("preset", "side", "symbol", "bar", F.lit(True).alias("is_pred"), F.lit(False).alias("is_true"))
    names = {s: F.array(*[F.lit(n) for n, p in PRESETS if p.side == s]) for s in ("high", "low")}
    labels = materialise(L.label_turns(bars, LOOSE, **lay).select("symbol", "bar", "top_tier", "bottom_tier"))
    for side, tier in (("high", "top_tier"), ("low", "bottom_tier")):
        truth = labels.filter(f"{tier} <> 'none'")
        hits = hits.unionByName(truth.select(F.explode(names[side]).alias("preset"), F.lit(side).alias("side"), "symbol", "bar", F.lit(False).alias("is_pred"), F.lit(True).alias("is_true")))
    scores = EV.event_prf(hits, 3, ["preset", "side"])
    spread = scores.agg(F.coalesce(F.stddev_samp("f1"), F.lit(0.0)).alias("s")).scalar()
    return rounded(
        scores.withColumn("deflated_f1", C.deflated_metric(F.col("f1"), F.lit(len(PRESETS)), spread)), "precision", "recall", "f1", "deflated_f1"
    )
