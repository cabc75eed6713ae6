"""Bars, window primitives and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rolling as _R
from tidemark.layout import Calc, compute
from tidemark.operators import features as X
from tidemark.operators.bank import FeatureConfig, build_features, feature_names
from tidemark.plans import base as B
from tidemark.plans import sqltext as Q
from tidemark.plans.base import EVENT, FLAG, HOUR, SUPP, r6, query, rounded
from tidemark.sources import bars as S



def _calc(name, col, n):
    """A one-window calculation."""
    return Calc([{f"_{name}": col}], {name: F.col(f"_{name}")}, lookback=n)


FIXTURES = {"supp": (B.bars_supp, SUPP), "flag": (B.bars_flag, FLAG), "event": (B.bars_event, EVENT)}


def feature(name: str, specs: dict, stages: list[dict[str, str]], fixture: str = "supp", digits: int = 6, reads=S.OHLCV) -> None:
    """Register `symbol, time` plus the columns of `specs` over one fixture; `reads` are the columns of a bar they use."""
    load, cte = FIXTURES[fixture]
    cols = list(specs)
    text, last = Q.chain(stages)
    sql = f"WITH {cte},\n{text}\nSELECT symbol, time, " + ", ".join(f"{r6(c, digits)} AS {c}" for c in cols) + f" FROM {last}"

    def run(spark, sf_dir):
        bars, lay = load(spark, sf_dir)
        out = compute(bars.select("symbol", "time", *reads), list(dict.fromkeys(specs.values())), **lay)
        return rounded(out.select("symbol", "time", *cols), *cols, digits=digits)

    query(name, sql)(run)


# --------------------------------------------------------------------------- bars


def _bars_query(name: str, fixture: str) -> None:
    load, cte = FIXTURES[fixture]
    cols = "symbol, time, open, high, low, close, volume"

    @query(name, f"WITH {cte} SELECT {cols} FROM bars")
    def _(spark, sf_dir):
        return load(spark, sf_dir)[0].select(*cols.split(", "))


_bars_query("s9_ticks_to_bars", "supp")
_bars_query("s9_ticks_to_bars_dense", "flag")
_bars_query("s9_ticks_to_bars_hourly", "event")

WEEK = 7 * 86_400


@query(
    "s8_resample_bars",
    f"""WITH {FLAG} SELECT symbol, CAST(floor(time / {WEEK}) * {WEEK} AS BIGINT) AS time,
    arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close,
    sum(volume) AS volume FROM bars GROUP BY 1, 2""",
)
def s8(spark, sf_dir):
    return S.resample_bars(B.bars_flag(spark, sf_dir)[0], WEEK)


@query(
    "s8_resample_bars_intraday",
    f"""WITH {EVENT} SELECT symbol, CAST(floor(time / {4 * HOUR}) * {4 * HOUR} AS BIGINT) AS time,
    arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close,
    sum(volume) AS volume FROM bars GROUP BY 1, 2""",
)
def s8b(spark, sf_dir):
    return S.resample_bars(B.bars_event(spark, sf_dir)[0], 4 * HOUR)


@query(
    "s14_bar_date",
    f"""WITH {EVENT} SELECT symbol, time, strftime(to_timestamp(time) AT TIME ZONE 'UTC', '%Y-%m-%d') AS bar_date FROM bars""",
)
def s14(spark, sf_dir):
    df = S.with_bar_date(B.bars_event(spark, sf_dir)[0])
    return df.select("symbol", "time", F.date_format("bar_date", "yyyy-MM-dd").alias("bar_date"))


# --------------------------------------------------------------------------- window primitives



@query("f1_csum", f"WITH {SUPP} SELECT symbol, time, {r6(Q.over('sum(close)'), 2)} AS csum FROM bars")
def f1(spark, sf_dir):
    bars, lay = B.bars_supp(spark, sf_dir)
    return rounded(X.running_sum(bars, **lay).select("symbol", "time", "csum"), "csum", digits=2)


feature(
    "f2_sma",
    {f"sma_{s}": X.sma(s) for s in (5, 20, 100)},
    Q.merge(*[[Q.csum(), Q.sma(s)] for s in (5, 20, 100)]) + [{f"sma_{s}": f"sma_close_{s}" for s in (5, 20, 100)}],
    digits=4,
)
feature("f3_pir_of", {"pir_close_50": X.pir_of("close", 50)}, Q.pir("close", 50, "pir_close_50"))
_pirs = {s: Q.scale_pir(s, max(s, 20)) for s in (5, 10, 20, 50, 100)}
feature(
    "f4_pir_for_scale",
    {f"pir_s{s}": X.pir_for_scale(s, max(s, 20)) for s in _pirs},
    Q.merge(*[st for st, _ in _pirs.values()]) + [{f"pir_s{s}": e for s, (_, e) in _pirs.items()}],
    reads=("close",),
)
_agree = X.agreement(3, 120, 13, 0.8, counts=True)
feature(
    "f5_agreement",
    {c: _agree for c in ("agree_high", "agree_low", "agree_n_high", "agree_n_low")},
    Q.agreement(3, 120, 13, 0.8, "agree_high", "agree_low")
    + [{"agree_n_high": "agree_high * 10", "agree_n_low": "agree_low * 10"}],
    reads=("close",),
)
_ers = {f"er_{t}_p{p}": (p, t == "dir") for p in (10, 20, 40) for t in ("dir", "abs")}
feature(
    "f6_efficiency_ratio",
    {n: X.efficiency_ratio(*a) for n, a in _ers.items()},
    Q.merge(*[Q.er(*a, n) for n, a in _ers.items()]),
)
feature("f7_true_range", {"true_range": X.true_range()}, Q.TRUE_RANGE + [{"true_range": "tr"}], digits=4)


def _recursive(name: str, specs: dict, stages, rec, join_cols: dict[str, str], fixture: str, digits: int = 6) -> None:
    """Register a query whose twin walks the series bar by bar."""
    load, cte = FIXTURES[fixture]
    text, last = Q.chain(stages)
    recs = ",\n".join(r.replace("@base", last) for r in rec)
    names = [r.split("rec_")[1].split(" ")[0] for r in rec]
    joins = " ".join(f"LEFT JOIN rec_{n} ON rec_{n}.symbol = t.symbol AND rec_{n}.bar = t.bar" for n in names)
    sel = ", ".join(f"{r6(e, digits)} AS {c}" for c, e in join_cols.items())
    sql = f"WITH RECURSIVE {cte},\n{text},\n{recs}\nSELECT t.symbol, t.time, {sel} FROM {last} t {joins}"

    def run(spark, sf_dir):
        bars, lay = load(spark, sf_dir)
        out = compute(bars, list(dict.fromkeys(specs.values())), **lay)
        return rounded(out.select("symbol", "time", *specs), *specs, digits=digits)

    query(name, sql)(run)


_recursive(
    "f8_rma", {"rma_14": X.rma("volume", 14, "rma_14")}, [{"vv": "volume"}],
    [Q.rma_rec("vv", 14, "@base", "rma14")], {"rma_14": "rma14"}, "supp",
)
_recursive(
    "f9_atr", {"atr_14": X.atr(14), "atr_30": X.atr(30)}, Q.TRUE_RANGE,
    [Q.rma_rec("tr", 14, "@base", "a14"), Q.rma_rec("tr", 30, "@base", "a30")],
    {"atr_14": "a14", "atr_30": "a30"}, "supp", digits=4,
)
feature(
    "f10_stdev",
    {"stddev_14": X.stdev(14), "stddev_30": X.stdev(30)},
    [{f"stddev_{n}": f"CASE WHEN bar >= {n - 1} THEN {Q.over('stddev_pop(close)', -(n - 1))} END" for n in (14, 30)}],
    digits=4,
)
_IR = "CASE WHEN close > 0 THEN (high - low) / close ELSE CAST(0 AS DOUBLE) END"
feature(
    "f11_intraday_range",
    {"intraday_14": X.intraday_range(14)},
    [{"ir": _IR}, {"intraday_14": f"CASE WHEN bar >= 13 THEN {Q.over('avg(ir)', -13)} END"}],
    fixture="flag",
)
_std30 = [{"sd30": f"CASE WHEN bar >= 29 THEN {Q.over('stddev_pop(close)', -29)} END"}]
_int14 = [{"ir": _IR}, {"i14": f"CASE WHEN bar >= 13 THEN {Q.avg_in_order('ir', 14)} END"}]
feature(
    "f12_vola_position",
    {
        "vola_pos_StdDev_l30": X.vola_position("stddev", 30, 100, "vola_pos_StdDev_l30"),
        "vola_pos_Intraday_l14": X.vola_position("Intraday", 14, 100),
    },
    Q.merge(_std30 + Q.pir("sd30", 100, "vola_pos_StdDev_l30"), _int14 + Q.pir("i14", 100, "vola_pos_Intraday_l14")),
    fixture="flag",
)
feature(
    "f14_sma_slope",
    {f"sma_slope_s{s}": X.sma_slope(s) for s in (20, 50, 100)},
    Q.merge(*[Q.slope(s, f"sma_slope_s{s}") for s in (20, 50, 100)]),
)
feature(
    "f15_linreg_slope",
    {f"linreg_slope_s{s}": X.linreg_slope(s) for s in (20, 50, 100)},
    Q.merge(*[Q.linreg(s, f"linreg_slope_s{s}") for s in (20, 50, 100)]),
)
feature("f16_price_return", {f"price_return_L{n}": X.price_return(n) for n in (10, 20, 40)},
        Q.merge(*[Q.momentum(n) for n in (10, 20, 40)]), fixture="event")
feature("f17_mom_divergence", {f"mom_divergence_L{n}": X.mom_divergence(n) for n in (10, 20, 40)},
        Q.merge(*[Q.momentum(n) for n in (10, 20, 40)]))
feature("f18_mom_velocity", {f"mom_velocity_L{n}": X.mom_velocity(n) for n in (10, 20, 40)},
        Q.merge(*[Q.momentum(n) for n in (10, 20, 40)]))
_recursive("f19_gjr_asym", {"gjr_asym": X.gjr_asym()}, Q.GJR_INPUT, [Q.gjr_rec("@base")],
           {"gjr_asym": Q.GJR_OUT.replace("bar", "t.bar")}, "supp")


@query(
    "f20_gk_variance",
    f"WITH {FLAG},\n{Q.chain(Q.har())[0]} SELECT symbol, time, {r6('gk', 9)} AS gk_variance FROM st4",
)
def f20(spark, sf_dir):
    bars, _ = B.bars_flag(spark, sf_dir)
    return rounded(bars.select("symbol", "time", X.gk_variance().alias("gk_variance")), "gk_variance", digits=9)


feature("f21_har_vol", {"har_vol": X.har_vol()}, Q.har(), fixture="flag")


def _pivot_sql(lb: int) -> list[dict[str, str]]:
    full = f"bar >= {lb} AND bar + {lb} < n_bars"
    return [
        {
            "hb": Q.over("max(high)", -lb, -1), "ha": Q.over("max(high)", 1, lb),
            "lb_": Q.over("min(low)", -lb, -1), "la": Q.over("min(low)", 1, lb),
        },
        {
            "pivot_high": f"coalesce({full} AND high > hb AND high > ha, false)",
            "pivot_low": f"coalesce({full} AND low < lb_ AND low < la, false)",
        },
    ]


def _pivot_query(name: str, side: str, lb: int) -> None:
    text, last = Q.chain(_pivot_sql(lb))

    @query(name, f"WITH {SUPP},\n{text} SELECT symbol, time, pivot_{side} FROM {last}")
    def _(spark, sf_dir):
        bars, lay = B.bars_supp(spark, sf_dir)
        return compute(bars, [X.pivots(lb)], **lay).select("symbol", "time", F.coalesce(f"pivot_{side}", F.lit(False)).alias(f"pivot_{side}"))


_pivot_query("f22_pivot_high", "high", 5)
_pivot_query("f23_pivot_low", "low", 5)

# --------------------------------------------------------------------------- overextension

feature(
    "f25_rolling_mean",
    {"mean_20": lambda fr: _calc("mean_20", _R.rolling_mean(fr, F.col("close"), 20), 20)},
    [{"mean_20": Q.full("avg(close)", 20, "close")}],
    digits=4,
)
feature(
    "f26_rolling_std",
    {"std_20": lambda fr: _calc("std_20", _R.rolling_std(fr, F.col("close"), 20), 20)},
    [{"std_20": Q.full("stddev_pop(close)", 20, "close")}],
    digits=4,
)
feature(
    "f27_rolling_max",
    {"max_20": lambda fr: _calc("max_20", _R.rolling_max(fr, F.col("close"), 20), 20)},
    [{"max_20": Q.full("max(close)", 20, "close")}],
)
feature("f28_log_return", {"log_return": X.log_returns()},
        [{"pc": Q.lag("close")}, {"log_return": "CASE WHEN close > 0 AND pc > 0 THEN ln(close / pc) END"}], fixture="event")
feature("f29_realized_vol", {"realized_vol": X.realized_vol(20)}, Q.realized_vol(20) + [{"realized_vol": "rv20"}], fixture="event")
feature(
    "f30_dist_above_sma_z",
    {f"dist_above_sma_z_l{n}": X.dist_above_sma_z(n, 100) for n in (50, 100, 200)},
    Q.merge(*[Q.dist_z(n, 100, f"dist_above_sma_z_l{n}") for n in (50, 100, 200)]),
)
feature(
    "f31_drawdown_from_high",
    {f"drawdown_from_high_l{n}": X.drawdown_from_high(n) for n in (20, 50, 100)},
    Q.merge(*[Q.drawdown(n, f"drawdown_from_high_l{n}") for n in (20, 50, 100)]),
)
feature("f32_realized_vol_pct", {"realized_vol_pct": X.realized_vol_pct(20, 100)},
        Q.realized_vol(20) + Q.pir("rv20", 100, "realized_vol_pct"))
feature("f33_up_streak_norm", {"up_streak_norm": X.up_streak_norm(5)}, Q.up_streak(5, "up_streak_norm"))
feature(
    "f34_vol_of_vol",
    {"vol_of_vol": X.vol_of_vol(20)},
    Q.realized_vol(20) + [{"vov": Q.full("stddev_pop(rv20)", 20, "rv20")}] + Q.pir("vov", 20, "vol_of_vol"),
)

# --------------------------------------------------------------------------- the bank

BANK = FeatureConfig(include_overextension=True)
BANK_COLS = feature_names(BANK)


def bank_sql() -> tuple[str, str]:
    """CTE text and last relation with all 45 columns (needs WITH RECURSIVE)."""
    er_cols = {f"er_{t}_p{p}": (p, t == "dir") for p in (10, 20, 40) for t in ("dir", "abs")}
    parts = [
        Q.agreement(3, 120, 13, 0.8, "agree_high", "agree_low"),
        Q.merge(*[st for st, _ in _pirs.values()]) + [{f"pir_s{s}": e for s, (_, e) in _pirs.items()}],
        *[Q.er(*a, n) for n, a in er_cols.items()],
        *[
            [{f"sd{n}": f"CASE WHEN bar >= {n - 1} THEN {Q.over('stddev_pop(close)', -(n - 1))} END"}]
            + Q.pir(f"sd{n}", 100, f"vola_pos_StdDev_l{n}")
            for n in (14, 30)
        ],
        *[
            [{"ir": _IR}, {f"i{n}": f"CASE WHEN bar >= {n - 1} THEN {Q.avg_in_order('ir', n)} END"}]
            + Q.pir(f"i{n}", 100, f"vola_pos_Intraday_l{n}")
            for n in (14, 30)
        ],
        *[Q.slope(s, f"sma_slope_s{s}") for s in (20, 50, 100)],
        *[Q.linreg(s, f"linreg_slope_s{s}") for s in (20, 50, 100)],
        *[Q.momentum(n) for n in (10, 20, 40)],
        Q.TRUE_RANGE,
        Q.GJR_INPUT,
        Q.har(),
        *[Q.dist_z(n, 100, f"dist_above_sma_z_l{n}") for n in (50, 100, 200)],
        *[Q.drawdown(n, f"drawdown_from_high_l{n}") for n in (20, 50, 100)],
        Q.realized_vol(20) + Q.pir("rv20", 100, "realized_vol_pct"),
        Q.up_streak(5, "up_streak_norm"),
        Q.realized_vol(20) + [{"vov": Q.full("stddev_pop(rv20)", 20, "rv20")}] + Q.pir("vov", 20, "vol_of_vol"),
    ]
    text, last = Q.chain(Q.merge(*parts))
    text = text.replace(f"{last} AS (", f"{last} AS MATERIALIZED (")
    recs = [Q.rma_rec("tr", 14, last, "a14"), Q.rma_rec("tr", 30, last, "a30"), Q.gjr_rec(last)]
    joins = " ".join(
        f"LEFT JOIN rec_{n} ON rec_{n}.symbol = t.symbol AND rec_{n}.bar = t.bar" for n in ("a14", "a30", "gjr")
    )
    joined = f"walked AS (SELECT t.*, a14, a30, g, s FROM {last} t {joins})"
    tail, end = Q.chain(
        [
            {"gjr_asym": Q.GJR_OUT},
            *Q.merge(Q.pir("a14", 100, "vola_pos_ATR_l14"), Q.pir("a30", 100, "vola_pos_ATR_l30")),
        ],
        base="walked",
        prefix="bk",
    )
    return ",\n".join([text, *recs, joined, tail]), end


_BANK_TEXT, _BANK_LAST = bank_sql()


def _bank_query(name: str, fixture: str, cfg: FeatureConfig, cols: list[str]) -> None:
    load, cte = FIXTURES[fixture]
    sql = f"WITH RECURSIVE {cte},\n{_BANK_TEXT}\nSELECT symbol, time, " + ", ".join(f"{r6(c)} AS {c}" for c in cols)

    @query(name, sql + f" FROM {_BANK_LAST}")
    def _(spark, sf_dir):
        bars, lay = load(spark, sf_dir)
        return build_features(bars, cfg, digits=6, **lay).select("symbol", "time", *cols)


_bank_query("f35_feature_bank", "supp", BANK, BANK_COLS)
_bank_query("f35_feature_bank_base", "flag", FeatureConfig(), feature_names())
_bank_query("f12_vola_position_atr", "supp", FeatureConfig(blocks=("vola",)), ["vola_pos_ATR_l14", "vola_pos_ATR_l30"])
