"""Forward-looking turn labels over a nest of scales, bounded by a horizon."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.functions.looks import Each, Look, both, each, known
from tidemark.functions.scalars import tier
from tidemark.layout import DAY, Calc, Frames, Spec, asof_backward, compute

EPS = 1e-12
WEIGHT_CURVES: dict[str, Callable[[float], float]] = {}


def register_weight_curve(name: str, fn: Callable[[float], float]) -> None:
    if name in WEIGHT_CURVES:
        raise ValueError(f"weight curve {name!r} is already registered")
    WEIGHT_CURVES[name] = fn


register_weight_curve("linear", lambda u: u)
register_weight_curve("quadratic", lambda u: u * u)


@dataclass(frozen=True)
class OracleConfig:
    """Label settings; the defaults are the structural ones."""

    scale_nest: tuple[int, ...] = (20, 50, 100, 200)
    weight_curve: str = "linear"
    drawdown_pct: float = 0.10
    horizon: int = 60
    tau_strong: float = 0.60
    tau_regular: float = 0.30

    def __post_init__(self) -> None:
        nest = self.scale_nest
        if not nest or min(nest) < 1 or list(nest) != sorted(set(nest)):
            raise ValueError(f"scale_nest must be strictly increasing and >= 1, got {nest}")
        if self.horizon < 1:
            raise ValueError("horizon must be >= 1")
        if not 0 < self.drawdown_pct < 1:
            raise ValueError("drawdown_pct must be in (0, 1)")
        if not 0 < self.tau_regular <= self.tau_strong <= 1:
            raise ValueError("need 0 < tau_regular <= tau_strong <= 1")
        if self.weight_curve not in WEIGHT_CURVES:
            raise KeyError(f"unknown weight curve {self.weight_curve!r}; known: {', '.join(sorted(WEIGHT_CURVES))}")

    def weights(self) -> list[float]:
        """Weight per scale in nest order, summing to 1; an all-zero curve means equal weights."""
        last = len(self.scale_nest) - 1
        raw = [WEIGHT_CURVES[self.weight_curve](i / last if last else 0.0) for i in range(last + 1)]
        total = sum(raw)
        return [r / total for r in raw] if total > EPS else [1.0 / len(raw)] * len(raw)


STRUCTURAL = OracleConfig()
LOOSE = OracleConfig(scale_nest=(5, 10, 20, 40), drawdown_pct=0.05, horizon=40, tau_strong=0.5, tau_regular=0.25)


def side_parts(fr: Frames, ext: str, rev: str, top: bool, cfg: OracleConfig) -> tuple[list[dict[str, Look | Each]], dict]:
    """Stages, and the columns of a side: decidable, candidate, and extreme and reversal per scale."""
    h, nest = cfg.horizon, cfg.scale_nest
    fwd = [min(s, h) for s in nest]
    ext_side, rev_side = ("_hi", "_lo") if top else ("_lo", "_hi")
    ladders = [R.extent_stages(fr, ext, w) for w in sorted({*nest, *fwd})]
    ladders += [R.extent_stages(fr, rev, w) for w in sorted(set(fwd))]
    stages = [
        {k: v for lad in ladders if d < len(lad) for k, v in lad[d].items()} for d in range(max(map(len, ladders)))
    ]
    tag = "t" if top else "b"
    edge: dict[str, Look] = {}
    for s in nest:
        edge[f"_{tag}_back_{ext}_{s}"] = Look("lag", f"{ext_side}_{ext}_{s}", 1)
    for f in set(fwd):
        edge[f"_{tag}_fwd_{ext}_{f}"] = Look("lead", f"{ext_side}_{ext}_{f}", f)
        edge[f"_{tag}_rev_{rev}_{f}"] = Look("lead", f"{rev_side}_{rev}_{f}", f)
    stages.append(edge)

    def beyond(x: np.ndarray, ref: np.ndarray) -> np.ndarray:
        return np.isnan(x) | np.isnan(ref) | (x > ref if top else x < ref)

    def reversed_(x: np.ndarray, far: np.ndarray) -> np.ndarray:
        return ((x - far) if top else (far - x)) / np.fmax(x, EPS) >= cfg.drawdown_pct

    parts = {
        "decidable": f"_{tag}_decidable_{h}",
        "extreme": [f"_{tag}_extreme_{ext}_{s}_{f}" for s, f in zip(nest, fwd)],
        "reversal": [f"_{tag}_reversal_{ext}_{rev}_{f}_{cfg.drawdown_pct!r}" for f in fwd],
    }
    parts["candidate"] = parts["extreme"][-1]
    flags = {parts["decidable"]: each(lambda bar, n: known(bar + h < n, n), "bar", "n_bars", kind="boolean")}
    for s, f, e, r in zip(nest, fwd, parts["extreme"], parts["reversal"]):
        flags[e] = each(lambda x, a, b: beyond(x, a) & beyond(x, b), ext, f"_{tag}_back_{ext}_{s}", f"_{tag}_fwd_{ext}_{f}", kind="boolean")
        flags[r] = each(reversed_, ext, f"_{tag}_rev_{rev}_{f}", kind="boolean")
    return [*stages, flags], parts


def side_score(parts: dict, cfg: OracleConfig) -> Each:
    weights = cfg.weights()

    def score(decidable: np.ndarray, candidate: np.ndarray, *pairs: np.ndarray) -> np.ndarray:
        total = np.zeros(len(candidate))
        for w, e, r in zip(weights, pairs[::2], pairs[1::2]):
            total = total + np.where(e & r, w, 0.0)
        return np.fmax(0.0, np.fmin(1.0, np.where((decidable == 1) & candidate, total, 0.0)))

    return each(score, parts["decidable"], parts["candidate"], *(c for pair in zip(parts["extreme"], parts["reversal"]) for c in pair))


def side_spec(ext: str, rev: str, top: bool, cfg: OracleConfig, name: str) -> Spec:
    """Score column of one side; `ext` holds the extreme, `rev` the reversal."""

    def spec(fr: Frames) -> Calc:
        stages, parts = side_parts(fr, ext, rev, top, cfg)
        return Calc(stages, {name: side_score(parts, cfg)}, lookback=cfg.scale_nest[-1] + 1, lead=cfg.horizon)

    return spec


def detail_spec(ext: str, rev: str, top: bool, cfg: OracleConfig) -> Spec:
    """The pieces of the score as columns: decidable, candidate, extreme_<s>, reversal_<s>."""

    def spec(fr: Frames) -> Calc:
        stages, parts = side_parts(fr, ext, rev, top, cfg)
        def and_decidable(col: str) -> Each:
            return each(both, parts["decidable"], col, kind="boolean")

        out = {"decidable": Each(lambda x: x, (parts["decidable"],), "boolean"), "candidate": and_decidable(parts["candidate"])}
        for s, e, r in zip(cfg.scale_nest, parts["extreme"], parts["reversal"]):
            out |= {f"extreme_{s}": and_decidable(e), f"reversal_{s}": and_decidable(r)}
        return Calc(stages, out, lookback=cfg.scale_nest[-1] + 1, lead=cfg.horizon)

    return spec


def label_specs(cfg: OracleConfig = STRUCTURAL) -> tuple[Spec, Spec]:
    return (
        side_spec("high", "low", True, cfg, "top_score"),
        side_spec("low", "high", False, cfg, "bottom_score"),
    )


def with_tiers(df: DataFrame, cfg: OracleConfig) -> DataFrame:
    """Tier and weight columns next to the scores."""
    return df.withColumns(
        {
            "top_tier": tier(F.col("top_score"), cfg.tau_strong, cfg.tau_regular),
            "bottom_tier": tier(F.col("bottom_score"), cfg.tau_strong, cfg.tau_regular),
            "top_weight": F.col("top_score"),
            "bottom_weight": F.col("bottom_score"),
        }
    )


def label_turns(bars: DataFrame, cfg: OracleConfig = STRUCTURAL, **layout) -> DataFrame:
    """Scores, tiers and weights of both sides for every bar."""
    return with_tiers(compute(bars, label_specs(cfg), **layout), cfg)


def label_side(bars: DataFrame, ext: str, rev: str, top: bool, cfg: OracleConfig = STRUCTURAL, **layout) -> DataFrame:
    """One side; `ext == rev` gives the single-series variant."""
    return compute(bars, [side_spec(ext, rev, top, cfg, "score")], **layout)


def truncation_check(bars: DataFrame, cfg: OracleConfig, keep_bars: int, **layout) -> DataFrame:
    """Labels that change when every series is cut after `keep_bars` bars; only undecided bars may differ.

    Expects `bar` on `bars`. An empty result means labels look no further than the horizon.
    """
    raw = [c for c in bars.columns if c not in ("bar", "n_bars")]
    cols = ["symbol", "bar", "top_score", "bottom_score"]
    full = label_turns(bars, cfg, **layout).filter(F.col("bar") + F.lit(cfg.horizon) < F.lit(keep_bars))
    cut = label_turns(bars.filter(F.col("bar") < keep_bars).select(*raw), cfg, **layout)
    cut = cut.filter(F.col("bar") + F.lit(cfg.horizon) < F.lit(keep_bars))
    return full.select(*cols).exceptAll(cut.select(*cols))


def known_event_check(
    labels: DataFrame, events: DataFrame, tolerance: int = 3, side: str = "bottom", bar_seconds: int = DAY, **layout
) -> DataFrame:
    """Nearest bar to each target time and the best tier and score within `tolerance` bars of it.

    `labels` needs `bar`, `n_bars`; `events` has symbol, event, target. The nearest bar is the last one up to the
    target or its successor; ties go to the earlier bar.
    """
    nxt = _with_next(labels, bar_seconds, **layout)
    at = asof_backward(
        events.select("symbol", "event", F.col("target").alias("time")),
        nxt.withColumn("at_time", F.col("time")),
        ["bar", "at_time", "next_time"],
        strict=False,
        bar_seconds=bar_seconds,
    )
    later = (F.col("next_time") - F.col("time")) < (F.col("time") - F.col("at_time"))
    near = F.coalesce(F.when(later, F.col("bar") + 1).otherwise(F.col("bar")), F.lit(0))
    wanted = at.select("symbol", "event", F.col("time").alias("target"), near.alias("nearest_bar")).withColumn(
        "bar", F.explode(F.sequence(F.col("nearest_bar") - tolerance, F.col("nearest_bar") + tolerance))
    )
    rank = F.when(F.col(f"{side}_tier") == "strong", 2).when(F.col(f"{side}_tier") == "regular", 1).otherwise(0)
    found = wanted.join(labels.select("symbol", "bar", f"{side}_tier", f"{side}_score"), ["symbol", "bar"])
    best = found.groupBy("symbol", "event", "target", "nearest_bar").agg(
        F.max(rank).alias("_r"), F.max(f"{side}_score").alias("best_score")
    )
    name = F.element_at(F.array(F.lit("none"), F.lit("regular"), F.lit("strong")), F.col("_r") + 1)
    return best.withColumn("best_tier", name).withColumn("passed", F.col("_r") >= 1).drop("_r")


def _with_next(labels: DataFrame, bar_seconds: int, **layout) -> DataFrame:
    """Add the time of the following bar."""

    def spec(fr: Frames) -> Calc:
        return Calc([{"_next": F.lead("time", 1).over(fr.order)}], {"next_time": F.col("_next")}, lead=1)

    return compute(labels, [spec], bar_seconds=bar_seconds, **layout)
