"""Feature bank: named blocks, assembled in order into one wide table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.layout import Spec, compute
from tidemark.operators import features as X


@dataclass(frozen=True)
class FeatureConfig:
    """Grids of the bank; defaults give 36 columns, 45 with overextension."""

    pir_scales: tuple[int, ...] = (5, 10, 20, 50, 100)
    pir_lb_floor: int = 20
    agree_start: int = 3
    agree_end: int = 120
    agree_step: int = 13
    agree_pct: float = 0.8
    er_periods: tuple[int, ...] = (10, 20, 40)
    vola_methods: tuple[str, ...] = X.VOLA_METHODS
    vola_lengths: tuple[int, ...] = (14, 30)
    vola_range_len: int = 100
    trend_scales: tuple[int, ...] = (20, 50, 100)
    mom_lookbacks: tuple[int, ...] = (10, 20, 40)
    include_overextension: bool = False
    oe_sma_lengths: tuple[int, ...] = (50, 100, 200)
    oe_z_win: int = 100
    oe_dd_lookbacks: tuple[int, ...] = (20, 50, 100)
    oe_rv_win: int = 20
    oe_rv_range_len: int = 100
    oe_streak_cap: int = 5
    oe_vov_win: int = 20
    warmup_fill: float | None = None
    blocks: tuple[str, ...] = ("pir", "agreement", "efficiency", "vola", "trend", "momentum", "garch_har")


Block = Callable[[FeatureConfig], dict[str, Spec]]
_BLOCKS: dict[str, Block] = {}


def register_block(name: str) -> Callable[[Block], Block]:
    """Register a block: config -> ordered {column: spec}. Names are unique."""

    def deco(fn: Block) -> Block:
        if name in _BLOCKS:
            raise ValueError(f"feature block {name!r} is already registered")
        _BLOCKS[name] = fn
        return fn

    return deco


def get_block(name: str) -> Block:
    if name not in _BLOCKS:
        raise KeyError(f"unknown feature block {name!r}; known: {', '.join(sorted(_BLOCKS))}")
    return _BLOCKS[name]


@register_block("pir")
def _pir(c: FeatureConfig) -> dict[str, Spec]:
    return {f"pir_s{s}": X.pir_for_scale(s, max(s, c.pir_lb_floor)) for s in c.pir_scales}


@register_block("agreement")
def _agreement(c: FeatureConfig) -> dict[str, Spec]:
    spec = X.agreement(c.agree_start, c.agree_end, c.agree_step, c.agree_pct)
    return {"agree_high": spec, "agree_low": spec}


@register_block("efficiency")
def _efficiency(c: FeatureConfig) -> dict[str, Spec]:
    return {
        f"er_{tag}_p{p}": X.efficiency_ratio(p, tag == "dir") for p in c.er_periods for tag in ("dir", "abs")
    }


@register_block("vola")
def _vola(c: FeatureConfig) -> dict[str, Spec]:
    return {
        f"vola_pos_{m}_l{n}": X.vola_position(m, n, c.vola_range_len) for m in c.vola_methods for n in c.vola_lengths
    }


@register_block("trend")
def _trend(c: FeatureConfig) -> dict[str, Spec]:
    out: dict[str, Spec] = {}
    for s in c.trend_scales:
        out |= {f"sma_slope_s{s}": X.sma_slope(s), f"linreg_slope_s{s}": X.linreg_slope(s)}
    return out


@register_block("momentum")
def _momentum(c: FeatureConfig) -> dict[str, Spec]:
    out: dict[str, Spec] = {}
    for lb in c.mom_lookbacks:
        out |= {
            f"price_return_L{lb}": X.price_return(lb),
            f"mom_divergence_L{lb}": X.mom_divergence(lb),
            f"mom_velocity_L{lb}": X.mom_velocity(lb),
        }
    return out


@register_block("garch_har")
def _garch_har(c: FeatureConfig) -> dict[str, Spec]:
    return {"gjr_asym": X.gjr_asym(), "har_vol": X.har_vol()}


@register_block("overextension")
def _overextension(c: FeatureConfig) -> dict[str, Spec]:
    out = {f"dist_above_sma_z_l{n}": X.dist_above_sma_z(n, c.oe_z_win) for n in c.oe_sma_lengths}
    out |= {f"drawdown_from_high_l{n}": X.drawdown_from_high(n) for n in c.oe_dd_lookbacks}
    out["realized_vol_pct"] = X.realized_vol_pct(c.oe_rv_win, c.oe_rv_range_len)
    out["up_streak_norm"] = X.up_streak_norm(c.oe_streak_cap)
    out["vol_of_vol"] = X.vol_of_vol(c.oe_vov_win)
    return out


def bank_specs(cfg: FeatureConfig = FeatureConfig()) -> dict[str, Spec]:
    """Ordered {column: spec} of the configured blocks; a repeated column is an error."""
    blocks = list(cfg.blocks)
    if cfg.include_overextension and "overextension" not in blocks:
        blocks.append("overextension")
    out: dict[str, Spec] = {}
    for name in blocks:
        for col, spec in get_block(name)(cfg).items():
            if col in out:
                raise ValueError(f"duplicate feature column {col!r} in block {name!r}")
            out[col] = spec
    return out


def feature_names(cfg: FeatureConfig = FeatureConfig()) -> list[str]:
    return list(bank_specs(cfg))


def distinct_specs(specs: dict[str, Spec]) -> list[Spec]:
    """Specs in order, each once (a spec may give several columns)."""
    return list(dict.fromkeys(specs.values()))


def build_features(bars: DataFrame, cfg: FeatureConfig = FeatureConfig(), extra: tuple[Spec, ...] = (), **layout) -> DataFrame:
    """Bars plus all feature columns (and columns of `extra` specs) in one layout: a single exchange and sort.

    `digits` in `layout` rounds them, as `compute` says.
    """
    names = feature_names(cfg)
    base = [c for c in bars.columns if c not in ("bar", "n_bars")]
    out = compute(bars, [*distinct_specs(bank_specs(cfg)), *extra], **layout)
    if cfg.warmup_fill is not None:
        out = out.fillna(cfg.warmup_fill, subset=names)
    others = [c for c in out.columns if c not in {*base, "bar", "n_bars", *names}]
    return out.select(*base, "bar", "n_bars", *[F.col(n) for n in names], *others)
