"""Probability of backtest overfitting over symmetric block combinations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.layout import global_rank
from tidemark.session import materialise

#: Combinations of blocks are a list in the plan and a broadcast table: C(16, 8).
MAX_COMBINATIONS = 12_870
GROUP_CONFIGS, RANGE_COMBOS = 512, 2_048
#: Combinations times configs that are worked on at a time.
SLICE_CELLS = 1 << 16


def _masks(n_splits: int) -> list[int]:
    """Bit masks of all halves of the blocks, in order of the combinations."""
    if math.comb(n_splits, n_splits // 2) > MAX_COMBINATIONS:
        raise ValueError(f"{n_splits} blocks have more than {MAX_COMBINATIONS} combinations")
    return [sum(1 << b for b in c) for c in combinations(range(n_splits), n_splits // 2)]


def _performance(n: Column, s: Column, ss: Column) -> Column:
    """mean / sample std from sums; zero spread (to rounding) falls back to the mean."""
    mean = s / n
    var = F.when(n > 1, F.greatest((ss - s * mean) / (n - 1), F.lit(0.0))).otherwise(F.lit(0.0))
    flat = var <= F.lit(1e-14) * (ss / n)
    return F.when(flat, mean).otherwise(F.try_divide(mean, F.sqrt(F.when(flat, F.lit(1.0)).otherwise(var))))


def block_stats(perf: DataFrame, n_splits: int) -> DataFrame:
    """(block, config, n, s, ss) over equal contiguous blocks of t; the remainder at the end is dropped."""
    if n_splits < 2 or n_splits % 2:
        raise ValueError(f"n_splits must be an even integer >= 2, got {n_splits}")
    times = global_rank(perf.select("t").distinct(), [F.col("t")], "_i")
    n_obs = times.count()
    if n_obs < n_splits:
        raise ValueError(f"need at least {n_splits} time points, got {n_obs}")
    size = n_obs // n_splits
    kept = times.filter(F.col("_i") < size * n_splits).select("t", F.floor(F.col("_i") / F.lit(size)).cast("int").alias("block"))
    v = F.col("value")
    return (
        perf.join(kept, "t")
        .groupBy("block", "config")
        .agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))
    )


def combo_performance(perf: DataFrame, n_splits: int) -> DataFrame:
    """(combo, config, is_perf, oos_perf) for every way to pick half of the blocks.

    Block sums are additive, so raw rows are read once; each (block, config) row is repeated per combination. `pbo_logits`
    does without this table.
    """
    picks = F.array(*[F.lit(m) for m in _masks(n_splits)])
    rows = block_stats(perf, n_splits).select("*", F.posexplode(picks).alias("combo", "_mask"))
    inside = F.getbit(F.col("_mask").cast("long"), F.col("block")) == 1
    parts = {}
    for tag, cond in (("is", inside), ("oos", ~inside)):
        for c in ("n", "s", "ss"):
            parts[f"{tag}_{c}"] = F.sum(F.when(cond, F.col(c)).otherwise(F.lit(0)))
    agg = rows.groupBy("combo", "config").agg(*[x.alias(k) for k, x in parts.items()])
    return agg.select(
        "combo",
        "config",
        _performance(F.col("is_n"), F.col("is_s"), F.col("is_ss")).alias("is_perf"),
        _performance(F.col("oos_n"), F.col("oos_s"), F.col("oos_ss")).alias("oos_perf"),
    )


def _half_sums(x: np.ndarray) -> np.ndarray:
    """Sums of every subset of the leading axis, by bit mask: a mask adds its highest block to the rest."""
    out = np.zeros((1 << len(x), *x.shape[1:]))
    for b in range(len(x)):
        out[1 << b : 2 << b] = out[: 1 << b] + x[b]
    return out


def _ratios(n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> np.ndarray:
    """`_performance` over arrays; no rows give NaN."""
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = s / n
        var = np.where(n > 1, np.maximum((ss - s * mean) / (n - 1), 0.0), 0.0)
        return np.where(var <= 1e-14 * (ss / n), mean, mean / np.sqrt(var))


def _sides(row: dict, n_splits: int, masks: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """In-sample and out-of-sample performance, (combination, config), of slices of the combinations.

    The blocks are cut in two halves, whose subset sums are tabulated: a combination is one addition for each side,
    and no sum is carried from one combination to the next.
    """
    x = np.asarray(row["stats"], float).reshape(-1, n_splits, 3).transpose(1, 2, 0)
    cut = n_splits // 2
    low, high = _half_sums(x[:cut]), _half_sums(x[cut:])
    every = (1 << cut) - 1
    at = max(1, SLICE_CELLS // x.shape[2])
    for i in range(0, len(masks), at):
        m = masks[i : i + at]
        inside = low[m & every] + high[m >> cut]
        outside = low[~m & every] + high[~(m >> cut) & ((1 << n_splits - cut) - 1)]
        yield slice(i, i + len(m)), *(_ratios(t[:, 0], t[:, 1], t[:, 2]) for t in (inside, outside))


def pbo_logits(
    perf: DataFrame, n_splits: int = 10, group_configs: int = GROUP_CONFIGS, range_combos: int = RANGE_COMBOS
) -> DataFrame:
    """(combo, best_config, logit): out-of-sample rank of the in-sample best as a logit; ties share the mean rank.

    Configs go in groups, combinations in ranges, and a task takes one of each: no row per combination and config.
    Each combination's best in a group is found first, then the best of all, then every group counts the configs below
    and level with it. Equal in-sample scores: the lowest config wins. A config without values on a side is undefined
    there: never best, below and level with none, yet one of the configs ranked.
    """
    masks = np.array(_masks(n_splits), np.int64)
    total = len(masks)
    stats = materialise(block_stats(perf, n_splits))
    configs = stats.agg(F.count_distinct("config")).first()[0]
    groups = max(1, -(-configs // group_configs))
    flat = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(n_splits - 1)),
            lambda b: F.coalesce(F.element_at("_by", b), F.array(*[F.lit(0.0)] * 3)),
        )
    )
    entry = F.struct("block", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("n", "s", "ss")]))
    each = stats.groupBy("config").agg(F.map_from_entries(F.collect_list(entry)).alias("_by")).select("config", flat.alias("_f"))
    packed = each.groupBy(F.pmod(F.xxhash64("config"), F.lit(groups)).alias("_g")).agg(
        F.sort_array(F.collect_list(F.struct("config", "_f"))).alias("_l")
    )
    ranges = F.explode(F.sequence(F.lit(0), F.lit((total - 1) // range_combos))).alias("_r")
    packed = materialise(packed.select(F.col("_l.config").alias("configs"), F.flatten(F.col("_l._f")).alias("stats"), ranges))
    packed = packed.repartition("_r", F.xxhash64("configs"))

    def masks_of(r: int) -> np.ndarray:
        return masks[r * range_combos : (r + 1) * range_combos]

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                for at, inside, outside in _sides(row, n_splits, masks_of(row["_r"])):
                    score = np.where(np.isnan(inside), -np.inf, inside)
                    best = score.argmax(axis=1)
                    i = np.flatnonzero(~np.isnan(inside).all(axis=1))
                    ref = outside[i, best[i]]
                    yield pd.DataFrame(
                        {
                            "combo": row["_r"] * range_combos + at.start + i,
                            "score": score[i, best[i]],
                            "config": [row["configs"][k] for k in best[i]],
                            "ref": ref,
                        }
                    )

    kind = perf.schema["config"].dataType.simpleString()
    found = packed.mapInPandas(tops, f"combo int, score double, config {kind}, ref double")
    order = F.struct((-F.col("score")).alias("minus"), "config", "ref")
    best = materialise(found.groupBy("combo").agg(F.min(order).alias("_b")).select("combo", "_b.config", "_b.ref"))
    # the outcomes of a range as one list
    of_range = best.groupBy(F.floor(F.col("combo") / range_combos).cast("int").alias("_r")).agg(
        F.map_from_entries(F.collect_list(F.struct("combo", "ref"))).alias("_refs")
    )

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                first, refs = row["_r"] * range_combos, dict(row["_refs"])
                for at, _, outside in _sides(row, n_splits, masks_of(row["_r"])):
                    combo = first + np.arange(at.start, at.stop)
                    ref = np.array([refs.get(c, np.nan) for c in combo.tolist()], float)[:, None]
                    less, eq = (outside < ref).sum(axis=1), (outside == ref).sum(axis=1)
                    yield pd.DataFrame({"combo": combo, "less": less, "eq": eq, "n": outside.shape[1]})

    counted = packed.join(of_range, "_r").mapInPandas(places, "combo int, less long, eq long, n long")
    ranked = counted.groupBy("combo").agg(*[F.sum(c).alias(c) for c in ("less", "eq", "n")]).join(best, "combo")
    omega = (F.col("less") + (F.col("eq") + 1) / 2.0) / (F.col("n") + 1.0)
    clipped = F.greatest(F.lit(1e-12), F.least(F.lit(1.0 - 1e-12), omega))
    return ranked.select("combo", F.col("config").alias("best_config"), F.log(clipped / (F.lit(1.0) - clipped)).alias("logit"))


def pbo_cscv(perf: DataFrame, n_splits: int = 10) -> DataFrame:
    """One row: share of combinations whose logit is <= 0."""
    return pbo_logits(perf, n_splits).agg(
        F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("n_combos")
    )


def out_of_sample_blocks(perf: DataFrame, n_splits: int) -> DataFrame:
    """(combo, block) pairs outside the in-sample half; combos count the masks in ascending order from 1."""
    masks = sorted(_masks(n_splits))
    blocks = block_stats(perf, n_splits).select("block").distinct()
    rows = blocks.select("block", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("_i", "_m"))
    keep = F.getbit(F.col("_m").cast("long"), F.col("block")) == 0
    return rows.filter(keep).select((F.col("_i") + 1).cast("long").alias("combo"), "block")
