"""Slices, scorecards, threshold tuning and small reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import with_prf
from tidemark.operators.events import match_counts
from tidemark.operators.ranking import quantiles
from tidemark.operators.sweep import match_gains
from tidemark.session import materialise

COUNTS = ("tp", "fp", "fn")


def slice_scores(events: DataFrame, tolerance: int, by: Sequence[str] = ()) -> DataFrame:
    """Scores per (by, asset), per by, and over all; absent keys read 'all'.

    Events are matched once per series; the wider slices add up counts.
    """
    keys = [*by, "symbol"]
    rolled = match_counts(events, tolerance, by).rollup(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])
    named = rolled.withColumns({k: F.coalesce(F.col(k), F.lit("all")) for k in keys}).withColumnRenamed("symbol", "asset")
    out = with_prf(named)
    return out.withColumns({"n_pred": F.col("tp") + F.col("fp"), "n_true": F.col("tp") + F.col("fn")})


def label_balance(df: DataFrame) -> DataFrame:
    """Counts of strong / regular / positive labels per symbol and side, with totals."""
    sides = F.array(
        F.struct(F.lit("top").alias("side"), F.col("top_tier").alias("tier")),
        F.struct(F.lit("bottom").alias("side"), F.col("bottom_tier").alias("tier")),
    )
    long = df.select("symbol", F.explode(sides).alias("_s")).select("symbol", "_s.side", "_s.tier")

    # counted per (symbol, side, tier) before the cube multiplies the rows
    small = long.groupBy("symbol", "side", "tier").agg(F.count(F.lit(1)).alias("c"))

    def c(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("c")).otherwise(0))

    positive = c(F.col("tier") != "none")
    return (
        small.cube("symbol", "side")
        .agg(
            F.sum("c").alias("n"),
            c(F.col("tier") == "strong").alias("n_strong"),
            c(F.col("tier") == "regular").alias("n_regular"),
            positive.alias("n_positive"),
            (positive / F.sum("c")).alias("positive_rate"),
        )
        .withColumns({"symbol": F.coalesce("symbol", F.lit("all")), "side": F.coalesce("side", F.lit("both"))})
    )


SCORECARD = ("side", "asset", "era", *COUNTS, "precision", "recall", "f1", "deflated")


def scorecard(*slices: DataFrame) -> DataFrame:
    """Slices as rows keyed (side, asset, era), sorted; `deflated` is null where not computed."""
    rows = []
    for s in slices:
        s = s if "deflated" in s.columns else s.withColumn("deflated", F.lit(None).cast("double"))
        rows.append(s.select(*SCORECARD))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.orderBy("side", "asset", "era")


def agreement_rate(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows on which two detectors agree."""
    return df.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("fidelity"), F.count(F.lit(1)).alias("n"))


def compare_to_baseline(new: DataFrame, base: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Metric, baseline, difference and verdict per key."""
    old = base.select(*keys, F.col(metric).alias(f"baseline_{metric}"))
    delta = F.col(metric) - F.col(f"baseline_{metric}")
    verdict = F.when(delta > 0, "better").when(delta < 0, "worse").otherwise("equal")
    return new.select(*keys, metric).join(old, list(keys)).withColumns({"delta": delta, "verdict": verdict})


def constant_score_check(df: DataFrame, score: str, by: Sequence[str] = (), eps: float = 1e-9) -> DataFrame:
    """Spread of the score per group and whether it is practically constant."""
    spread = F.max(score) - F.min(score)
    return df.groupBy(*by).agg(spread.alias("spread")).withColumn("is_constant", F.col("spread") < eps)


def tune_threshold(
    df: DataFrame, tolerance: int, grid: int = 50, by: Sequence[str] = ("fold",), score: str = "score", true: str = "is_true",
    budget: tuple[int, int] | None = None,
) -> DataFrame:
    """Threshold with the best event F1 per group; ties go to the highest, a group without events gets 0.5.

    Candidates are `grid` quantiles of the score and the value just below the maximum. With a `budget` (least, factor)
    candidates that flag more than max(least, factor x events) rows are dropped; (512, 6) is the setting of a matcher
    whose time is cubic, so there is none by default. Rows are matched once for all candidates, see `sweep`. Equal
    ratios 2 tp / (2 tp + fp + fn) are equal doubles, so ties are exact.
    """
    keys = list(by)
    given = df.select(*keys, "symbol", "bar", F.col(score).alias("_s"), F.coalesce(F.col(true), F.lit(False)).alias("_y"))
    rows = materialise(given)
    probs = [i / (grid - 1) for i in range(grid)] if grid > 1 else [0.0]
    cand = quantiles(rows, keys, "_s", probs).select(*keys, F.col("value").alias("thr"))
    groups = materialise(rows.groupBy(*keys).agg(F.sum(F.col("_y").cast("long")).alias("n_true"), F.max("_s").alias("_max")))
    cand = cand.unionByName(groups.select(*keys, _just_below(F.col("_max")).alias("thr"))).distinct()
    # at most grid + 1 thresholds per group; written so that its size is known to the joins
    lists = materialise(cand.groupBy(*keys).agg(F.sort_array(F.collect_list("thr"), False).alias("_thrs")))
    # rows join at the first candidate they pass: _k = number of stricter candidates, found by halving
    steps = rows.join(lists, keys).withColumn("_k", F.lit(0))
    for bit in reversed(range((len(probs) + 1).bit_length())):
        stricter = F.get("_thrs", F.col("_k") + F.lit((1 << bit) - 1)) > F.col("_s")
        steps = steps.withColumn("_k", F.col("_k") + F.when(stricter, F.lit(1 << bit)).otherwise(F.lit(0)))
    steps = steps.withColumn("_steps", F.size("_thrs")).drop("_s", "_thrs")
    steps = materialise(steps.withColumn("_k", F.when(F.col("_k") < F.col("_steps"), F.col("_k"))))
    per = steps.groupBy(*keys, "_k").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("_y").cast("long")).alias("t"))
    per = per.join(match_gains(steps, tolerance, keys), [*keys, "_k"], "left")
    tallies = per.groupBy(*keys).agg(F.collect_list(F.struct("_k", "c", "gain")).alias("_cs"), F.sum("t").alias("n_true"))
    spread = tallies.join(lists, keys).select(*keys, "n_true", "_cs", F.posexplode("_thrs").alias("_i", "thr"))

    def upto(field: str) -> Column:
        def add(total: Column, x: Column) -> Column:
            return total + F.when(x["_k"] <= F.col("_i"), F.coalesce(x[field], F.lit(0))).otherwise(F.lit(0)).cast("long")

        return F.aggregate("_cs", F.lit(0).cast("long"), add)

    scored = spread.withColumns({"n_flagged": upto("c"), "tp": upto("gain")}).filter(F.col("n_true") > 0)
    if budget is not None:
        scored = scored.filter(F.col("n_flagged") <= F.greatest(F.lit(budget[0]).cast("long"), F.col("n_true") * budget[1]))
    # 2 tp + fp + fn = flagged rows + events
    scored = scored.withColumn("f1", 2 * F.col("tp") / (F.col("n_flagged") + F.col("n_true")))
    best = scored.groupBy(*keys).agg(F.max(F.struct("f1", F.col("thr").alias("threshold"))).alias("_b"))
    out = groups.join(best, keys, "left")
    fallback = F.when(F.col("n_true") == 0, F.lit(0.5)).otherwise(F.col("_max"))
    return out.select(
        *keys, F.coalesce(F.col("_b.threshold"), fallback).alias("threshold"), F.coalesce(F.col("_b.f1"), F.lit(0.0)).alias("f1")
    )


def _just_below(x: Column) -> Column:
    """The double next to x towards 0."""
    return x * F.lit(1.0 - 2.0**-53)
