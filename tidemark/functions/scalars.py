"""Row-level expressions: safe ratios, clamps, targets, scores from counts, normal distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_FLOOR = 1e-10
POSITIVE_TIERS = ("strong", "regular")


def _c(x: Column | str | float | int) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(x))


def safe_log_ratio(num: Column, den: Column) -> Column:
    """ln(max(num, 1e-10) / max(den, 1e-10))."""
    floor = F.lit(LOG_FLOOR)
    return F.log(F.greatest(num, floor) / F.greatest(den, floor))


def clamp_unit(x: Column) -> Column:
    """Clamp to [-1, 1]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def clip01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def logit(p: Column, eps: float = 1e-12) -> Column:
    """ln(p / (1 - p)) with p clipped to [eps, 1 - eps]."""
    q = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))
    return F.log(q / (F.lit(1.0) - q))


def signed_log(x: Column) -> Column:
    """signum(x) * ln(1 + |x|): tames the unbounded momentum divergence."""
    return F.signum(x) * F.log1p(F.abs(x))


def tier(score: Column, strong: float, regular: float) -> Column:
    """strong / regular / none, both thresholds inclusive."""
    return F.when(score >= strong, F.lit("strong")).when(score >= regular, F.lit("regular")).otherwise(F.lit("none"))


# --------------------------------------------------------------------------- targets and weights


def with_targets(df: DataFrame, side: str, pos_boost: float = 1.0) -> DataFrame:
    """Columns y, sample_weight, boosted_weight, ap_weight for one side (top or bottom).

    The raw label score is 0 on non-turns, so weights are built from 1 + score on turns and 1 elsewhere.
    """
    y = F.col(f"{side}_tier").isin(*POSITIVE_TIERS).cast("int")
    w = F.lit(1.0) + F.col(f"{side}_score")
    return df.withColumns(
        {
            "y": y,
            "sample_weight": F.when(y == 1, w).otherwise(F.lit(1.0)),
            "boosted_weight": F.when(y == 1, F.lit(float(pos_boost)) * w).otherwise(F.lit(1.0)),
            "ap_weight": F.when(y == 1, w).otherwise(F.lit(1.0)),
        }
    )


def class_ratio(df: DataFrame, y: str = "y", cap: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """n_neg / max(n_pos, 1); with `cap`: clamped to [1, cap] and 1 when there are no positives."""
    pos, neg = F.sum(F.col(y)), F.sum(F.lit(1) - F.col(y))
    ratio = neg / F.greatest(pos, F.lit(1))
    if cap is not None:
        ratio = F.when(pos == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(float(cap)), ratio)))
    return df.groupBy(*by).agg(pos.cast("long").alias("n_pos"), neg.cast("long").alias("n_neg"), ratio.alias("ratio"))


def scored_only(df: DataFrame, score: str, keep: Column | None = None) -> DataFrame:
    """Rows with a score, optionally inside a subset."""
    cond = F.col(score).isNotNull() & ~F.isnan(score)
    return df.filter(cond if keep is None else cond & keep)


# --------------------------------------------------------------------------- scores from counts


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall, f1; an empty denominator gives 0."""
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), zero)
    r = F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), zero)
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * p * r, p + r), zero)
    return {"precision": p, "recall": r, "f1": f1}


def with_prf(df: DataFrame) -> DataFrame:
    """Add precision, recall, f1 from tp, fp, fn; negative counts are an error."""
    bad = (F.col("tp") < 0) | (F.col("fp") < 0) | (F.col("fn") < 0)
    tp = F.when(bad, F.raise_error(F.lit("negative event count")).cast("long")).otherwise(F.col("tp"))
    return df.withColumns(prf(tp, F.col("fp"), F.col("fn")))


# --------------------------------------------------------------------------- normal distribution

# Hart's rational approximation of the normal tail, double precision (West 2005).
CDF_NUM = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
CDF_DEN = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
    637.333633378831, 793.826512519948, 440.413735824752,
)
CDF_SPLIT = 7.07106781186547
SQRT_2PI = 2.506628274631
# Acklam's rational approximation of the normal quantile.
PPF_A = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
PPF_B = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0,
)
PPF_C = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
PPF_LOW = 0.02425
EULER_GAMMA = 0.5772156649015329


def _horner(coefs: tuple[float, ...], x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def _let(x: Column, fn) -> Column:
    """fn(x) with x evaluated once, so that long formulas do not repeat it."""
    return F.element_at(F.transform(F.array(x), fn), 1)


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution function."""
    return _let(z, _norm_cdf)


def norm_ppf(p: Column) -> Column:
    """Standard normal quantile for 0 < p < 1."""
    return _let(p, _norm_ppf)


def _norm_cdf(z: Column) -> Column:
    a = F.abs(z)
    e = F.exp(-a * a / 2.0)
    far = a
    for k in (0.65, 4.0, 3.0, 2.0, 1.0):
        far = a + (F.lit(k) if k == 0.65 else F.lit(k) / far)
    tail = F.when(a < CDF_SPLIT, e * _horner(CDF_NUM, a) / _horner(CDF_DEN, a)).otherwise(e / far / F.lit(SQRT_2PI))
    return F.when(z > 0, F.lit(1.0) - tail).otherwise(tail)


def _norm_ppf(p: Column) -> Column:
    q = p - 0.5
    r = q * q
    mid = _horner(PPF_A, r) * q / _horner(PPF_B, r)

    def tail(u: Column) -> Column:
        t = F.sqrt(F.lit(-2.0) * F.log(u))
        return _horner(PPF_C, t) / _horner(PPF_D, t)

    return F.when(p < PPF_LOW, tail(p)).when(p > 1.0 - PPF_LOW, -tail(F.lit(1.0) - p)).otherwise(mid)


def expected_max_sharpe(n_trials: Column, trials_std: Column) -> Column:
    """Expected maximum of n skill-free estimates; 0 for one trial or zero spread."""
    import math

    n = n_trials.cast("double")
    q1 = norm_ppf(F.lit(1.0) - F.lit(1.0) / n)
    q2 = norm_ppf(F.lit(1.0) - F.lit(1.0) / (n * F.lit(math.e)))
    return F.when((n_trials <= 1) | (trials_std == 0.0), F.lit(0.0)).otherwise(
        trials_std * (F.lit(1.0 - EULER_GAMMA) * q1 + F.lit(EULER_GAMMA) * q2)
    )


def probabilistic_sharpe_ratio(
    observed: Column, benchmark: Column, n_obs: Column, skew: Column, kurtosis: Column
) -> Column:
    """P(true ratio > benchmark); null where n_obs < 2 or the variance term is not positive."""
    var = F.lit(1.0) - skew * observed + (kurtosis - 1.0) / 4.0 * observed * observed
    z = (observed - benchmark) * F.sqrt(n_obs.cast("double") - 1.0) / F.sqrt(var)
    return F.when((n_obs >= 2) & (var > 0), norm_cdf(z))


def deflated_metric(
    observed: Column,
    n_trials: Column,
    trials_std: Column,
    n_obs: Column | None = None,
    skew: Column | None = None,
    kurtosis: Column | None = None,
) -> Column:
    """Observed metric against the best of n skill-free trials: haircut, or a probability when n_obs is given."""
    bench = expected_max_sharpe(n_trials, trials_std)
    if n_obs is None:
        return observed - bench
    s = F.lit(0.0) if skew is None else skew
    k = F.lit(3.0) if kurtosis is None else kurtosis
    return probabilistic_sharpe_ratio(observed, bench, n_obs, s, k)
