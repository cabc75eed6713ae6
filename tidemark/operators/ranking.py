"""Threshold-free ranking metrics on scored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import scored_only
from tidemark.layout import global_rank, global_running
from tidemark.operators.events import match_counts
from tidemark.session import materialise

K_FIXED = 25


def check_binary(df: DataFrame, y: str, weight: str | None = None) -> DataFrame:
    """Fail on labels other than 0/1 or negative weights."""
    bad = ~F.col(y).isin(0, 1)
    if weight is not None:
        bad = bad | (F.col(weight) < 0)
    return df.withColumn(y, F.when(bad, F.raise_error(F.lit("labels must be 0/1, weights >= 0")).cast("int")).otherwise(F.col(y)))


def average_precision(
    df: DataFrame, score: str, y: str, weight: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Sum over distinct scores, from high to low, of (gain in recall) x precision; 0 without positives.

    Equal scores are one threshold: they are summed first, on the map side, so a score shared by a third of all
    rows costs one row. The running sums go over range partitions.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    checked = check_binary(df, y, weight)
    steps = checked.groupBy(*by, score).agg(F.sum(w * F.col(y)).alias("_tp"), F.sum(w).alias("_all"))
    run = global_running(
        steps, list(by), [F.col(score).desc()], {"_ctp": F.col("_tp"), "_call": F.col("_all")}
    )
    gain = F.col("_tp") * F.coalesce(F.try_divide(F.col("_ctp"), F.col("_call")), F.lit(0.0))
    total = F.sum("_tp")
    return run.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(gain), total), F.lit(0.0)).alias("average_precision"))


def _top(df: DataFrame, score: str, pos: str, k: int) -> DataFrame:
    if k < 1:
        raise ValueError(f"k must be >= 1, got {k}")
    best = df.orderBy(F.col(score).desc(), F.col(pos)).limit(k)
    # at most k rows are counted
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    short = F.raise_error(F.concat(F.lit(f"k is {k}, but there are only "), n.cast("string"), F.lit(" rows"))).cast("boolean")
    return best.withColumn("_n", F.when(n < k, short).otherwise(F.lit(True))).filter("_n").drop("_n")


def top_k(df: DataFrame, score: str, pos: str, k: int) -> DataFrame:
    """The k rows with the highest score, ties by ascending position; fewer rows than k fail."""
    return _top(df, score, pos, k)


def precision_at_k(df: DataFrame, score: str, y: str, k: int, pos: str) -> DataFrame:
    return _top(check_binary(df, y), score, pos, k).agg((F.sum(y) / F.lit(float(k))).alias("precision_at_k"))


def recall_at_k(df: DataFrame, score: str, y: str, k: int, pos: str) -> DataFrame:
    hits = _top(check_binary(df, y), score, pos, k).agg(F.sum(y).alias("_h"))
    total = df.agg(F.sum(y).alias("_t")).scalar()
    return hits.select(F.coalesce(F.try_divide(F.col("_h").cast("double"), total.cast("double")), F.lit(0.0)).alias("recall_at_k"))


def lift_at_k(df: DataFrame, score: str, y: str, k: int, pos: str) -> DataFrame:
    p = precision_at_k(df, score, y, k, pos)
    base = df.agg(F.avg(F.col(y).cast("double"))).scalar()
    return p.select(F.coalesce(F.try_divide(F.col("precision_at_k"), base), F.lit(0.0)).alias("lift_at_k"))


def at_k_event(df: DataFrame, score: str, true: str, k: int, tolerance: int) -> DataFrame:
    """precision and recall of the k best-scored bars against true events, matched per series within a tolerance."""
    best = top_k(df.withColumn("_pos", F.struct("symbol", "bar")), score, "_pos", k)
    picks = best.select("symbol", "bar", F.lit(True).alias("is_pred"), F.lit(False).alias("is_true"))
    truth = df.filter(F.col(true)).select("symbol", "bar", F.lit(False).alias("is_pred"), F.lit(True).alias("is_true"))
    merged = picks.unionByName(truth).groupBy("symbol", "bar").agg(
        F.max("is_pred").alias("is_pred"), F.max("is_true").alias("is_true")
    )
    c = match_counts(merged, tolerance).agg(
        F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.col("tp") + F.col("fn")), F.lit(0)).alias("n_true")
    )
    return c.select(
        F.col("tp").cast("long").alias("tp"),
        F.col("n_true").cast("long").alias("n_true"),
        (F.col("tp") / F.lit(float(k))).alias("precision_at_k"),
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_true").cast("double")), F.lit(0.0)).alias("recall_at_k"),
    )


def precision_at_k_event(df: DataFrame, score: str, true: str, k: int, tolerance: int) -> DataFrame:
    return at_k_event(df, score, true, k, tolerance).select("precision_at_k")


def recall_at_k_event(df: DataFrame, score: str, true: str, k: int, tolerance: int) -> DataFrame:
    return at_k_event(df, score, true, k, tolerance).select("recall_at_k")


def with_group_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """0-based rank inside each `by` group along `order`, split over range partitions; adds `_n_group`."""
    ranked = global_rank(df, [*[F.col(c) for c in by], *order], "_grank")
    firsts = ranked.groupBy(*by).agg(F.min("_grank").alias("_first"), F.count(F.lit(1)).alias("_n_group"))
    if not by:
        return ranked.withColumn(name, F.col("_grank")).withColumn("_n_group", F.lit(None).cast("long")).drop("_grank")
    # one row per group, written so that its size is known: small ones are broadcast, and the rows stay where they are
    return ranked.join(materialise(firsts), list(by)).withColumn(name, F.col("_grank") - F.col("_first")).drop("_grank", "_first")


def rank_slice(
    df: DataFrame, score: str, y: str, weight: str, pos: Sequence[str], by: Sequence[str] = (), k: int = K_FIXED
) -> DataFrame:
    """n, n_true, AP, weighted AP, precision / recall / lift at k and at n_true; slices without positives drop out."""
    rows = check_binary(scored_only(df, score), y, weight)
    keys = list(by) or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(1))
    stats = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("n_true")))
    ranked = with_group_rank(rows, keys, [F.col(score).desc(), *[F.col(p) for p in pos]], "_r").drop("_n_group")
    sized = ranked.join(stats, keys)
    k25 = F.least(F.lit(k).cast("long"), F.col("n"))
    kt = F.least(F.greatest(F.col("n_true"), F.lit(1)), F.col("n"))
    hit = sized.groupBy(*keys, "n", "n_true").agg(
        F.sum(F.when(F.col("_r") < k25, F.col(y)).otherwise(0)).alias("_h25"),
        F.sum(F.when(F.col("_r") < kt, F.col(y)).otherwise(0)).alias("_ht"),
    )
    ap = average_precision(rows, score, y, None, keys).withColumnRenamed("average_precision", "ap")
    apw = average_precision(rows, score, y, weight, keys).withColumnRenamed("average_precision", "ap_weighted")
    out = hit.join(ap, keys).join(apw, keys).filter("n_true > 0")
    base = F.col("n_true") / F.col("n")

    def trio(h: str, kk: Column, tag: str) -> dict[str, Column]:
        p = F.col(h) / kk.cast("double")
        return {f"p_at_{tag}": p, f"r_at_{tag}": F.col(h) / F.col("n_true"), f"lift_at_{tag}": F.try_divide(p, base)}

    out = out.withColumns(trio("_h25", k25, str(k)) | trio("_ht", kt, "ntrue")).drop("_h25", "_ht")
    return out if by else out.drop("_all")


def _bucket(v: Column) -> Column:
    """Whole number that never falls as the double v rises, about 700 to a doubling; null first, NaN last."""
    size = F.floor(F.least(F.log1p(F.abs(v) * F.lit(2.0**30)), F.lit(1e6)) * F.lit(1024.0))
    return F.when(v.isNull(), F.lit(-(1 << 40))).when(F.isnan(v), F.lit(1 << 40)).otherwise(F.signum(v).cast("long") * size)


def quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolation quantiles per group as rows (by, prob_index, value), from exact ranks.

    Values are counted by bucket, and only those in the buckets that hold the two neighbours of a quantile position are
    ranked. `df` is read twice.
    """
    keys = list(by) or ["_all"]
    rows = (df if by else df.withColumn("_all", F.lit(1))).select(*keys, F.col(col).cast("double").alias("_v"))
    rows = rows.withColumn("_b", _bucket(F.col("_v")))
    counts = materialise(rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c")))
    # buckets, not rows: 1.5 million a group if every double occurs, some thousands as a rule
    group = Window.partitionBy(*keys)
    run = counts.withColumns({"_until": F.sum("_c").over(group.orderBy("_b")), "_n": F.sum("_c").over(group)})
    ends = [fn(F.lit(float(p)) * (F.col("_n") - 1)) for p in probs for fn in (F.floor, F.ceil)]
    held = F.filter(F.array_distinct(F.array(*ends)), lambda r: (r >= F.col("_until") - F.col("_c")) & (r < F.col("_until")))
    hits = run.withColumn("_rs", held).filter(F.size("_rs") > 0)
    hits = materialise(hits.select(*keys, "_b", "_rs", "_n", (F.col("_until") - F.col("_c")).alias("_before")))
    near = rows.join(hits.select(*keys, "_b"), [*keys, "_b"]).groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    near = global_running(near, [*keys, "_b"], [F.col("_v")], {"_in": F.col("_c")}).join(hits, [*keys, "_b"])
    near = near.withColumn("_until", F.col("_before") + F.col("_in"))
    mine = F.filter("_rs", lambda r: (r >= F.col("_until") - F.col("_c")) & (r < F.col("_until")))
    near = near.select(*keys, "_v", F.explode(mine).alias("_r"))
    lits = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    sizes = hits.groupBy(*keys).agg(F.max("_n").alias("_n"))
    wanted = sizes.withColumn("_q", F.explode(lits)).withColumn("_at", F.col("_q.p") * (F.col("_n") - 1))
    ends = wanted.select(
        *keys,
        F.col("_q.i").alias("prob_index"),
        "_at",
        F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_r"),
    )
    near = near.join(ends, [*keys, "_r"])
    lo = F.min_by("_v", "_r")
    hi = F.max_by("_v", "_r")
    out = near.groupBy(*keys, "prob_index").agg((lo + (hi - lo) * (F.first("_at") - F.floor(F.first("_at")))).alias("value"))
    return out if by else out.drop("_all")
