"""Models on the pooled table: boosted scores per fold, small students, calibration, scaling, selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import average_precision, with_group_rank
from tidemark.operators.sequences import sequence_windows  # noqa: F401  (part of this module's interface)
from tidemark.operators.splits import per_symbol_join
from tidemark.session import materialise

# Sampling of negatives, grid of boosts, and limits of the selection.
NEG_PER_POS = 40
PREFIX_DIGITS = 4
BOOST_GRID = (5.0, 10.0, 20.0, 40.0)
RECOVERY_FLOOR, DEPLOY_F1_FRAC, NEAR_TIE = 0.70, 0.50, 0.98


@dataclass(frozen=True)
class GBTConfig:
    """Boosted classifier per fold."""

    max_iter: int = 100
    max_depth: int = 5
    step_size: float = 0.05
    min_leaf: int = 40
    subsample: float = 0.8
    max_bins: int = 64
    seed: int = 42
    balance: bool = True


@dataclass(frozen=True)
class StudentConfig:
    """Small deployable model: one tree, or a few shallow boosted ones."""

    kind: str = "tree"
    max_depth: int = 6
    min_leaf: int = 30
    n_trees: int = 40
    step_size: float = 0.1
    max_bins: int = 64
    seed: int = 42

    def __post_init__(self) -> None:
        if self.kind not in ("tree", "gboost"):
            raise ValueError(f"unknown student kind {self.kind!r}")
        if self.max_depth < 1 or self.n_trees < 1:
            raise ValueError("max_depth and n_trees must be >= 1")


#: Undefined values count as this: below every value, so that fitting and scoring send them left at every split, as rules do.
UNDEFINED = -1e300


def assemble(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Feature vector; undefined values (null, NaN) are UNDEFINED in fits and scores alike."""
    filled = {f"_f{i}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(UNDEFINED)) for i, c in enumerate(cols)}
    out = VectorAssembler(inputCols=list(filled), outputCol="features").transform(df.withColumns(filled))
    return out.drop(*filled)


def positive_score(df: DataFrame) -> DataFrame:
    """`score`: probability of class 1."""
    return df.withColumn("score", vector_to_array("probability")[1])


def _balanced(df: DataFrame, y: str, weight: str) -> DataFrame:
    """`_w`: sample weight, positives multiplied by n_neg / max(n_pos, 1)."""
    row = df.agg(F.sum(F.col(y)).alias("p"), F.sum(1 - F.col(y)).alias("n")).first()
    ratio = (row["n"] or 0) / max(row["p"] or 0, 1)
    return df.withColumn("_w", F.col(weight) * F.when(F.col(y) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))


def fit_gbt(df: DataFrame, cols: Sequence[str], y: str, weight: str, cfg: GBTConfig):
    rows = _balanced(df, y, weight) if cfg.balance else df.withColumn("_w", F.col(weight))
    gbt = GBTClassifier(
        labelCol=y, weightCol="_w", maxIter=cfg.max_iter, maxDepth=cfg.max_depth, stepSize=cfg.step_size,
        minInstancesPerNode=cfg.min_leaf, subsamplingRate=cfg.subsample, maxBins=cfg.max_bins, seed=cfg.seed,
    )
    return gbt.fit(assemble(rows, cols))


def oof_scores(
    pool: DataFrame, folds: DataFrame, cols: Sequence[str], y: str, weight: str, cfg: GBTConfig = GBTConfig()
) -> DataFrame:
    """(symbol, bar, fold, score): every row scored by the model of the fold that tests it.

    Folds are fitted one after another; each fit is distributed. Pool and folds are joined once and written.
    """
    data = materialise(
        pool.select("symbol", "bar", *cols, y, weight).join(folds.select("symbol", "bar", "fold", "role"), ["symbol", "bar"])
    )
    ids = [r[0] for r in data.select("fold").distinct().orderBy("fold").collect()]
    parts = []
    for f in ids:
        here = data.filter(F.col("fold") == f)
        train = here.filter("role = 'train'")
        test = here.filter("role = 'test'")
        if train.filter(F.col(y) == 1).limit(1).count() == 0:
            parts.append(test.select("symbol", "bar", "fold", F.lit(0.0).alias("score")))
            continue
        model = fit_gbt(train, cols, y, weight, cfg)
        parts.append(positive_score(model.transform(assemble(test, cols))).select("symbol", "bar", "fold", "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --------------------------------------------------------------------------- scaling


def zscore_by_series(df: DataFrame, cols: Sequence[str], train: Column, by: Sequence[str] = ()) -> DataFrame:
    """Columns scaled per symbol with moments of its train rows; unseen symbols use the pooled moments.

    Moments come from one pass of partial aggregates; the pooled ones are merged from the per-symbol ones.
    """
    by = list(by)
    keys = [*by, "symbol"]
    x = {c: F.when(train, F.col(c)) for c in cols}
    aggs = []
    for c in cols:
        aggs += [F.avg(x[c]).alias(f"_m_{c}"), F.stddev_pop(x[c]).alias(f"_s_{c}"), F.count(x[c]).alias(f"_n_{c}")]
    spread = "bar" in df.columns  # rows of a symbol go to many tasks by their place
    per = materialise(df.groupBy(*keys).agg(*aggs, *([(F.max("bar") + 1).alias("_bars")] if spread else [])))
    pooled = []
    for c in cols:
        n, m, s = F.col(f"_n_{c}"), F.col(f"_m_{c}"), F.col(f"_s_{c}")
        mean = F.try_divide(F.sum(n * m), F.sum(n))
        second = F.try_divide(F.sum(n * (s * s + m * m)), F.sum(n))
        pooled += [mean.alias(f"_gm_{c}"), F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))).alias(f"_gs_{c}")]
    glob = per.groupBy(*by).agg(*pooled) if by else per.agg(*pooled).withColumn("_all", F.lit(1))
    stats = per.join(glob, by) if by else per.withColumn("_all", F.lit(1)).join(glob, "_all")
    stats = stats.select(
        *keys,
        *[F.coalesce(f"_m_{c}", f"_gm_{c}").alias(f"_m_{c}") for c in cols],
        *[F.coalesce(f"_s_{c}", f"_gs_{c}").alias(f"_s_{c}") for c in cols],
        *(["_bars"] if spread else []),
    )
    stats = materialise(stats)
    out = per_symbol_join(df, stats, "_bars", keys=keys, how="inner") if spread else df.join(stats, keys)

    def z(c: str) -> Column:
        sd = F.when(F.col(f"_s_{c}") > 1e-12, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
        return (F.col(c) - F.col(f"_m_{c}")) / sd

    out = out.withColumns({c: z(c) for c in cols})
    return out.drop(*[f"_{t}_{c}" for c in cols for t in ("m", "s")])


def standardise(df: DataFrame, cols: Sequence[str], train: Column) -> DataFrame:
    """Pooled scaling with train moments (undefined values ignored), tiny spread counts as 1, undefined becomes 0."""
    x = {c: F.when(train & ~F.isnan(c), F.col(c)) for c in cols}
    row = df.agg(*[F.avg(x[c]).alias(f"m_{c}") for c in cols], *[F.stddev_pop(x[c]).alias(f"s_{c}") for c in cols]).first()

    def z(c: str) -> Column:
        m, s = row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0
        return F.coalesce((F.nanvl(F.col(c), F.lit(None)) - F.lit(m)) / F.lit(s if s >= 1e-8 else 1.0), F.lit(0.0))

    return df.withColumns({c: z(c) for c in cols})


# --------------------------------------------------------------------------- calibration, students


def fit_isotonic(df: DataFrame, score: str, y: str, weight: str | None = None, max_steps: int | None = None):
    """Monotone map from score to probability; None (identity) with fewer than two classes.

    Rows with equal score are merged first, so a score shared by many rows costs one. The fit is exact at every size:
    the library pools adjacent violators inside range partitions of the score, and on the driver only the blocks that
    are left. A model of more than `max_steps` boundaries, where given, is an error.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    steps = df.groupBy(F.col(score).cast("double").alias("_x")).agg(
        (F.sum(w * F.col(y)) / F.sum(w)).alias("_y"), F.sum(w).alias("_w")
    )
    lo, hi = df.agg(F.min(y), F.max(y)).first()
    if lo == hi:
        return None
    model = IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="calibrated").fit(steps)
    if max_steps is not None and len(model.boundaries) > max_steps:
        raise ValueError(f"{len(model.boundaries)} boundaries are more than max_steps = {max_steps}")
    return model


def apply_isotonic(df: DataFrame, model, score: str) -> DataFrame:
    """`calibrated` in [0, 1]."""
    if model is None:
        out = df.withColumn("calibrated", F.col(score).cast("double"))
    else:
        out = model.transform(df.withColumn("_x", F.col(score).cast("double"))).drop("_x")
    return out.withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated"))))


def fit_student(df: DataFrame, cols: Sequence[str], y: str, weight: str, cfg: StudentConfig = StudentConfig()):
    """Small tree or boosted trees on hard labels with the given weights; no class balancing."""
    rows = assemble(df, cols)
    if cfg.kind == "tree":
        est = DecisionTreeClassifier(
            labelCol=y, weightCol=weight, maxDepth=cfg.max_depth, minInstancesPerNode=cfg.min_leaf, maxBins=cfg.max_bins, seed=cfg.seed
        )
    else:
        est = GBTClassifier(
            labelCol=y, weightCol=weight, maxIter=cfg.n_trees, maxDepth=cfg.max_depth, stepSize=cfg.step_size,
            minInstancesPerNode=cfg.min_leaf, maxBins=cfg.max_bins, seed=cfg.seed,
        )
    return est.fit(rows)


def pseudo_labels(df: DataFrame, proba: str, threshold: float) -> DataFrame:
    """pseudo_y = probability >= threshold, pseudo_weight = |p - 0.5|."""
    p = F.col(proba)
    return df.withColumns({"pseudo_y": (p >= threshold).cast("int"), "pseudo_weight": F.abs(p - 0.5)})


def distill(df: DataFrame, cols: Sequence[str], proba: str, cfg: StudentConfig = StudentConfig(), threshold: float = 0.5):
    """Student fitted to the decisions of a teacher score; a single class is an error."""
    rows = pseudo_labels(df, proba, threshold)
    lo, hi = rows.agg(F.min("pseudo_y"), F.max("pseudo_y")).first()
    if lo == hi:
        raise ValueError("teacher decisions hold a single class")
    return fit_student(rows, cols, "pseudo_y", "pseudo_weight", cfg)


def subsample_negatives(df: DataFrame, y: str, ratio: int = NEG_PER_POS, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """All positives and exactly min(n_neg, ratio * n_pos) negatives per group; all rows of a group without positives.

    Negatives are chosen by the order of a hash of (symbol, bar, seed): the same rows whatever the partitioning.
    """
    keys = list(by)
    df = materialise(df)  # read for the sums, the counts by prefix, the rows and the last prefix; what makes it runs once
    want = F.lit(ratio) * F.col("_np")
    pos = df.groupBy(*keys).agg(F.sum(y).cast("long").alias("_np"), (F.max("bar") + 1).alias("_bars"))
    draw = F.md5(F.concat_ws("|", "symbol", F.col("bar").cast("string"), F.lit(str(seed))))
    neg = df.filter(F.col(y) == 0).withColumn("_h", draw).withColumn("_p", F.substring("_h", 1, PREFIX_DIGITS))
    # counts by prefix of the hash show up to which one all are taken; 16 ** PREFIX_DIGITS rows a group at most
    counts = neg.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_below", below)
    if keys:
        joined = counts.join(pos, keys)
    else:
        total = pos.first()
        joined = counts.withColumns({c: F.lit(total[c]).cast("long") for c in ("_np", "_bars")})
    reached = F.when((F.col("_np") > 0) & (F.col("_below") + F.col("_n") > want) & (F.col("_below") <= want), F.struct("_p", (want - F.col("_below")).alias("left")))
    cut = materialise(joined.groupBy(*keys).agg(F.min(reached).alias("_cut"), F.max("_bars").alias("_bars")))
    if keys:
        placed = per_symbol_join(neg, cut, "_bars", keys=keys) if "symbol" in keys else neg.join(cut.drop("_bars"), keys)
    else:
        row = cut.select("_cut.*").first()
        at = F.struct(F.lit(row["_p"]).alias("_p"), F.lit(row["left"]).cast("long").alias("left")) if row and row["_p"] is not None else F.lit(None).cast("struct<_p: string, left: bigint>")
        placed = neg.withColumn("_cut", at)
    sure = placed.where("_cut is null or _p < _cut._p")
    # only the prefix that holds the last ones is ranked
    edge = placed.where("_p = _cut._p").withColumn("_left", F.col("_cut.left"))
    edge = with_group_rank(edge, keys, [F.col("_h"), F.col("symbol"), F.col("bar")], "_r").where("_r < _left")
    return df.filter(F.col(y) == 1).unionByName(sure.select(*df.columns)).unionByName(edge.select(*df.columns))


def tune_boost(
    train: DataFrame, test: DataFrame, cols: Sequence[str], y: str, label_score: str, cfg: StudentConfig,
    grid: Sequence[float] = BOOST_GRID,
) -> DataFrame:
    """(boost, ap) per candidate positive boost, best first in `rank` 1; the earlier candidate wins ties."""
    spark = train.sparkSession
    rows = []
    for i, b in enumerate(grid):
        w = F.when(F.col(y) == 1, F.lit(float(b)) * (1.0 + F.col(label_score))).otherwise(F.lit(1.0))
        model = fit_student(train.withColumn("_bw", w), cols, y, "_bw", cfg)
        ap_w = F.when(F.col(y) == 1, 1.0 + F.col(label_score)).otherwise(F.lit(1.0))
        scored = positive_score(model.transform(assemble(test.withColumn("_aw", ap_w), cols)))
        rows.append((i, float(b), float(average_precision(scored, "score", y, "_aw").first()[0])))
    ordered = sorted(rows, key=lambda r: (-r[2], r[0]))
    return spark.createDataFrame([(k + 1, b, ap) for k, (_, b, ap) in enumerate(ordered)], "rank int, boost double, ap double")


def select_variant(variants: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Winner per group from (name, size_order, f1, ap, ref_ap).

    F1 at least half of the best and above 0, then AP at least 70 % of the reference, then the smallest model within
    2 % of the best AP. A filter that leaves nothing is skipped. One small table, grouped on `by`.
    """
    keys = list(by) or ["_all"]
    v = variants if by else variants.withColumn("_all", F.lit(1))
    listed = v.groupBy(*keys).agg(F.collect_list(F.struct("size_order", "name", "f1", "ap", "ref_ap")).alias("_v"))

    def narrowed(col: Column, cond) -> Column:
        kept = F.filter(col, cond)
        return F.when(F.size(kept) > 0, kept).otherwise(col)

    best_f1 = F.array_max(F.transform("_v", lambda x: x["f1"]))
    listed = listed.withColumn("_b", best_f1)
    listed = listed.withColumn("_v", narrowed(F.col("_v"), lambda x: (x["f1"] >= F.lit(DEPLOY_F1_FRAC) * F.col("_b")) & (x["f1"] > 0)))
    listed = listed.withColumn("_v", narrowed(F.col("_v"), lambda x: x["ap"] >= F.lit(RECOVERY_FLOOR) * x["ref_ap"]))
    listed = listed.withColumn("_a", F.array_max(F.transform("_v", lambda x: x["ap"])))
    win = F.array_min(F.filter("_v", lambda x: x["ap"] >= F.col("_a") * F.lit(NEAR_TIE)))
    out = listed.withColumn("_w", win).select(*keys, F.col("_w.name").alias("name"), F.col("_w.f1").alias("f1"), F.col("_w.ap").alias("ap"))
    return out if by else out.drop("_all")


def importance_table(spark, model, names: Sequence[str]) -> DataFrame:
    """(feature, gain, share, rank) from a fitted model, largest gain first, ties in column order."""
    vals = [float(x) for x in model.featureImportances.toArray()]
    total = sum(vals) or 1.0
    order = sorted(range(len(names)), key=lambda i: (-vals[i], i))
    rows = [(names[i], vals[i], 100.0 * vals[i] / total, r + 1) for r, i in enumerate(order)]
    return spark.createDataFrame(rows, "feature string, gain double, share double, rank int")


def fit_importance(pool: DataFrame, cols: Sequence[str], y: str, weight: str, cfg: GBTConfig = GBTConfig()) -> DataFrame:
    """Gain importances of one fit on all rows."""
    return importance_table(pool.sparkSession, fit_gbt(pool, cols, y, weight, cfg), cols)
