"""Universe choice and the pooled corpus of features and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.layout import global_rank
from tidemark.operators.bank import FeatureConfig, build_features, feature_names
from tidemark.operators.labels import OracleConfig, STRUCTURAL, label_specs, with_tiers


def drop_warmup(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows where every feature is defined."""
    return df.na.drop("any", subset=list(features))


def select_universe(
    df: DataFrame, tickers: Sequence[str] | None = None, max_assets: int | None = None, anchors: Sequence[str] = ()
) -> DataFrame:
    """(symbol, priority): a whitelist in request order, or anchors first and then by name, cut at `max_assets`."""
    have = df.select("symbol").distinct()
    order = list(tickers if tickers is not None else anchors)
    if tickers is not None:
        have = have.filter(F.col("symbol").isin(order))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in order]), F.col("symbol")), F.lit(0)) if order else F.lit(0)
    prio = F.when(rank > 0, rank).otherwise(F.lit(len(order) + 1)).cast("int")
    out = have.withColumn("priority", prio)
    if max_assets is not None and tickers is None:
        out = out.orderBy("priority", "symbol").limit(max_assets)
    return out


def restrict(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows of the chosen symbols."""
    return df.join(universe.select("symbol"), "symbol", "left_semi")


def with_group_id(df: DataFrame) -> DataFrame:
    """Dense id per symbol in name order; the dimension is ranked on its own, rows are not sorted."""
    ids = global_rank(df.select("symbol").distinct(), [F.col("symbol")], "group_id")
    return df.join(ids, "symbol")


def build_pool(
    bars: DataFrame,
    feature_cfg: FeatureConfig = FeatureConfig(),
    oracle_cfg: OracleConfig = STRUCTURAL,
    group_ids: bool = True,
    **layout,
) -> DataFrame:
    """Features and labels of all series in one pass, warm-up rows dropped, with group id.

    Features look back and labels look ahead over the same window order, so one exchange and sort serve both.
    """
    wide = build_features(bars, feature_cfg, extra=label_specs(oracle_cfg), **layout)
    pool = drop_warmup(with_tiers(wide, oracle_cfg), feature_names(feature_cfg))
    return with_group_id(pool) if group_ids else pool


def pool_issues(bars: DataFrame, pool: DataFrame, requested: Sequence[str] = (), max_assets: int | None = None) -> DataFrame:
    """(symbol, issue): requested but absent, capped away, or left without a defined row."""
    spark = bars.sparkSession
    have = bars.select("symbol").distinct()
    kept = pool.select("symbol").distinct()
    out = have.join(kept, "symbol", "left_anti")
    if max_assets is not None:
        chosen = select_universe(bars, None, max_assets, requested)
        capped = have.join(chosen, "symbol", "left_anti").select("symbol", F.lit("capped").alias("issue"))
        out = out.join(capped, "symbol", "left_anti").select("symbol", F.lit("no defined rows").alias("issue")).unionByName(capped)
    else:
        out = out.select("symbol", F.lit("no defined rows").alias("issue"))
    if requested:
        asked = spark.createDataFrame([(t,) for t in requested], "symbol string")
        out = out.unionByName(asked.join(have, "symbol", "left_anti").select("symbol", F.lit("absent").alias("issue")))
    return out


def counts_per_group(pool: DataFrame) -> DataFrame:
    return pool.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))


def subset(pool: DataFrame, ticker: str) -> DataFrame:
    return pool.filter(F.col("symbol") == ticker)
