"""Registry of runnable queries and the bar fixtures they share.

A query is a Spark function (spark, sf_dir) -> DataFrame and, where SQL can say the same, a DuckDB twin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.layout import DAY
from tidemark.sources.bars import epoch_seconds, ticks_to_bars

HOUR = 3_600
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `<inventory id>_<operator>`."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is already registered")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span_bars(df: DataFrame, ts: str, seconds: int) -> int:
    """Upper bound on bars per series: the time span of the ticks in buckets."""
    t = epoch_seconds(df, ts)
    lo, hi = df.select(t.alias("t")).agg(F.min("t"), F.max("t")).first()
    return 0 if lo is None else int(hi // seconds - lo // seconds + 1)


def _lineitem_bars(spark: SparkSession, sf_dir: str, key) -> tuple[DataFrame, dict]:
    li = table(spark, sf_dir, "lineitem")
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    bars = ticks_to_bars(
        li, key, epoch_seconds(li, "l_shipdate"), F.col("l_extendedprice"), F.col("l_quantity"), DAY, order
    )
    return bars, {"bar_seconds": DAY, "max_bars": span_bars(li, "l_shipdate", DAY)}


def bars_supp(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """Daily bars per supplier and the layout keywords that fit them."""
    return _lineitem_bars(spark, sf_dir, F.col("l_suppkey"))


def bars_flag(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """Daily bars per return flag and line status: few, dense series."""
    return _lineitem_bars(spark, sf_dir, F.concat("l_returnflag", "l_linestatus"))


def bars_event(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """Hourly bars per event type."""
    ev = table(spark, sf_dir, "events")
    bars = ticks_to_bars(
        ev, F.col("event_type"), epoch_seconds(ev, "ts"), F.col("value"), F.lit(1.0), HOUR, [F.col("ts")]
    )
    return bars, {"bar_seconds": HOUR, "max_bars": span_bars(ev, "ts", HOUR)}


# --------------------------------------------------------------------------- SQL twins of the fixtures


def _bars_sql(src: str, key: str, ts: str, price: str, qty: str, width: int, order: str) -> str:
    """Bars plus position: the CTEs `raw` and `bars` (symbol, time, ohlcv, bar, n_bars)."""
    return f"""raw AS MATERIALIZED (
  SELECT CAST({key} AS VARCHAR) AS symbol,
         CAST(floor(epoch({ts}) / {width}) * {width} AS BIGINT) AS time,
         arg_min({price}, {order}) AS open, max({price}) AS high, min({price}) AS low,
         arg_max({price}, {order}) AS close, sum(CAST({qty} AS DOUBLE)) AS volume
  FROM {src} GROUP BY 1, 2),
bars AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS bar,
         count(*) OVER (PARTITION BY symbol) AS n_bars FROM raw)"""


_LI_ORDER = "ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
SUPP = _bars_sql("lineitem", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", DAY, _LI_ORDER)
FLAG = _bars_sql("lineitem", "l_returnflag || l_linestatus", "l_shipdate", "l_extendedprice", "l_quantity", DAY, _LI_ORDER)
EVENT = _bars_sql("events", "event_type", "ts", "value", "1.0", HOUR, "ts")


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round doubles after all comparisons, so both engines print the same value (no negative zero)."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols})


def r6(expr: str, digits: int = 6) -> str:
    """SQL twin of `rounded`."""
    return f"round({expr}, {digits}) + CAST(0 AS DOUBLE)"
