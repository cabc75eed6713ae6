"""Looks against Window functions, in batches far smaller than a series, and plans that carry rows once."""

import data
import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.looks import Look, each, half_up, with_looks
from tidemark.layout import DAY, compute
from tidemark.operators import events as EV
from tidemark.operators import features as X
from tidemark.operators import labels as L
from tidemark.operators.bank import FeatureConfig, build_features

LOOKS = {
    "lag": Look("lag", "x", 5), "lead": Look("lead", "x", 7), "lo": Look("min", "x", 13), "hi": Look("max", "x", 9),
    "before": Look("max_before", "x", 6), "after": Look("min_after", "x", 6), "mean": Look("mean", "x", 4), "sum": Look("sum", "y", 11),
}


def test_looks_are_windows(spark):
    """Null values and keys, series that cross batches, a look ahead."""
    rows = [(s, t, None if (t * 7 + len(s or "")) % 5 == 0 else float((t * 37) % 23), float(t % 7)) for s in ("a", "bb", None) for t in range(1, 60 if s else 4)]
    df = spark.createDataFrame(rows, "symbol string, time long, x double, y double").repartition("symbol").sortWithinPartitions("symbol", "time")
    w = Window.partitionBy("symbol").orderBy("time")
    total = F.when(F.count("y").over(w.rowsBetween(-10, 0)) == 11, F.sum("y").over(w.rowsBetween(-10, 0)))
    want = df.select(
        "symbol", "time", F.lag("x", 5).over(w).alias("lag"), F.lead("x", 7).over(w).alias("lead"), F.min("x").over(w.rowsBetween(-12, 0)).alias("lo"),
        F.max("x").over(w.rowsBetween(-8, 0)).alias("hi"), F.max("x").over(w.rowsBetween(-6, -1)).alias("before"),
        F.min("x").over(w.rowsBetween(1, 6)).alias("after"), F.avg("x").over(w.rowsBetween(-3, 0)).alias("mean"), total.alias("sum"),
    )
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        for size in ("3", "1000"):
            spark.conf.set(key, size)
            got = with_looks(df, ["symbol"], LOOKS).select(*want.columns)
            assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
    finally:
        spark.conf.set(key, old)


def test_bank_carries_wide_rows_through_few_passes(spark):
    bars = spark.createDataFrame(data.pooled((40, 30)))
    plan = build_features(bars, FeatureConfig(include_overextension=True), max_bars=2_000, bar_seconds=DAY)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 2
    assert plan.count("MapInArrow") <= 5


def test_segments_are_dealt_out(spark):
    """Rows of few bytes and much work don't end up in one task."""
    rows = [(f"s{i}", b, b % 3 == 0, b % 4 == 0) for i in range(64) for b in range(40) if b % 3 == 0 or b % 4 == 0]
    events = spark.createDataFrame(rows, "symbol string, bar long, is_pred boolean, is_true boolean")
    assert EV.match_pairs(events, 3).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_agreement_takes_one_pass(spark):
    """Positions of all scales come from one pass, cut anywhere; undefined and non-positive averages count as ratio 1."""
    rows = [(s, t * DAY, None if t % 17 == 0 and s == "a" else float((t * 37) % 23 - 4)) for s, n in (("a", 90), ("b", 70), (None, 9)) for t in range(1, n)]
    bars = spark.createDataFrame(rows, "symbol string, time long, close double")
    spec = X.agreement(3, 40, 9, 0.7, counts=True)
    got = compute(bars, [spec, X.pir_for_scale(7, 20)], max_bars=100)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = []
    for s in ("a", "b", None):
        x = pd.Series([r[2] for r in rows if r[0] == s], dtype=float)
        pos = {}
        for n in (*range(3, 41, 9), 7):
            avg = x.rolling(n).mean().round(9)
            ratio = pd.concat([pd.Series([1.0] * 50), (x / avg).where(avg > 0, 1.0)], ignore_index=True)
            lo, hi = ratio.rolling(max(n, 20)).min(), ratio.rolling(max(n, 20)).max()
            pos[n] = ((ratio - lo) / (hi - lo)).where(hi != lo, 0.5)[50:].round(6).tolist()
        t = [r[1] for r in rows if r[0] == s]
        for i in range(len(x)):
            scales = [pos[n][i] for n in range(3, 41, 9)]
            want.append((s, t[i], sum(p > 0.7 for p in scales), sum(p < 1.0 - 0.7 for p in scales), pos[7][i]))
    cols = ["symbol", "time", "agree_n_high", "agree_n_low", F.round("pir_s7", 6)]
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(want, key=repr)
    cut = compute(bars, [spec, X.pir_for_scale(7, 20)], chunk_rows=16)
    assert sorted(map(tuple, cut.select(*cols).collect())) == sorted(w for w in want if w[0])


def test_bank_is_one_pass(spark):
    """All looks of the bank and of the labels lie in one pass, which hands out no halo copies and no temporaries."""
    bars = spark.createDataFrame(data.pooled((40, 30)))
    wide = build_features(bars, FeatureConfig(include_overextension=True), extra=L.label_specs(L.LOOSE), max_bars=2_000, bar_seconds=DAY)
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    laid = bars.select("symbol", "time", "close", F.lit(0).alias("chunk"), (F.col("time") % 2 == 0).alias("_core"), F.lit(1).alias("bar")).repartition(1).sortWithinPartitions("symbol", "time")
    core = with_looks(laid, ["symbol"], {"a": Look("lag", "close", 1), "b": each(lambda x: x + 1, "a")}, ["b"], "_core")
    assert core.columns == [*laid.columns, "b"] and core.count() == laid.filter("_core").count()


def test_chained_looks_reach_through_batches(spark):
    """A look of a look of a look reaches as far back and ahead as all of them together, in batches of three rows."""
    rows = [(s, t, float((t * 37) % 23)) for s in ("a", "b") for t in range(1, 50)]
    df = spark.createDataFrame(rows, "symbol string, time long, x double").repartition("symbol").sortWithinPartitions("symbol", "time")
    looks = {"m": Look("max", "x", 5), "d": each(lambda x, m: x - m, "x", "m"), "l": Look("lag", "d", 4), "f": Look("lead", "l", 6)}
    x = {s: pd.Series([r[2] for r in rows if r[0] == s]) for s in ("a", "b")}
    want = [(s, t, None if np.isnan(v) else v) for s in x for t, v in enumerate((x[s] - x[s].rolling(5, min_periods=1).max()).shift(4).shift(-6), 1)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "3")
        got = with_looks(df, ["symbol"], looks, ["f"])
        assert sorted(map(tuple, got.select("symbol", "time", "f").collect())) == sorted(want)
    finally:
        spark.conf.set(key, old)


def test_rounding_is_that_of_spark(spark):
    x = [0.0078125, -0.0078125, 0.0000005, -0.0000005, 2.5e-7, 1.0000005, 123456.7890125, -0.0000004, 1e15 + 0.3, 3.3e20, 0.1 + 0.2, 1e-300, 5.0000015, float("inf")]
    want = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(F.round("v", 6) + F.lit(0.0)).collect()]
    assert half_up(np.array(x), 6).tolist() == want


def test_bars_are_counted_in_the_pass(spark):
    """Positions and lengths of series that cross batches, with a null key; no Window is left in the plan."""
    rows = [(s, t * DAY, float(t), 1.0) for s, n in (("a", 40), ("b", 1), (None, 7)) for t in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, time long, close double, volume double")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        for size in ("3", "1000"):
            spark.conf.set(key, size)
            got = compute(bars, [X.price_return(2)], max_bars=50)
            assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
            want = [(s, t * DAY, t, n, None if t < 2 or t == 2 else 2 / (t - 2)) for s, n in (("a", 40), ("b", 1), (None, 7)) for t in range(n)]
            assert sorted(map(tuple, got.select("symbol", "time", "bar", "n_bars", "price_return_L2").collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.set(key, old)
