"""Matchings of growing sets against matching each prefix anew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.events import match_counts
from tidemark.operators.sweep import gaining, match_gains


def largest(pred, true, tol):
    i = j = n = 0
    pred, true = sorted(pred), sorted(true)
    while i < len(pred) and j < len(true):
        gap = pred[i] - true[j]
        if abs(gap) <= tol:
            n += 1
        i += gap <= tol
        j += gap >= -tol
    return n


@pytest.mark.parametrize("seed", range(40))
def test_every_prefix(seed):
    rng = np.random.default_rng(seed)
    span, tol = int(rng.integers(5, 120)), int(rng.integers(0, 9))
    true = np.sort(rng.choice(span, int(rng.integers(0, span)), replace=False))
    pred = rng.choice(span, int(rng.integers(0, span)), replace=seed % 2 == 0)
    sums = np.cumsum(gaining(true, pred, tol))
    assert sums.tolist() == [largest(pred[: i + 1], true, tol) for i in range(len(pred))]


def test_long_closed_range():
    """Truths on every bar, all taken from one side: the work stays near linear."""
    n = 20_000
    on = gaining(np.arange(n), np.concatenate([np.arange(n), np.arange(n)]), 5)
    assert on[:n].all() and not on[n:].any()


@pytest.mark.parametrize("chain", [1, 2, 50])
def test_cut_series(spark, chain):
    """Short segments, joined ones and those matched step by step give the steps of the whole series."""
    rng = np.random.default_rng(4)
    rows = []
    for g in (0, 1):
        for s, share in (("a", 0.05), ("b", 0.3), ("c", 0.9), ("d", 0.0)):
            for bar in range(150):
                k = int(rng.integers(0, 6))
                rows.append((g, s, bar, bool(rng.random() < share), k if k < 5 else None, 5))
    df = spark.createDataFrame(rows, "g int, symbol string, bar long, _y boolean, _k int, _steps int")
    got = {(r["g"], r["_k"]): r["gain"] for r in match_gains(df, 2, ["g"], segment_bars=8, chain=chain).collect()}
    ev = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        "g", "i", "symbol", "bar", F.coalesce(F.col("_k") <= F.col("i"), F.lit(False)).alias("is_pred"), F.col("_y").alias("is_true")
    )
    want = match_counts(ev, 2, ["g", "i"]).groupBy("g", "i").agg(F.sum("tp").alias("tp")).collect()
    for r in want:
        assert sum(got.get((r["g"], k), 0) for k in range(r["i"] + 1)) == r["tp"]


def test_no_rows(spark):
    df = spark.createDataFrame([], "g int, symbol string, bar long, _y boolean, _k int, _steps int")
    assert match_gains(df, 3, ["g"]).count() == 0
