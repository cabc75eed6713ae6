"""Chunked results equal unchunked ones, and both equal plain loops."""

import numpy as np
import pandas as pd
import pytest
from data import pooled
from pyspark.sql import functions as F

from tidemark import layout as Y
from tidemark.operators import detector as D
from tidemark.operators import features as X
from tidemark.operators import labels as L
from tidemark.operators.bank import FeatureConfig, bank_specs, build_features, feature_names, register_block

ONE = {"max_bars": 10_000}
CHUNKED = {"chunk_rows": 97}


@pytest.fixture(scope="module")
def bars(spark):
    pdf = pooled()
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(7).cache()
    df.count()
    return df


def frame(df, *cols):
    return df.toPandas().sort_values(["symbol", "time"]).reset_index(drop=True)[["symbol", "time", *cols]]


def assert_same(a, b, cols, tol=1e-9):
    for c in cols:
        x, y = a[c], b[c]
        if x.dtype == bool or x.dtype == object:
            assert (x.astype(str) == y.astype(str)).all(), c
        else:
            np.testing.assert_allclose(x.astype(float), y.astype(float), rtol=tol, atol=tol, err_msg=c)


def test_positions(spark, bars):
    got = frame(Y.index_bars(bars, slice_rows=50), "bar", "n_bars")
    want = pooled().sort_values(["symbol", "time"]).reset_index(drop=True)
    assert (got["bar"] == want.groupby("symbol").cumcount()).all()
    assert (got["n_bars"] == want.groupby("symbol")["time"].transform("size")).all()


def test_bank_chunked_equals_whole(bars):
    cfg = FeatureConfig(include_overextension=True)
    names = feature_names(cfg)
    assert len(names) == 45 and len(feature_names()) == 36
    whole = frame(build_features(bars, cfg, **ONE), *names)
    parts = frame(build_features(bars, cfg, **CHUNKED), *names)
    assert_same(whole, parts, names)


def test_labels_chunked_equals_whole(bars):
    cols = ["top_score", "bottom_score", "top_tier", "bottom_tier"]
    for cfg in (L.STRUCTURAL, L.LOOSE):
        assert_same(frame(L.label_turns(bars, cfg, **ONE), *cols), frame(L.label_turns(bars, cfg, **CHUNKED), *cols), cols)


def test_pivots_and_drift_chunked(bars):
    def run(kw):
        df = Y.compute(bars, [X.pivots(5), D.agreement_spec(D.DEFAULT_HIGH)], **kw)
        df = D.duration_at_extreme(df, F.col("agree_high") > 0.5, **kw)
        return frame(D.with_drift(df, 3, **kw), "pivot_high", "pivot_low", "duration", "pivot_drift")

    assert_same(run(ONE), run({"chunk_rows": 60}), ["pivot_high", "pivot_low", "duration", "pivot_drift"])


def test_detector_chunked(bars):
    from tidemark.plans.q_detector import EASY_HIGH, EASY_LOW

    for p in (EASY_HIGH, EASY_LOW):
        a = frame(D.detect_side(bars, p, **ONE), "candidate", "fired", "signal", "bars_since_fire")
        b = frame(D.detect_side(bars, p, chunk_rows=128), "candidate", "fired", "signal", "bars_since_fire")
        assert_same(a, b, ["candidate", "fired", "signal", "bars_since_fire"])
        assert a["fired"].any()


@pytest.mark.parametrize("n", [1, 2, 3, 14, 60])
def test_rma_loop(bars, n):
    got = frame(Y.compute(bars, [X.rma("volume", n, "r")], **CHUNKED), "r")
    want = []
    for _, g in pooled().sort_values(["symbol", "time"]).groupby("symbol"):
        x, prev = g["volume"].to_numpy(), None
        for i, v in enumerate(x):
            prev = None if i < n - 1 else (x[:n].mean() if i == n - 1 else (prev * (n - 1) + v) / n)
            want.append(np.nan if prev is None else prev)
    np.testing.assert_allclose(got["r"], want, rtol=1e-10)


def test_gjr_loop(bars):
    got = frame(Y.compute(bars, [X.gjr_asym()], chunk_rows=64), "gjr_asym")
    want = []
    for _, grp in pooled().sort_values(["symbol", "time"]).groupby("symbol"):
        c = grp["close"].to_numpy()
        r = np.log(c / np.concatenate([c[:1], c[:-1]]))
        r2, g, s = r * r, None, None
        for i in range(len(c)):
            warm = i >= 251
            lr = max(r2[i - 251 : i + 1].mean() if warm else r2[i], 1e-12)
            om = max(lr * (1 - 0.03 - 0.9 - 0.04), 1e-12)
            pr2 = lr if i == 0 else r2[i - 1]
            lev = 1.0 if i and r[i - 1] < 0 else 0.0
            g = max(om + (0.03 + 0.08 * lev) * pr2 + 0.9 * (lr if g is None else g), 1e-12)
            s = max(om + (0.03 + 0.04) * pr2 + 0.9 * (lr if s is None else s), 1e-12)
            want.append(np.clip((g / s - 1) / 0.1, -1, 1) if warm else np.nan)
    np.testing.assert_allclose(got["gjr_asym"], want, rtol=1e-9, atol=1e-9)


def test_pir_pads_with_one(bars):
    got = frame(Y.compute(bars, [X.pir_for_scale(16, 20)], chunk_rows=50), "pir_s16")
    want = []
    for _, g in pooled().sort_values(["symbol", "time"]).groupby("symbol"):
        c = g["close"].to_numpy()
        ratio = np.array([c[i] / c[i - 15 : i + 1].mean() if i >= 15 else 1.0 for i in range(len(c))])
        for i in range(len(c)):
            h = np.concatenate([np.ones(max(0, 19 - i)), ratio[max(0, i - 19) : i + 1]])
            want.append((ratio[i] - h.min()) / (h.max() - h.min()) if h.max() > h.min() else 0.5)
    np.testing.assert_allclose(got["pir_s16"], want, atol=1e-9)


def test_running_carry_and_asof(spark, bars):
    idx = Y.index_bars(bars)
    got = frame(
        Y.running_carry(idx, sums={"s": F.col("volume")}, maxs={"m": F.col("close")}, chunk_rows=40), "s", "m"
    )
    p = pooled().sort_values(["symbol", "time"]).reset_index(drop=True)
    np.testing.assert_allclose(got["s"], p.groupby("symbol")["volume"].cumsum())
    np.testing.assert_allclose(got["m"], p.groupby("symbol")["close"].cummax())
    right = bars.filter("volume > 40").select("symbol", "time", F.col("time").alias("at"))
    out = Y.asof_backward(bars.select("symbol", "time"), right, ["at"], chunk_rows=30).toPandas()
    big = p[p["volume"] > 40]
    for r in out.sample(80, random_state=0).itertuples():
        prior = big[(big["symbol"] == r.symbol) & (big["time"] < r.time)]["time"]
        assert (pd.isna(r.at) and prior.empty) or r.at == prior.max()


def test_global_rank_and_running(spark):
    rng = np.random.default_rng(0)
    # a third of the rows share one key
    k = np.where(rng.random(3000) < 0.34, 5, rng.integers(0, 40, 3000))
    pdf = pd.DataFrame({"g": k % 3, "k": k, "i": np.arange(3000), "x": rng.random(3000)})
    df = spark.createDataFrame(pdf).repartition(5)
    got = Y.global_rank(df, [F.col("k"), F.col("i")], partitions=7).toPandas().sort_values("rank")
    assert got["i"].tolist() == pdf.sort_values(["k", "i"])["i"].tolist()
    assert got["rank"].tolist() == list(range(3000))
    run = Y.global_running(df, ["g"], [F.col("k"), F.col("i")], {"c": F.col("x")}, partitions=7).toPandas().sort_values("i")
    want = pdf.sort_values(["k", "i"]).groupby("g")["x"].cumsum().sort_index()
    np.testing.assert_allclose(run["c"], want)


def test_one_exchange_for_bank_and_labels(spark):
    src = spark.createDataFrame(pooled())
    plan = build_features(src, FeatureConfig(), extra=L.label_specs(), **ONE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_registries():
    with pytest.raises(ValueError):
        register_block("pir")(lambda c: {})
    with pytest.raises(KeyError, match="known"):
        bank_specs(FeatureConfig(blocks=("nope",)))
    with pytest.raises(ValueError):
        bank_specs(FeatureConfig(blocks=("pir", "pir")))
    with pytest.raises(KeyError):
        X.vola_raw_stages(Y.Frames(("symbol",)), "nope", 3)
    with pytest.raises(ValueError):
        L.OracleConfig(scale_nest=(5, 5))
    assert L.OracleConfig(scale_nest=(7,)).weights() == [1.0]
    assert [X.slope_delta(s) for s in (4, 10, 20, 50)] == [2, 3, 5, 13]
