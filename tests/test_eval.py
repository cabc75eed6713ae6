"""Matching, ranking, thresholds, deflation and folds against small exact cases and brute force."""

import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from data import pooled
from pyspark.sql import functions as F

from tidemark.functions import scalars as C
from tidemark.layout import index_bars
from tidemark.operators import events as EV
from tidemark.operators import metrics as M
from tidemark.operators import overfit as O
from tidemark.operators import ranking as R
from tidemark.operators import splits as V

CASES = [
    ([10, 25, 40, 77], [10, 25, 40, 77], 2, 4, 0, 0),
    ([12, 18, 33], [10, 20, 30], 3, 3, 0, 0),
    ([10, 55], [10, 50], 2, 1, 1, 1),
    ([104], [100], 3, 0, 1, 1),
    ([9, 11], [10], 2, 1, 1, 0),
    ([10], [8, 12], 3, 1, 0, 1),
    ([21, 11], [10, 20], 2, 2, 0, 0),
    ([10, 20, 100], [10, 20], 2, 2, 1, 0),
    ([], [1, 2, 3], 2, 0, 0, 3),
    ([1, 2, 3], [], 2, 0, 3, 0),
]


def event_frame(spark, cases):
    rows = []
    for name, p, t in cases:
        for b in sorted(set(p) | set(t)):
            rows.append((name, b, b in p, b in t))
    return spark.createDataFrame(rows, "symbol string, bar long, is_pred boolean, is_true boolean")


@pytest.mark.parametrize("seg", [4, 8, 4096])
def test_match_table(spark, seg):
    for tol in (2, 3):
        sub = [(str(i), c[0], c[1]) for i, c in enumerate(CASES) if c[2] == tol]
        got = {r["symbol"]: r for r in EV.match_counts(event_frame(spark, sub), tol, segment_bars=seg).collect()}
        for i, c in enumerate(CASES):
            if c[2] == tol:
                assert (got[str(i)]["tp"], got[str(i)]["fp"], got[str(i)]["fn"]) == c[3:], c


def best_matching(p, t, tol):
    """(size, least distance) by exhaustive recursion."""
    if not p or not t:
        return 0, 0
    best = best_matching(p[1:], t, tol)
    for j, b in enumerate(t):
        if abs(p[0] - b) <= tol:
            n, d = best_matching(p[1:], t[:j] + t[j + 1 :], tol)
            cand = (n + 1, d + abs(p[0] - b))
            if cand[0] > best[0] or (cand[0] == best[0] and cand[1] < best[1]):
                best = cand
    return best


def test_matching_against_brute_force(spark):
    rng = np.random.default_rng(3)
    cases = []
    for i in range(120):
        p = sorted(rng.choice(22, rng.integers(0, 8), replace=False).tolist())
        t = sorted(rng.choice(22, rng.integers(0, 8), replace=False).tolist())
        if p or t:
            cases.append((f"s{i}", p, t))
    for tol, seg, span in ((0, 5, 2), (2, 4, 2), (3, 4096, 1024), (4, 6, 1)):
        ev = event_frame(spark, cases)
        counts = {r["symbol"]: r["tp"] for r in EV.match_counts(ev, tol, segment_bars=seg).collect()}
        pairs = EV.match_pairs(ev, tol, segment_bars=seg, span=span).toPandas()
        for name, p, t in cases:
            n, d = best_matching(p, t, tol)
            own = pairs[pairs["symbol"] == name]
            assert counts[name] == n, (name, tol)
            assert (len(own), own["delta"].sum()) == (n, d), (name, tol, p, t)
            assert own["pred_bar"].is_unique and own["true_bar"].is_unique
            assert set(own["pred_bar"]) <= set(p) and set(own["true_bar"]) <= set(t)


def test_dense_series_is_segment_invariant(spark):
    rng = np.random.default_rng(5)
    p, t = (sorted(rng.choice(4000, 2500, replace=False).tolist()) for _ in range(2))
    ev = event_frame(spark, [("x", p, t)])
    one, many = (EV.match_counts(ev, 3, segment_bars=s).first() for s in (8192, 32))
    assert tuple(one) == tuple(many)
    pairs = EV.match_pairs(ev, 3, segment_bars=64, span=4)
    assert pairs.count() == one["tp"]


def scored(spark, s, y, w=None):
    rows = [(i, float(a), int(b), float((w or [1] * len(s))[i])) for i, (a, b) in enumerate(zip(s, y))]
    return spark.createDataFrame(rows, "pos long, score double, y int, w double")


def test_ranking_cases(spark):
    def ap(s, y, w=None):
        return R.average_precision(scored(spark, s, y, w), "score", "y", "w").first()[0]

    assert ap([0.1, 0.9, 0.2, 0.8, 0.05], [0, 1, 0, 1, 0]) == 1.0
    assert ap([0.1, 0.4, 0.6, 0.9], [1, 0, 0, 0]) == 0.25
    assert ap([0.9, 0.7, 0.5, 0.3], [1, 0, 0, 1]) == 0.75
    assert 0.75 < ap([0.9, 0.7, 0.5, 0.3], [1, 0, 0, 1], [10, 1, 1, 1]) < 1
    assert ap([0.5, 0.5], [0, 0]) == 0.0
    df = scored(spark, [0.5, 0.5, 0.5, 0.1], [0, 1, 0, 1])
    assert R.precision_at_k(df, "score", "y", 2, "pos").first()[0] == 0.5
    assert R.recall_at_k(df, "score", "y", 2, "pos").first()[0] == 0.5
    assert R.lift_at_k(df, "score", "y", 2, "pos").first()[0] == 1.0
    none = scored(spark, [0.5, 0.4], [0, 0])
    assert R.recall_at_k(none, "score", "y", 1, "pos").first()[0] == 0.0
    assert R.lift_at_k(none, "score", "y", 1, "pos").first()[0] == 0.0
    with pytest.raises(Exception, match="0/1"):
        R.average_precision(scored(spark, [0.5], [2]), "score", "y").collect()


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "v": np.where(rng.random(500) < 0.4, 0.5, rng.random(500))})
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    got = R.quantiles(spark.createDataFrame(pdf), ["g"], "v", probs).toPandas()
    for g, sub in pdf.groupby("g"):
        own = got[got["g"] == g].sort_values("prob_index")["value"]
        np.testing.assert_allclose(own, np.quantile(sub["v"], probs), atol=1e-12)


def greedy(p, t, tol):
    i = j = n = 0
    while i < len(p) and j < len(t):
        if abs(p[i] - t[j]) <= tol:
            i, j, n = i + 1, j + 1, n + 1
        elif p[i] < t[j]:
            i += 1
        else:
            j += 1
    return n


def test_tune_threshold_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for fold, n, pos in ((0, 900, 30), (1, 700, 0), (2, 1500, 4)):
        y = np.zeros(n, bool)
        y[rng.choice(n, pos, replace=False)] = True
        s = np.round(rng.random(n) + 0.4 * y, 2)
        rows += [(fold, "a" if i < n // 2 else "b", int(i), float(s[i]), bool(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "fold int, symbol string, bar long, score double, is_true boolean")
    got = {r["fold"]: r for r in M.tune_threshold(df, 3, 20, budget=(512, 6)).collect()}
    pdf = df.toPandas()
    for fold, g in pdf.groupby("fold"):
        if not g["is_true"].any():
            assert (got[fold]["threshold"], got[fold]["f1"]) == (0.5, 0.0)
            continue
        s = g["score"].to_numpy()
        cands = np.unique(np.concatenate([np.quantile(s, np.linspace(0, 1, 20)), [np.nextafter(s.max(), 0)]]))
        best, thr = -1.0, cands[-1]
        for c in cands[::-1]:
            if (s >= c).sum() > max(512, 6 * g["is_true"].sum()):
                break
            tp = fp = fn = 0
            for _, h in g.groupby("symbol"):
                p, t = sorted(h[h["score"] >= c]["bar"]), sorted(h[h["is_true"]]["bar"])
                n = greedy(p, t, 3)
                tp, fp, fn = tp + n, fp + len(p) - n, fn + len(t) - n
            f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
            if f1 > best + 1e-15:
                best, thr = f1, c
        assert got[fold]["f1"] == pytest.approx(max(best, 0.0))
        assert got[fold]["threshold"] == pytest.approx(thr, abs=1e-12)


def test_normal_distribution(spark):
    zs = [-9.0, -7.5, -4.0, -1.0, -0.3, 0.0, 0.7, 2.0, 6.0, 8.0]
    ps = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.99, 1 - 1e-6]
    nd = NormalDist()
    z = spark.createDataFrame([(v,) for v in zs], "z double").select(C.norm_cdf(F.col("z"))).collect()
    np.testing.assert_allclose([r[0] for r in z], [nd.cdf(v) for v in zs], atol=1e-13)
    p = spark.createDataFrame([(v,) for v in ps], "p double").select(C.norm_ppf(F.col("p"))).collect()
    np.testing.assert_allclose([r[0] for r in p], [nd.inv_cdf(v) for v in ps], rtol=2e-9, atol=2e-9)
    row = spark.range(1).select(
        C.expected_max_sharpe(F.lit(1), F.lit(1.0)), C.expected_max_sharpe(F.lit(100), F.lit(1.0)),
        C.deflated_metric(F.lit(2.0), F.lit(50), F.lit(0.5)),
        C.probabilistic_sharpe_ratio(F.lit(0.5), F.lit(0.5), F.lit(30), F.lit(0.0), F.lit(3.0)),
    ).first()
    g = C.EULER_GAMMA
    want = (1 - g) * nd.inv_cdf(0.99) + g * nd.inv_cdf(1 - 1 / (100 * math.e))
    assert row[0] == 0.0 and row[1] == pytest.approx(want, rel=1e-8) and row[2] < 2.0 and row[3] == pytest.approx(0.5)


def pbo_loop(m, s):
    n, k = m.shape
    size = n // s
    out = []
    for c in itertools.combinations(range(s), s // 2):
        rows = np.concatenate([np.arange(b * size, (b + 1) * size) for b in c])
        rest = np.setdiff1d(np.arange(size * s), rows)
        perf = [x.mean(0) / x.std(0, ddof=1) for x in (m[rows], m[rest])]
        best = int(np.argmax(perf[0]))
        rank = (perf[1] < perf[1][best]).sum() + ((perf[1] == perf[1][best]).sum() + 1) / 2
        w = rank / (k + 1)
        out.append(math.log(w / (1 - w)) <= 0)
    return float(np.mean(out))


@pytest.mark.parametrize("shape,lift", [((123, 8), 0.0), ((60, 10), 5.0)])
def test_pbo(spark, shape, lift):
    m = np.random.default_rng(7).normal(size=shape)
    m[:, 0] += lift
    rows = [(t, c, float(m[t, c])) for t in range(shape[0]) for c in range(shape[1])]
    df = spark.createDataFrame(rows, "t long, config int, value double")
    got = O.pbo_cscv(df, 6).first()
    assert got["pbo"] == pytest.approx(pbo_loop(m, 6)) and got["n_combos"] == 20
    if lift:
        assert got["pbo"] == 0.0
    with pytest.raises(ValueError):
        O.pbo_cscv(df, 5)


def test_folds_loop(spark):
    pdf = pooled((200, 120, 77))
    df = index_bars(spark.createDataFrame(pdf))
    got = V.purged_folds(df, 7, 4, 4, keep_purged=True, chunk_rows=16).toPandas()
    p = pdf.sort_values(["time", "symbol"]).reset_index(drop=True)
    p["bar"] = p.groupby("symbol").cumcount()
    blocks = np.array_split(np.arange(len(p)), 4)
    for f, b in enumerate(blocks):
        test = np.zeros(len(p), bool)
        test[b] = True
        ban = test.copy()
        for _, g in p.groupby("symbol"):
            mine = g["bar"][test[g.index]]
            if len(mine):
                ban[g.index[(g["bar"] >= mine.min() - 7) & (g["bar"] <= mine.max() + 4)]] = True
        want = np.where(test, "test", np.where(ban, "purged", "train"))
        own = got[got["fold"] == f].merge(p.assign(want=want), on=["symbol", "bar"])
        assert len(own) == len(p) and (own["role"] == own["want"]).all()
    V.assert_no_leak(V.purged_folds(df, 7, 4, 4), 7, 4)
    with pytest.raises(V.LeakageError):
        V.assert_no_leak(V.purged_folds(df, 0, 0, 4), 7, 4)
    for bad in ((-1, 0, 4), (0, -1, 4), (0, 0, 1), (0, 0, 10**6)):
        with pytest.raises(ValueError):
            V.purged_folds(df, *bad)
