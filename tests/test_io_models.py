"""Readers, resampling, pool, rules, models, streaming state."""

import numpy as np
import pandas as pd
import pytest
from data import pooled, walk
from pyspark.sql import functions as F

from tidemark.layout import compute
from tidemark.operators import features as X
from tidemark.operators import labels as L
from tidemark.operators import models as M
from tidemark.operators import pool as P
from tidemark.operators import rules as RU
from tidemark.operators.bank import FeatureConfig
from tidemark.plans.q_models import ENSEMBLE, TREE
from tidemark.sources import bars as S
from tidemark.streaming import stream as T

ONE = {"max_bars": 10_000}


def test_csv_reading(spark, tmp_path):
    base = walk(30).drop(columns="symbol").rename(columns={"volume": "Volume"})
    for name in ("SP_SPX, 1D_a20e0.csv", "COMEX_DL_GC1!, 60_18203.csv", "BATS_BRK.B, 1D_0cd15.csv", "SP_SPX, 1D_ffff0.csv", "not_a_valid_name.csv"):
        base.to_csv(tmp_path / name, index=False)
    late = base.iloc[[3]].assign(close=999.0)
    neg = base.iloc[[0]].assign(time=-3121407238)
    pd.concat([neg, base, late]).to_csv(tmp_path / "SP_SPX, 1D_a20e0.csv", index=False)
    df = S.with_provenance(S.read_bars(spark, str(tmp_path)))
    got = {(r["exchange"], r["ticker"], r["tf"]) for r in df.select("exchange", "ticker", "tf").distinct().collect()}
    assert {("SP", "SPX", "1D"), ("COMEX_DL", "GC1!", "60"), ("BATS", "BRK.B", "1D")} <= got
    assert [r[0] for r in S.quarantine(df).collect()] == ["not_a_valid_name.csv"]
    good = df.filter("ticker is not null")
    assert [tuple(r)[:3] for r in S.collisions(good).collect()] == [("SPX", "1D", 2)]
    with pytest.raises(Exception, match="several files"):
        S.resolve_collisions(good, "raise").count()
    with pytest.raises(Exception, match="unparsable"):
        S.with_provenance(S.read_bars(spark, str(tmp_path)), strict=True).select("ticker").collect()
    one = S.resolve_collisions(good, "first").withColumnRenamed("ticker", "symbol").filter("symbol = 'SPX'")
    norm = S.normalize_bars(one).orderBy("time").toPandas()
    assert len(norm) == 31 and norm["time"].is_monotonic_increasing and norm["time"].iloc[0] == -3121407238
    assert norm.loc[norm["time"] == base["time"].iloc[3], "close"].item() == 999.0
    assert S.drop_known_duplicates(good, ["BATS_BRK.B, 1D_0cd15.csv"]).filter("ticker = 'BRK.B'").count() == 0
    with pytest.raises(ValueError, match="missing"):
        S.require_columns(df, ["nope"])


def test_resample_and_dates(spark):
    rows = [("A", 1704067200 + 3600 * i, o, h, lo, c, v) for i, (o, h, lo, c, v) in enumerate(
        [(10.0, 12.0, 9.5, 11.0, 100.0), (11.0, 14.0, 10.5, 13.0, 200.0), (13.0, 13.5, 11.0, 12.0, 300.0), (12.0, 13.8, 11.5, 13.5, 400.0)])]
    df = spark.createDataFrame(rows, "symbol string, time long, open double, high double, low double, close double, volume double")
    assert [tuple(r) for r in S.resample_bars(df, 4 * 3600).collect()] == [("A", 1704067200, 10.0, 14.0, 9.5, 13.5, 1000.0)]
    assert S.resample_bars(df, 2 * 3600).count() == 2
    neg = spark.createDataFrame([(-3121407238,)], "time long")
    assert str(S.with_bar_date(neg).first()["bar_date"]) == "1871-02-01"
    assert S.with_bar_date(neg, strict=True).first()["bar_date"] is None


def test_pool_isolation(spark):
    pdf = pooled((400, 300))
    cfg = FeatureConfig(blocks=("pir", "efficiency", "momentum"))
    both = P.build_pool(spark.createDataFrame(pdf), cfg, L.LOOSE, **ONE).drop("group_id").toPandas()
    alone = P.build_pool(spark.createDataFrame(pdf[pdf.symbol == "B"]), cfg, L.LOOSE, **ONE).drop("group_id").toPandas()
    a = both[both.symbol == "B"].sort_values("time").reset_index(drop=True)
    b = alone.sort_values("time").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)
    issues = P.pool_issues(spark.createDataFrame(pdf), spark.createDataFrame(pdf[pdf.symbol == "A"]), ["A", "Z"])
    assert {tuple(r) for r in issues.collect()} == {("B", "no defined rows"), ("Z", "absent")}


def test_deep_v_labels(spark):
    rng = np.random.default_rng(0)
    mid = np.concatenate([100 + rng.uniform(-0.02, 0.02, 600), np.linspace(100, 40, 120), np.linspace(40.5, 130, 140), 130 + rng.uniform(-0.02, 0.02, 400)])
    pdf = pd.DataFrame({"symbol": "V", "time": np.arange(len(mid)) * 86400, "open": mid, "high": mid + 0.01, "low": mid - 0.01, "close": mid, "volume": 1.0})
    out = L.label_turns(spark.createDataFrame(pdf), L.STRUCTURAL, chunk_rows=200).toPandas().sort_values("bar")
    assert out.set_index("bar").loc[719, "bottom_tier"] == "strong"
    ev = spark.createDataFrame([("V", "low", 719 * 86400 + 90_000)], "symbol string, event string, target long")
    hit = L.known_event_check(L.label_turns(spark.createDataFrame(pdf), **ONE), ev, 3, **ONE).first()
    assert hit["passed"] and hit["nearest_bar"] == 720
    cut = L.truncation_check(compute(spark.createDataFrame(pdf), [], **ONE), L.LOOSE, 800, **ONE)
    assert cut.count() == 0


def simulate(nodes, row):
    by = {n["node_id"]: n for n in nodes}
    i = 0
    while not by[i]["is_leaf"]:
        v = row[by[i]["feature"]]
        i = by[i]["left"] if v is None or v <= by[i]["threshold"] else by[i]["right"]
    return by[i]


def test_rules(spark):
    rng = np.random.default_rng(4)
    cols = ["price_return_L10", "price_return_L20", "er_dir_p10", "er_dir_p20"]
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in rng.normal(0, 0.4, 4)) for _ in range(200)]
    rows.append((-0.2, 0.5, 0.0, -0.1))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} double" for c in cols))
    got = {r["i"]: r for r in RU.score_ensemble(RU.score_tree(df, TREE).withColumnsRenamed({"rule_score": "ts", "rule_label": "tl"}), ENSEMBLE, -0.1, 0.5, 0.45).collect()}
    leaf = {r["i"]: r["leaf_id"] for r in RU.walk_nodes(df, spark.createDataFrame([tuple(n.values()) for n in TREE], RU.NODE_SCHEMA), cols, 2).collect()}
    e0, e1 = [n for n in ENSEMBLE if n["stage"] == 0], [n for n in ENSEMBLE if n["stage"] == 1]
    for i, r in enumerate(rows):
        row = dict(zip(cols, r))
        want = simulate(TREE, row)
        assert leaf[i] == want["node_id"] and got[i]["ts"] == want["pos_proba"]
        margin = -0.1 + 0.5 * (simulate(e0, row)["value"] + simulate(e1, row)["value"])
        assert got[i]["rule_score"] == pytest.approx(margin)
        assert got[i]["rule_label"] == int(margin >= np.log(0.45 / 0.55))
    assert RU.depth_and_leaves(TREE) == (2, 4)
    broken = [{**n, "threshold": 0.4} if n["node_id"] == 0 else n for n in TREE]
    bad = RU.score_tree(RU.score_tree(df, TREE).withColumnRenamed("rule_label", "a").drop("rule_score"), broken)
    rep = RU.rule_parity(bad, "a", "rule_label").first()
    assert rep["n_disagree"] > 0 and not rep["exact"]
    with pytest.raises(RU.ParityError):
        RU.assert_parity(bad, "a", "rule_label", ["i"])


def test_models(spark):
    rng = np.random.default_rng(0)
    n = 1500
    y = (rng.random(n) < 0.2).astype(int)
    pdf = pd.DataFrame({"symbol": "A", "bar": np.arange(n), "time": np.arange(n), "noise": rng.normal(size=n), "signal": rng.normal(size=n) + 3.0 * y, "y": y, "w": 1.0})
    df = spark.createDataFrame(pdf).cache()
    cols = ["noise", "signal"]
    imp = M.fit_importance(df, cols, "y", "w", M.GBTConfig(max_iter=3, max_depth=2, min_leaf=5)).toPandas()
    assert imp["feature"].iloc[0] == "signal" and imp["share"].sum() == pytest.approx(100)
    tree = M.fit_student(df, cols, "y", "w", M.StudentConfig(max_depth=3, min_leaf=20))
    nodes = RU.node_table(spark, tree, cols)
    listed = RU.collect_nodes(nodes)
    assert RU.depth_and_leaves(listed)[0] <= 3 and RU.used_features(nodes).first()["feature"] == "signal"
    scored = RU.score_tree(M.positive_score(tree.transform(M.assemble(df, cols))), listed)
    assert scored.agg(F.max(F.abs(F.col("score") - F.col("rule_score")))).first()[0] < 1e-12
    with pytest.raises(ValueError, match="single class"):
        M.distill(df.withColumn("p", F.lit(0.1)), cols, "p")
    iso = M.fit_isotonic(df, "signal", "y")
    cal = M.apply_isotonic(df, iso, "signal").orderBy("signal").toPandas()["calibrated"].to_numpy()
    assert (np.diff(cal) >= -1e-12).all() and cal.min() >= 0 and cal.max() <= 1
    assert M.fit_isotonic(df.withColumn("y", F.lit(0)), "signal", "y") is None
    sub = M.subsample_negatives(df, "y", 2)
    assert sub.filter("y = 0").count() == 2 * int(y.sum()) and sub.filter("y = 1").count() == y.sum()
    again = M.subsample_negatives(df.repartition(13), "y", 2)
    assert sub.select("bar").exceptAll(again.select("bar")).count() == 0


def test_sequence_windows(spark):
    pdf = pooled((60, 40))
    out = M.sequence_windows(spark.createDataFrame(pdf), ["close", "volume"], 16, chunk_rows=10).toPandas()
    for sym, g in pdf.sort_values("time").groupby("symbol"):
        own = out[out.symbol == sym].sort_values("time")
        assert len(own) == len(g) - 15
        np.testing.assert_allclose(np.array(own["seq"].iloc[0].tolist() if hasattr(own["seq"].iloc[0], "tolist") else own["seq"].iloc[0])[:, 0], g["close"].to_numpy()[:16], rtol=1e-6)


def test_stream_state_across_batches(spark, tmp_path):
    pdf = pooled((420, 300), gaps=False).sort_values("time")
    src = tmp_path / "src"
    src.mkdir()
    schema = spark.createDataFrame(pdf.head(1)).schema
    edges = pdf["time"].quantile([0.0, 0.3, 0.31, 0.7, 1.0]).tolist()
    streams = {
        "f": (lambda s: T.stream_features(s), "atr"),
        "l": (lambda s: T.stream_labels(s, L.LOOSE), "bottom_score"),
    }
    for i in range(4):
        part = pdf[(pdf["time"] > edges[i] if i else pdf["time"] >= edges[i]) & (pdf["time"] <= edges[i + 1])]
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(src))
        for tag, (make, _) in streams.items():
            q = make(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("parquet").option("path", str(tmp_path / f"{tag}-out")).option("checkpointLocation", str(tmp_path / f"{tag}-ck")).trigger(availableNow=True).start()
            q.awaitTermination()
    batch = compute(spark.createDataFrame(pdf), [X.atr(14), X.gjr_asym(), X.up_streak_norm(5)], **ONE).toPandas().sort_values(["symbol", "time"])
    got = spark.read.parquet(str(tmp_path / "f-out")).toPandas().sort_values(["symbol", "time"])
    np.testing.assert_allclose(got["atr"], batch["atr_14"], rtol=1e-10)
    np.testing.assert_allclose(got["gjr_asym"], batch["gjr_asym"], atol=1e-9)
    np.testing.assert_allclose(got["up_streak_norm"], batch["up_streak_norm"])
    lab = L.label_turns(spark.createDataFrame(pdf), L.LOOSE, **ONE).filter("bar + 40 < n_bars").toPandas().sort_values(["symbol", "time"])
    got = spark.read.parquet(str(tmp_path / "l-out")).toPandas().sort_values(["symbol", "time"])
    np.testing.assert_allclose(got["top_score"], lab["top_score"])
    np.testing.assert_allclose(got["bottom_score"], lab["bottom_score"])
