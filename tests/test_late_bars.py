"""Bars that wait for the watermark against the batch form and plain rules."""

import numpy as np
import pytest

from tidemark.streaming import stream as T

COLS = "symbol string, time long, high double, low double, close double"


def drained(spark, folder, files, make):
    for rows in files:
        spark.createDataFrame(rows, COLS).coalesce(1).write.mode("append").parquet(str(folder))
    src = spark.readStream.schema(COLS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    with T.timer_state(spark):
        return T.run_to_table(make(src)).toPandas().sort_values(["symbol", "time"], ignore_index=True)


def walk(symbol, n, seed):
    close = np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.02, n))) * 50
    return [(symbol, t * 10 - 200, float(c * 1.01), float(c * 0.99), float(c)) for t, c in enumerate(close)]


def test_any_order_within_the_delay(spark, tmp_path):
    rows = walk("a", 160, 1) + walk("b", 120, 2)
    rng = np.random.default_rng(3)
    late = sorted(rows, key=lambda r: r[1] + rng.random() * 200)
    files = [late[i : i + 40] for i in range(0, len(late), 40)]
    assert any(r[1] < max(x[1] for x in a) for a, b in zip(files, files[1:], strict=False) for r in b)
    got = drained(spark, tmp_path / "late", files, lambda s: T.stream_features(s, delay="200 seconds"))
    whole = drained(spark, tmp_path / "order", [sorted(rows, key=lambda r: r[1])], T.stream_features)
    want = whole[whole["time"] <= 1390 - 200].reset_index(drop=True)
    assert got[["symbol", "time"]].equals(want[["symbol", "time"]])
    np.testing.assert_allclose(got[["atr", "up_streak_norm"]], want[["atr", "up_streak_norm"]], rtol=1e-12)


def test_later_than_the_delay(spark, tmp_path):
    """Bars behind the watermark of an earlier micro-batch give no row; of bars with the same time the first stays."""
    bar = lambda t, c: ("a", t, c + 1.0, c - 1.0, c)
    files = [[bar(100, 5.0), bar(130, 6.0)], [bar(120, 7.0), bar(130, 9.0), bar(200, 8.0)], [bar(210, 8.0)], [bar(110, 1.0), bar(220, 8.5)], [bar(400, 9.0)]]
    got = drained(spark, tmp_path, files, lambda s: T.stream_features(s, 1, delay="50 seconds"))
    assert got["time"].tolist() == [100, 120, 130, 200, 210, 220]
    assert got["up_streak_norm"].tolist() == pytest.approx([0.0, 0.2, 0.0, 0.2, 0.0, 0.2])


def test_idle_symbols_begin_anew(spark, tmp_path):
    files = [walk("a", 5, 4), [("b", t, 2.0, 1.0, 1.5) for t in (500, 600)], [("b", 900, 2.0, 1.0, 1.5)], [("b", 950, 2.0, 1.0, 1.5)], [("a", 1000, 9.0, 8.0, 8.5), ("b", 1200, 2.0, 1.0, 1.5)]]
    own = {}
    for tag, idle in (("kept", None), ("freed", 300_000)):
        got = drained(spark, tmp_path / tag, files, lambda s, idle=idle: T.stream_features(s, 1, idle_ms=idle, delay="20 seconds"))
        own[tag] = got[(got["symbol"] == "a") & (got["time"] == 1000)]["atr"].item()
    assert own["freed"] == pytest.approx(1.0) and own["kept"] > 10


def test_state_store_setting_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with T.timer_state(spark):
        assert spark.conf.get(name) == T.ROCKSDB
    assert spark.conf.get(name) == before
