"""Strided windows against windows cut one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import sequences as SQ

COLS = "symbol string, time long, x double, y float, note string"


def series():
    rng = np.random.default_rng(8)
    rows = []
    for s, n in (("a", 57), ("b", 12), ("c", 4), ("d", 5)):
        for t in range(n):
            x = None if rng.random() < 0.1 else float(rng.normal())
            rows.append((s, t * 60, x, float(np.float32(rng.normal())), f"{s}{t}"))
    return rows


def plain(rows, window, keep=lambda r: True):
    out = {}
    for s in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == s), key=lambda r: r[1])
        for i in range(window - 1, len(own)):
            if keep(own[i]):
                out[s, own[i][1]] = [[None if v is None else float(np.float32(v)) for v in r[2:4]] for r in own[i + 1 - window : i + 1]]
    return out


@pytest.mark.parametrize("window", [1, 5, 13])
@pytest.mark.parametrize("layout", [{"chunk_rows": 7}, {"chunk_rows": 1000}, {"chunk_rows": 100, "max_bars": 60}])
def test_windows(spark, window, layout):
    rows = series()
    df = spark.createDataFrame(rows, COLS).repartition(5)
    out = SQ.sequence_windows(df, ["x", "y"], window, bar_seconds=60, **layout)
    assert sorted(out.columns) == sorted([*COLS.replace(",", "").split()[::2], "bar", "n_bars", "seq"])
    got = {(r.symbol, r.time): [list(v) for v in r.seq] for r in out.collect()}
    assert got == plain(rows, window)
    assert {r.note for r in out.collect()} == {f"{s}{t // 60}" for s, t in got}


def test_blocks_hold_the_same_windows(spark):
    rows = series()
    df = spark.createDataFrame(rows, COLS)
    odd = F.col("time") % 120 != 0
    blocks = SQ.sequence_blocks(df, ["x", "y"], 5, allowed=odd, bar_seconds=60, chunk_rows=7).collect()
    want = plain(rows, 5, lambda r: r[1] % 120 != 0)
    got = {}
    for b in blocks:
        views = SQ.block_windows(b["data"], b["n_cols"], 5, b["ends"])
        for w, end, t in zip(views, b["ends"], b["end_times"], strict=True):
            assert w.base is not None and (b["first_bar"] + end) * 60 == t
            got[b["symbol"], t] = [[None if np.isnan(v) else float(v) for v in r] for r in w]
    assert got == want
    assert max(b["n_rows"] for b in blocks) <= 7 + 4 and all(len(b["data"]) == b["n_rows"] * 8 for b in blocks)
    same = {(r.symbol, r.time) for r in SQ.sequence_windows(df, ["x", "y"], 5, odd, bar_seconds=60, chunk_rows=7).collect()}
    assert same == set(want)


def test_slices(spark, monkeypatch):
    """More windows than one slice holds."""
    rows = [("a", t * 60, float(t), 0.0, "") for t in range(3000)]
    out = SQ.sequence_windows(spark.createDataFrame(rows, COLS), ["x", "y"], 400, bar_seconds=60)
    r = out.select("time", F.element_at("seq", 1)[0].alias("first"), F.element_at("seq", -1)[0].alias("last")).collect()
    assert len(r) == 2601 and all(x.last == x.time / 60 and x.first == x.last - 399 for x in r)


def test_no_rows(spark):
    df = spark.createDataFrame([], COLS)
    assert SQ.sequence_windows(df, ["x"], 3, max_bars=10).count() == 0
    assert SQ.sequence_blocks(df, ["x"], 3, max_bars=10).count() == 0
    with pytest.raises(ValueError):
        SQ.sequence_windows(df, ["x"], 0)
