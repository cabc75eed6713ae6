import math
import random

import numpy as np
import pyarrow as pa
import pytest
from data import pooled
from pyspark.sql import functions as F

from tidemark import scan


def test_composed_maps_are_maps_in_turn():
    rng = random.Random(0)
    for _ in range(2000):
        maps = [(rng.choice([0.0, 0.5, 1.0, 1.5]), rng.uniform(-2, 2), rng.choice([-math.inf, rng.uniform(-2, 2)])) for _ in range(rng.randint(0, 9))]
        total, x = scan.IDENTITY, rng.uniform(-5, 5)
        y = x
        for m in maps:
            total, y = scan.compose(total, m), scan.apply(m, y)
        assert math.isclose(scan.apply(total, x), y, abs_tol=1e-9) and not math.isnan(total[2])


@pytest.mark.parametrize("chunk_rows", [37, 5000])
def test_scan_is_a_plain_loop(spark, chunk_rows):
    """Factors that change by row, nulls, floors that bind, and none."""
    bars = pooled().sample(frac=1, random_state=1)
    df = spark.createDataFrame(bars).repartition(5)
    a = F.when(F.col("volume") == 7, None).when(F.col("volume") < 3, 0.0).otherwise(F.col("low") / F.col("high"))
    b, c = F.col("volume") / 25 - 1.1, F.when(F.col("volume") > 5, F.col("volume") / 50)
    for floor in (c, None):
        got = {(r.symbol, r.time): r.x for r in scan.max_affine_scan(df, a, b, floor, "x", 0.3, chunk_rows=chunk_rows).collect()}
        assert len(got) == len(bars)
        bound = 0
        for symbol, rows in bars.sort_values("time").groupby("symbol"):
            x = 0.3
            for r in rows.itertuples():
                y = x if r.volume == 7 else (0.0 if r.volume < 3 else r.low / r.high) * x + r.volume / 25 - 1.1
                low = r.volume / 50 if floor is not None and r.volume > 5 else -math.inf
                bound += low > y
                x = max(y, low)
                assert math.isclose(got[symbol, r.time], x, rel_tol=1e-9, abs_tol=1e-9)
        assert (bound > 50) == (floor is not None)


def test_scan_refuses_and_keeps_columns(spark):
    df = spark.createDataFrame(pooled((50,)))
    out = scan.max_affine_scan(df, F.lit(1), F.lit(1), None, "n")
    assert out.columns == [*df.columns, "n_bars", "bar", "n"]
    assert sorted(r.n for r in out.collect()) == list(np.arange(1.0, 51.0))
    assert scan.max_affine_scan(df.limit(0), F.lit(1), F.lit(1), None, "n").count() == 0
    with pytest.raises(Exception, match="must not be negative"):
        scan.max_affine_scan(df, F.lit(-0.5), F.lit(1), None, "n").collect()


def test_chunks_go_side_by_side_and_batches_cut_them():
    """The maps of chunks of uneven length, stepped through together, are those composed one by one."""
    rng = np.random.default_rng(0)
    sizes = [3, 1, 40, 7, 7, 90]
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    n = len(chunk)
    a, b, c = rng.choice([0.0, 0.5, 1.2], n), rng.normal(size=n), np.where(rng.random(n) < 0.3, rng.normal(size=n), -np.inf)
    rows = pa.table({"symbol": [None if k == 0 else "AB"[k % 2] for k in chunk], "_ck": chunk, "_a": a, "_b": b, "_c": c})
    for step in (5, 64, 1000):
        got = pa.Table.from_batches(list(scan._by_chunk(scan._composed)(iter(rows.to_batches(max_chunksize=step))))).to_pylist()
        assert [r["_ck"] for r in got] == list(range(len(sizes)))
        for k, r in enumerate(got):
            total = scan.IDENTITY
            for m in zip(a[chunk == k], b[chunk == k], c[chunk == k], strict=True):
                total = scan.compose(total, m)
            assert np.allclose((r["_a"], r["_b"], r["_c"]), total)
