"""Inputs that are dear to make are made once, and exact selections agree with plain ones."""

from __future__ import annotations

import numpy as np
import pandas as pd

from tidemark.operators import models as M
from tidemark.operators import ranking as R
from tidemark.operators import splits as V


def counted(spark, pdf: pd.DataFrame, schema: str):
    """A table and a counter of the rows made for it, however often."""
    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for b in batches:
            made.add(len(b))
            yield b

    return spark.createDataFrame(pdf, schema).mapInPandas(make, schema), made


def test_subsample_makes_its_input_once(spark):
    pdf = pd.DataFrame({"symbol": ["a"] * 300 + ["b"] * 100, "bar": [*range(300), *range(100)]})
    pdf["y"] = (pdf.bar % 20 == 0).astype(int)
    df, made = counted(spark, pdf, "symbol string, bar long, y int")
    got = M.subsample_negatives(df, "y", 5).collect()
    assert sum(r["y"] for r in got) == 20 and len(got) == 120
    assert made.value == len(pdf)


def series(rows_of: dict, seed: int = 3) -> pd.DataFrame:
    """Series on shared days, so that edges of blocks fall inside a day."""
    rng = np.random.default_rng(seed)
    parts = []
    for symbol, n in rows_of.items():
        t = np.sort(rng.choice(60, n, replace=False))
        parts.append(pd.DataFrame({"symbol": symbol, "bar": range(n), "time": t * 86_400}))
    return pd.concat(parts, ignore_index=True)


def test_folds_make_their_input_once_and_carry(spark):
    pdf = series({f"s{i}": 20 + i for i in range(12)})
    pdf["v"] = pdf.bar * 0.5
    df, made = counted(spark, pdf, "symbol string, bar long, time long, v double")
    got = V.purged_folds(df, 3, 2, 4, carry=["v"]).toPandas()
    assert made.value == len(pdf)
    assert (got.v == got.bar * 0.5).all() and (got.role == "test").sum() == len(pdf)


def test_blocks_by_edges_are_blocks_by_rank(spark):
    """Edges inside a day, several edges in one day, a null day; equal time and symbol lie by bar."""
    one_day = pd.DataFrame({"symbol": [f"s{i:02d}" for i in range(30)], "bar": 0, "time": 5})
    for pdf, k in ((series({f"s{i}": 9 + i for i in range(7)}), 5), (one_day, 4), (series({"a": 50}), 7), (series({"a": 3}), 3)):
        rows = [(r.symbol, int(r.bar), int(r.time)) for r in pdf.itertuples()] + [(None, 0, 7), ("z", 0, None)]
        df = spark.createDataFrame(rows, "symbol string, bar long, time long")
        want = V.with_block(df, k).select("symbol", "bar", "time", "block").collect()
        got = V.with_block_by_edges(df, k).select("symbol", "bar", "time", "block").collect()
        assert sorted(got, key=repr) == sorted(want, key=repr)
    same = spark.createDataFrame([("a", b, 5) for b in range(10)], "symbol string, bar long, time long")
    assert [r["block"] for r in V.with_block_by_edges(same, 5).orderBy("bar").collect()] == [b // 2 for b in range(10)]


def test_leak_check_sorts_no_rows(spark):
    rows = [("a", b, "test" if 40 <= b < 60 else "train", 0) for b in range(100)] + [("b", b, "train", 0) for b in range(50)]
    folds = spark.createDataFrame(rows, "symbol string, bar long, role string, fold int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = V.leaks(folds, 5, 3)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in found.collect()] == [(0, 130, 8)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_quantiles_of_odd_values(spark):
    """Repeats, zeros of both signs, values that share a bucket, huge and tiny ones; undefined ones first and last."""
    rng = np.random.default_rng(1)
    groups = {
        "wide": np.concatenate([rng.normal(0, 1, 300), [1e300, -1e300, 1e-300, -0.0, 0.0, 1e308]]), "narrow": 100 + rng.random(200) * 1e-9,
        "hot": np.repeat([1.0, 2.0], [500, 3]), "one": np.array([4.5]), "signs": np.array([-3.0, -2.0, -1.0, 1.0, 2.0, 3.0]),
    }
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = {(r["g"], r["prob_index"]): r["value"] for r in R.quantiles(df, ["g"], "v", probs).collect()}
    assert len(got) == len(groups) * len(probs)
    for g, x in groups.items():
        x = np.sort(x)
        for i, p in enumerate(probs):
            at = p * (len(x) - 1)
            lo, hi = x[int(np.floor(at))], x[int(np.ceil(at))]
            assert got[g, i] == lo + (hi - lo) * (at - np.floor(at))
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (2.0,), (float("-inf"),)], "v double")
    ends = [r["value"] for r in R.quantiles(odd, [], "v", [0.0, 0.25, 0.5, 0.75, 1.0]).orderBy("prob_index").collect()]
    assert ends[0] is None and ends[2] == 2.0 and np.isnan(ends[4])
