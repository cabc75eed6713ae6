"""Refusals, bounds, and intermediate storage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import models as M
from tidemark.operators import overfit as O
from tidemark.operators import ranking as R
from tidemark.operators import rules as RU
from tidemark.operators import splits as V
from tidemark.sources import bars as S


def test_scratch_is_scoped_and_cleared(spark):
    df = session.materialise(spark.range(5))
    assert df.count() == 5 and session.scratch_folder(spark) in df.inputFiles()[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(session.scratch_folder(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(path)
    session.clear_scratch(spark)
    assert not fs.exists(path)


def test_a_cluster_must_name_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())
    Session.sparkContext.master = "local[2]"
    assert session.checkpoint_root(Session())


def test_k_above_the_rows_is_refused(spark):
    df = spark.createDataFrame([(0.5, 1, 1), (0.4, 0, 2)], "score double, y int, pos int")
    assert R.top_k(df, "score", "pos", 2).count() == 2
    for ask in (lambda: R.top_k(df, "score", "pos", 3), lambda: R.precision_at_k(df, "score", "y", 3, "pos")):
        with pytest.raises(Exception, match="there are only 2 rows"):
            ask().collect()


def test_combinations_are_bounded(spark):
    df = spark.createDataFrame([(t, c, float(t * c % 7)) for t in range(40) for c in range(3)], "t int, config int, value double")
    with pytest.raises(ValueError, match="combinations"):
        O.pbo_cscv(df, 20).collect()


def test_leaks_are_counted_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(V, "CHUNK_ROWS", 7)
    rows = [(s, b, f, "test" if 20 <= b < 30 else "train") for s in "ab" for b in range(60) for f in (0,)]
    got = V.leaks(spark.createDataFrame(rows, "symbol string, bar long, fold int, role string"), 3, 2).collect()
    # three bars before and two after the test block, in both series
    assert [(r.fold, r.n_train, r.n_leaked) for r in got] == [(0, 100, 10)]


def test_rows_without_provenance_stay(spark):
    df = spark.createDataFrame([("x.csv", None, None, 1), ("a", "T", "1D", 2)], "file_name string, ticker string, tf string, v int")
    assert S.resolve_collisions(df, "raise").count() == S.resolve_collisions(df, "first").count() == 2
    two = df.union(spark.createDataFrame([("b", "T", "1D", 3)], df.schema))
    assert S.resolve_collisions(two, "first").count() == 2
    with pytest.raises(Exception, match="several files"):
        S.resolve_collisions(two, "raise").count()
    with pytest.raises(Exception, match="unparsable"):
        S.with_provenance(df.select("file_name", "v"), strict=True).select("v").collect()
    assert S.drop_known_duplicates(df).count() == 2


def test_keep_last_over_several_splits(spark, tmp_path):
    rows = [f"{t},1,1,1,{k},1" for k in range(400) for t in (k % 7, 1000 + k)]
    for name in ("A_b, 1D_0.csv", "A_c, 1D_1.csv"):
        (tmp_path / name).write_text("\n".join(["time,open,high,low,close,Volume", *rows]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        df = S.read_bars(spark, str(tmp_path)).withColumn("symbol", F.lit("A"))
        assert df.rdd.getNumPartitions() > 4
        got = {r.time: r.close for r in S.normalize_bars(df).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {t: max(k for k in range(400) if k % 7 == t) for t in range(7)} | {1000 + k: k for k in range(400)}


def test_single_order_key_is_hashed(spark):
    ticks = spark.range(100).select(F.lit("s").alias("k"), F.col("id").alias("t"), F.rand(1).alias("p"))
    out = S.ticks_to_bars(ticks, F.col("k"), F.col("t"), F.col("p"), F.lit(1.0), 10, [F.col("t")])
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["tree", "gboost"])
def test_rules_and_model_agree_on_undefined_values(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=600) > 0).astype(int)
    rows = [(i, None if i % 6 == 0 else float(a), float("nan") if i % 7 == 0 else float(b), int(t), 1.0) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int, w double")
    model = M.fit_student(df, ["a", "b"], "y", "w", M.StudentConfig(kind=kind, max_depth=3, n_trees=5, min_leaf=5))
    scored = model.transform(M.assemble(df, ["a", "b"])).withColumn("model_label", F.col("prediction").cast("int"))
    nodes = RU.collect_nodes(RU.node_table(spark, model, ["a", "b"]))
    assert len(nodes) > 3
    # the fitted margin of boosted trees is half the log-odds
    ruled = RU.score_tree(scored, nodes) if kind == "tree" else RU.score_ensemble(scored, nodes, 0.0, 2.0)
    row = RU.rule_parity(ruled, "model_label", "rule_label").first()
    assert (row.n_rows, row.n_disagree) == (600, 0)
    if kind == "tree":
        assert ruled.filter(F.abs(F.col("rule_score") - M.vector_to_array("probability")[1]) > 1e-12).count() == 0


def test_isotonic_steps_are_bounded(spark):
    df = spark.range(4000).select((F.col("id") / 4000).alias("s"), (F.col("id") > 2000).cast("int").alias("y"))
    whole, few = (M.fit_isotonic(df, "s", "y", max_steps=k) for k in (10_000, 50))
    assert len(few.boundaries) <= 51
    a, b = (M.apply_isotonic(df, m, "s").select("s", "calibrated").toPandas().sort_values("s")["calibrated"].to_numpy() for m in (whole, few))
    assert np.abs(a - b).mean() < 0.02


def test_isotonic_is_exact_for_many_skewed_scores(spark):
    """More than 10,000 distinct scores, one of them far away, against pooling on one array."""
    rng = np.random.default_rng(6)
    x = np.append(np.sort(rng.permutation(200_000)[:12_000]).astype(float), 1e9)
    y = (rng.random(len(x)) < 0.2 + 0.6 * np.arange(len(x)) / len(x)).astype(int)
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(float(x[i]), int(y[i])) for i in order], "s double, y int").repartition(7)
    blocks = []
    for v in y:
        blocks.append([float(v), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (a, m), (b, n) = blocks[-2:]
            blocks[-2:] = [[(a * m + b * n) / (m + n), m + n]]
    want = np.repeat([b[0] for b in blocks], [b[1] for b in blocks])
    got = M.apply_isotonic(df, M.fit_isotonic(df, "s", "y"), "s").toPandas().sort_values("s")["calibrated"].to_numpy()
    assert np.abs(got - want).max() < 1e-9
    with pytest.raises(ValueError, match="max_steps"):
        M.fit_isotonic(df, "s", "y", max_steps=5)


def test_late_bars_are_left_out(spark, tmp_path):
    from tidemark.streaming import stream as T

    cols = "symbol string, time long, high double, low double, close double"
    for rows in ([("a", t, 2.0 + t, 1.0 + t, 1.5 + t) for t in range(10, 20)], [("a", t, 2.0, 1.0, 1.5) for t in (5, 19, 21, 20)] + [("b", 3, 2.0, 1.0, 1.5)]):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(str(tmp_path))
    src = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    out = T.run_to_table(T.stream_features(src, 3)).collect()
    assert sorted((r.symbol, r.time) for r in out) == [("a", t) for t in range(10, 22)] + [("b", 3)]
    assert max(r.up_streak_norm for r in out if r.time >= 20) == 0
