"""Readers, universe and pool, scaling, models, rules."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as C
from tidemark.layout import compute
from tidemark.operators import features as X
from tidemark.operators import forest as T
from tidemark.operators import models as M
from tidemark.operators import pool as P
from tidemark.operators import rules as RU
from tidemark.operators import sequences as SQ
from tidemark.operators import splits as V
from tidemark.operators.bank import FeatureConfig, feature_names
from tidemark.plans import base as B
from tidemark.plans import sqltext as Q
from tidemark.plans.base import EVENT, FLAG, SUPP, query, r6, rounded
from tidemark.plans.q_labels_splits import LOOSE, labels_sql
from tidemark.session import checkpoint_root, materialise, scratch_folder
from tidemark.sources import bars as S

# --------------------------------------------------------------------------- sources


@query("s1_read_bars", f"WITH {FLAG} SELECT count(*) AS n, {r6('sum(close)', 2)} AS close_sum, {r6('sum(volume)', 2)} AS volume_sum FROM bars")
def s1(spark, sf_dir):
    """Bars written as CSV files and read back with the fixed schema."""
    bars, _ = B.bars_flag(spark, sf_dir)
    path = f"{checkpoint_root(spark)}/csv-{uuid.uuid4().hex}"
    bars.select("time", "open", "high", "low", "close", F.col("volume").alias("Volume")).write.option("header", True).csv(path)
    df = S.read_bars(spark, path).agg(
        F.count(F.lit(1)).alias("n"), F.sum("close").alias("close_sum"), F.sum("Volume").alias("volume_sum"))
    return rounded(df, "close_sum", "volume_sum", digits=2)


_FILES = """f AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 'bad ' || o_orderpriority
  ELSE 'EX_' || c_mktsegment || '_' || c_nationkey || ', ' || CASE WHEN o_orderstatus = 'F' THEN '60' ELSE '1D' END || '_'
  || substr(md5(o_orderpriority), 1, 5) || '.csv' END AS file_name
  FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT *, CASE WHEN regexp_full_match(file_name, '(.+)_([^_,]+), (\\d+|1D)_([0-9a-f]+)\\.csv') THEN
  regexp_extract(file_name, '^(.+)_([^_,]+), (\\d+|1D)_([0-9a-f]+)\\.csv$', ['exchange', 'ticker', 'tf', 'file_hash']) END AS g FROM f),
q AS (SELECT o_orderkey, o_totalprice, file_name, g.exchange AS exchange, g.ticker AS ticker, g.tf AS tf, g.file_hash AS file_hash FROM p)"""


def _files(spark, sf_dir):
    """Orders as rows of files whose names carry provenance."""
    o, c = B.table(spark, sf_dir, "orders"), B.table(spark, sf_dir, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    tf = F.when(F.col("o_orderstatus") == "F", "60").otherwise("1D")
    good = F.concat(F.lit("EX_"), "c_mktsegment", F.lit("_"), F.col("c_nationkey").cast("string"), F.lit(", "), tf, F.lit("_"),
                    F.substring(F.md5("o_orderpriority"), 1, 5), F.lit(".csv"))
    name = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("bad "), "o_orderpriority")).otherwise(good)
    return S.with_provenance(j.select("o_orderkey", "o_totalprice", name.alias("file_name")))


@query("s2_provenance", f"WITH {_FILES} SELECT o_orderkey, exchange, ticker, tf, file_hash FROM q")
def s2(spark, sf_dir):
    return _files(spark, sf_dir).select("o_orderkey", "exchange", "ticker", "tf", "file_hash")


@query("s2_quarantine", f"WITH {_FILES} SELECT DISTINCT file_name FROM q WHERE ticker IS NULL")
def s2b(spark, sf_dir):
    return S.quarantine(_files(spark, sf_dir))




@query("s3_drop_known_duplicates", f"WITH {_FILES}, k AS (SELECT min(file_name) AS n FROM q WHERE ticker IS NOT NULL) SELECT o_orderkey, file_name FROM q WHERE file_name NOT IN (SELECT n FROM k)")
def s3(spark, sf_dir):
    df = _files(spark, sf_dir)
    name = df.filter("ticker is not null").agg(F.min("file_name")).first()[0]
    return S.drop_known_duplicates(df, [name]).select("o_orderkey", "file_name")


@query("s4_collisions", f"WITH {_FILES} SELECT ticker, tf, CAST(count(DISTINCT file_name) AS BIGINT) AS n_files, min(file_name) AS first_file, count(*) AS rows FROM q WHERE ticker IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT file_name) > 1")
def s4(spark, sf_dir):
    return S.collisions(_files(spark, sf_dir).filter("ticker is not null"))


@query("s4_first_file_wins", f"WITH {_FILES}, w AS (SELECT ticker, tf, min(file_name) AS file_name FROM q WHERE ticker IS NOT NULL GROUP BY 1, 2) SELECT q.o_orderkey, q.file_name FROM q JOIN w USING (ticker, tf, file_name)")
def s4b(spark, sf_dir):
    return S.resolve_collisions(_files(spark, sf_dir).filter("ticker is not null"), "first").select("o_orderkey", "file_name")


@query(
    "s5_normalize_bars",
    """SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(epoch(l_shipdate) AS BIGINT) AS time,
    arg_max(l_extendedprice, ROW(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open,
    arg_max(l_extendedprice * 2, ROW(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS high,
    arg_max(l_discount, ROW(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS low,
    arg_max(l_tax, ROW(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close,
    arg_max(l_quantity, ROW(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS volume FROM lineitem GROUP BY 1, 2""",
)
def s5(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem")
    raw = li.select(
        F.col("l_suppkey").cast("string").alias("symbol"), B.epoch_seconds(li, "l_shipdate").alias("time"),
        F.col("l_extendedprice").alias("open"), (F.col("l_extendedprice") * 2).alias("high"), F.col("l_discount").alias("low"),
        F.col("l_tax").alias("close"), F.col("l_quantity").alias("Volume"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
    )
    return S.normalize_bars(raw, ingest=("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))


@query("s6_monotonic_violations", """WITH o AS (SELECT o_orderstatus AS symbol, CAST(epoch(o_orderdate) AS BIGINT) AS time, o_orderkey AS seq FROM orders),
l AS (SELECT *, lag(time) OVER (PARTITION BY symbol ORDER BY seq) AS prev_time FROM o) SELECT symbol, seq, time, prev_time FROM l WHERE time <= prev_time""")
def s6(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    df = o.select(F.col("o_orderstatus").alias("symbol"), B.epoch_seconds(o, "o_orderdate").alias("time"), F.col("o_orderkey").alias("seq"))
    return S.monotonic_violations(df, "seq", 1_000).select("symbol", "seq", "time", "prev_time")


@query("s6_duplicate_times", """SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(epoch(l_shipdate) AS BIGINT) AS time, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def s6b(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem")
    return S.duplicate_times(li.select(F.col("l_suppkey").cast("string").alias("symbol"), B.epoch_seconds(li, "l_shipdate").alias("time")))


@query("s7_require_columns", f"WITH {EVENT} SELECT count(*) AS n FROM bars")
def s7(spark, sf_dir):
    bars, _ = B.bars_event(spark, sf_dir)
    S.require_columns(bars, S.CANONICAL)
    return bars.agg(F.count(F.lit(1)).alias("n"))


@query("s15_write_table", f"WITH {FLAG} SELECT symbol, count(*) AS n FROM bars GROUP BY symbol")
def s15(spark, sf_dir):
    path = f"{checkpoint_root(spark)}/out-{uuid.uuid4().hex}"
    S.write_table(B.bars_flag(spark, sf_dir)[0], path, ["symbol"])
    return spark.read.parquet(path).groupBy(F.col("symbol").cast("string").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- pool

POOL_CFG = FeatureConfig(blocks=("efficiency", "momentum"), er_periods=(10, 20), mom_lookbacks=(10, 20))
POOL_COLS = feature_names(POOL_CFG)
_pf, _pl = Q.chain(Q.merge(*[Q.er(p, t == "dir", f"er_{t}_p{p}") for p in (10, 20) for t in ("dir", "abs")], *[Q.momentum(n) for n in (10, 20)]))
_plt, _pll = labels_sql(LOOSE, _pl)
POOL_SQL = f"""{SUPP},\n{_pf},\n{_plt},
pool AS (SELECT *, dense_rank() OVER (ORDER BY symbol) - 1 AS group_id FROM {_pll} WHERE {' AND '.join(c + ' IS NOT NULL' for c in POOL_COLS)})"""


def pool(spark, sf_dir, group_ids=False):
    bars, lay = B.bars_supp(spark, sf_dir)
    return P.build_pool(bars, POOL_CFG, LOOSE, group_ids, **lay)


@query("s11_build_pool", f"WITH {POOL_SQL} SELECT symbol, time, group_id, top_tier, bottom_tier, " + ", ".join(f"{r6(c)} AS {c}" for c in POOL_COLS) + " FROM pool")
def s11(spark, sf_dir):
    df = pool(spark, sf_dir, True).select("symbol", "time", "group_id", "top_tier", "bottom_tier", *POOL_COLS)
    return rounded(df, *POOL_COLS)


@query("s10_select_universe", f"WITH {SUPP} SELECT symbol, CASE symbol WHEN '7' THEN 1 WHEN '3' THEN 2 ELSE 3 END AS priority FROM (SELECT DISTINCT symbol FROM bars) ORDER BY priority, symbol LIMIT 5")
def s10(spark, sf_dir):
    return P.select_universe(B.bars_supp(spark, sf_dir)[0], max_assets=5, anchors=("7", "3"))


@query("s10_whitelist", f"WITH {SUPP} SELECT symbol, CASE symbol WHEN '7' THEN 1 ELSE 2 END AS priority FROM (SELECT DISTINCT symbol FROM bars) WHERE symbol IN ('7', '3')")
def s10b(spark, sf_dir):
    return P.select_universe(B.bars_supp(spark, sf_dir)[0], ["7", "3", "none"])


@query("s12_pool_issues", f"""WITH {SUPP}, s AS (SELECT DISTINCT symbol FROM bars),
r AS (SELECT symbol, row_number() OVER (ORDER BY CASE symbol WHEN '7' THEN 1 WHEN 'nope' THEN 2 ELSE 3 END, symbol) AS rk FROM s)
SELECT symbol, 'capped' AS issue FROM r WHERE rk > 5 UNION ALL SELECT 'nope', 'absent'""")
def s12(spark, sf_dir):
    bars, lay = B.bars_supp(spark, sf_dir)
    chosen = P.restrict(bars, P.select_universe(bars, max_assets=5, anchors=("7", "nope")))
    made = P.build_pool(chosen, POOL_CFG, LOOSE, False, **lay)
    return P.pool_issues(bars, made, ("7", "nope"), 5)


@query("s13_counts_per_group", f"WITH {POOL_SQL} SELECT symbol, count(*) AS n_rows FROM pool GROUP BY symbol")
def s13(spark, sf_dir):
    return P.counts_per_group(pool(spark, sf_dir))


@query("s13_subset", f"WITH {POOL_SQL} SELECT symbol, time FROM pool WHERE symbol = '3'")
def s13b(spark, sf_dir):
    return P.subset(pool(spark, sf_dir), "3").select("symbol", "time")


@query("o4_union_of_sides", f"WITH {SUPP}, {FLAG.replace('raw AS', 'raw2 AS').replace('bars AS', 'bars2 AS').replace('FROM raw)', 'FROM raw2)')} SELECT symbol, time, close FROM bars UNION ALL SELECT symbol, time, close FROM bars2")
def o4(spark, sf_dir):
    a, b = (x(spark, sf_dir)[0].select("symbol", "time", "close") for x in (B.bars_supp, B.bars_flag))
    return a.unionByName(b)


# --------------------------------------------------------------------------- scaling and sampling

CUT = 946_684_800  # 2000-01-01, inside the span of the ticks


@query(
    "m2_zscore_by_series",
    f"""WITH {POOL_SQL}, st AS (SELECT symbol, avg(er_dir_p10) AS m, stddev_pop(er_dir_p10) AS s FROM pool WHERE time < {CUT} AND symbol <> '5' GROUP BY symbol),
g AS (SELECT avg(er_dir_p10) AS m, stddev_pop(er_dir_p10) AS s FROM pool WHERE time < {CUT} AND symbol <> '5')
SELECT p.symbol, p.time, {r6('(p.er_dir_p10 - coalesce(st.m, g.m)) / CASE WHEN coalesce(st.s, g.s) > 1e-12 THEN coalesce(st.s, g.s) ELSE 1 END')} AS er_dir_p10
FROM pool p LEFT JOIN st USING (symbol) CROSS JOIN g""",
)
def m2(spark, sf_dir):
    train = (F.col("time") < CUT) & (F.col("symbol") != "5")
    out = M.zscore_by_series(pool(spark, sf_dir).select("symbol", "time", "er_dir_p10"), ["er_dir_p10"], train)
    return rounded(out, "er_dir_p10")


@query(
    "m3_standardise",
    f"""WITH {POOL_SQL}, g AS (SELECT avg(er_dir_p10) AS m, stddev_pop(er_dir_p10) AS s FROM pool WHERE time < {CUT})
SELECT symbol, time, {r6('coalesce((er_dir_p10 - m) / CASE WHEN s >= 1e-8 THEN s ELSE 1 END, 0)')} AS er_dir_p10 FROM pool CROSS JOIN g""",
)
def m3(spark, sf_dir):
    out = M.standardise(pool(spark, sf_dir).select("symbol", "time", "er_dir_p10"), ["er_dir_p10"], F.col("time") < CUT)
    return rounded(out, "er_dir_p10")


@query(
    "m4_sequence_windows",
    f"""WITH {POOL_SQL}, n AS (SELECT symbol, time, er_dir_p10, row_number() OVER (PARTITION BY symbol ORDER BY time) AS rn,
      lag(er_dir_p10, 15) OVER (PARTITION BY symbol ORDER BY time) AS f FROM pool)
SELECT symbol, time, CAST(16 AS INTEGER) AS width, {r6('CAST(CAST(f AS FLOAT) AS DOUBLE)', 4)} AS first_value, {r6('CAST(CAST(er_dir_p10 AS FLOAT) AS DOUBLE)', 4)} AS last_value FROM n WHERE rn >= 16""",
)
def m4(spark, sf_dir):
    _, lay = B.bars_supp(spark, sf_dir)
    df = pool(spark, sf_dir).select("symbol", "time", "er_dir_p10", "er_dir_p20")
    out = M.sequence_windows(df, ["er_dir_p10", "er_dir_p20"], 16, **lay)
    out = out.select(
        "symbol", "time", F.size("seq").alias("width"), F.col("seq")[0][0].cast("double").alias("first_value"),
        F.element_at("seq", -1)[0].cast("double").alias("last_value"))
    return rounded(out, "first_value", "last_value", digits=4)


@query(
    "m4_sequence_blocks",
    f"""WITH {POOL_SQL}, n AS (SELECT symbol, time, er_dir_p10, row_number() OVER (PARTITION BY symbol ORDER BY time) AS rn,
      avg(CAST(er_dir_p20 AS FLOAT)) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS m FROM pool)
SELECT symbol, count(*) AS n_windows, min(time) AS first_end, max(time) AS last_end, {r6('avg(m)', 4)} AS mean_value FROM n WHERE rn >= 16 GROUP BY symbol""",
)
def m4b(spark, sf_dir):
    """The same windows as views of one matrix per chunk; the mean of every window's second column, by symbol."""
    df = pool(spark, sf_dir).select("symbol", "time", "er_dir_p10", "er_dir_p20")
    blocks = SQ.sequence_blocks(df, ["er_dir_p10", "er_dir_p20"], 16, chunk_rows=64)

    def means(batches):
        for batch in batches:
            rows = [(b["symbol"], t, float(w[:, 1].mean(dtype=float))) for b in batch.to_pylist()
                    for w, t in zip(SQ.block_windows(b["data"], b["n_cols"], 16, b["ends"]), b["end_times"], strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["symbol", "time", "m"])

    found = blocks.mapInArrow(means, "symbol string, time long, m double").groupBy("symbol")
    out = found.agg(F.count("time").alias("n_windows"), F.min("time").alias("first_end"), F.max("time").alias("last_end"), F.avg("m").alias("mean_value"))
    return rounded(out, "mean_value", digits=4)


def _targets(spark, sf_dir):
    return C.with_targets(pool(spark, sf_dir), "bottom")


@query(
    "m9_subsample_negatives",
    f"""WITH {POOL_SQL}, t AS (SELECT symbol, bar, CASE WHEN bottom_tier IN ('strong', 'regular') THEN 1 ELSE 0 END AS y FROM pool),
n AS (SELECT sum(y) AS np FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(symbol || '|' || bar || '|' || 42), symbol, bar) AS rk FROM t)
SELECT symbol, bar, y FROM r, n WHERE y = 1 OR np = 0 OR rk <= 5 * np""",
)
def m9(spark, sf_dir):
    return M.subsample_negatives(_targets(spark, sf_dir).select("symbol", "bar", "y"), "y", 5)


_VAR = """v AS (SELECT n_regionkey AS region, n_name AS name, CAST(n_nationkey AS INTEGER) AS size_order,
  coalesce(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 0) AS f1, avg(l_discount) AS ap, 0.0714 AS ref_ap
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3),
a AS (SELECT *, max(f1) OVER (PARTITION BY region) AS bf FROM v),
b AS (SELECT *, f1 >= 0.5 * bf AND f1 > 0 AS ok1, max(CASE WHEN f1 >= 0.5 * bf AND f1 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY region) AS any1 FROM a),
c AS (SELECT *, ap >= 0.7 * ref_ap AS ok2, max(CASE WHEN ap >= 0.7 * ref_ap THEN 1 ELSE 0 END) OVER (PARTITION BY region) AS any2 FROM b WHERE ok1 OR any1 = 0),
d AS (SELECT *, max(ap) OVER (PARTITION BY region) AS ba FROM c WHERE ok2 OR any2 = 0),
e AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY size_order) AS rk FROM d WHERE ap >= ba * 0.98)"""


@query("m11_select_variant", f"WITH {_VAR} SELECT region, name, {r6('f1')} AS f1, {r6('ap')} AS ap FROM e WHERE rk = 1")
def m11(spark, sf_dir):
    li, su, na = (B.table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    per = li.groupBy("l_suppkey").agg(F.sum((F.col("l_returnflag") == "R").cast("double")).alias("r"), F.sum("l_discount").alias("s"), F.count(F.lit(1)).alias("n"))
    j = per.join(su, F.col("l_suppkey") == F.col("s_suppkey")).join(na, F.col("s_nationkey") == F.col("n_nationkey"))
    v = j.groupBy(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("int").alias("size_order")).agg(
        (F.sum("r") / F.sum("n")).alias("f1"), (F.sum("s") / F.sum("n")).alias("ap"), F.lit(0.0714).alias("ref_ap"))
    return rounded(M.select_variant(v, ["region"]), "f1", "ap")


# --------------------------------------------------------------------------- fitted models

#: Boosted teacher of the queries: all columns, six folds, both sides, trees of 31 leaves; rounds and depth are less than
#: `Growth`'s own 300 and unlimited, whose time the README gives.
TEACHER = T.Growth(rounds=20, depth=8, step=0.1)
FULL_CFG = FeatureConfig(include_overextension=True)
FULL_COLS = feature_names(FULL_CFG)
N_FOLDS = 6
SIDES = ("top", "bottom")
_full: dict[tuple[str, str], DataFrame] = {}


def full_pool(spark, sf_dir):
    """The pool with every column of the bank, written once for all fitted queries of an application."""
    key = (scratch_folder(spark), sf_dir)
    if key not in _full or not _readable(_full[key]):
        bars, lay = B.bars_supp(spark, sf_dir)
        _full[key] = materialise(P.build_pool(bars, FULL_CFG, LOOSE, False, **lay))
    return _full[key]


def _readable(df):
    """Whether the scratch table is still there."""
    spark, path = df.sparkSession, df.inputFiles()[:1]
    if not path:
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path(path[0])
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _label(side):
    return F.col(f"{side}_tier").isin(*C.POSITIVE_TIERS).cast("int")


def _sided():
    """Label and sample weight of each side."""
    return {s: (_label(s), F.when(_label(s) == 1, 1.0 + F.col(f"{s}_score")).otherwise(1.0)) for s in SIDES}


def _side_targets():
    return [T.Target(s, y, w) for s, (y, w) in _sided().items()]


def _folds(pool):
    return materialise(V.purged_folds(pool.select("symbol", "bar", "time"), 40, 5, N_FOLDS))


def _by_side(spark, forest, table):
    out = [table(spark, forest, s).withColumn("side", F.lit(s)) for s in SIDES]
    return out[0].unionByName(out[1])


@query("m1_oof_scores")
def m1(spark, sf_dir):
    """Boosted out-of-fold scores of both sides, all twelve models fitted together."""
    data = full_pool(spark, sf_dir)
    return T.out_of_fold(data, _folds(data), FULL_COLS, _sided(), TEACHER)


@query(
    "m5_isotonic_calibration",
    f"""WITH d AS (SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)),
s AS (SELECT n_chars, sum(quality) AS y, count(*) AS w FROM d GROUP BY n_chars),
c AS (SELECT n_chars, row_number() OVER o AS i, sum(y) OVER o AS ys, sum(w) OVER o AS ws, sum(y) OVER o - y AS y0, sum(w) OVER o - w AS w0 FROM s WINDOW o AS (ORDER BY n_chars)),
m AS (SELECT j.i AS j, k.i AS i, min(CAST(k.ys - j.y0 AS DOUBLE) / (k.ws - j.w0)) OVER (PARTITION BY j.i ORDER BY k.i DESC) AS least
  FROM c j JOIN c k ON k.i >= j.i),
g AS (SELECT i, max(least) AS calibrated FROM m GROUP BY i)
SELECT doc_id, n_chars, {r6('calibrated')} AS calibrated FROM d JOIN c USING (n_chars) JOIN g USING (i)""",
)
def m5(spark, sf_dir):
    """Isotonic values; in SQL the greatest over starts of the least mean over ends."""
    df = B.table(spark, sf_dir, "documents").join(B.table(spark, sf_dir, "labels"), "doc_id")
    model = M.fit_isotonic(df, "n_chars", "quality")
    return rounded(M.apply_isotonic(df, model, "n_chars").select("doc_id", "n_chars", "calibrated"), "calibrated")


@query("m6_tree_student")
def m6(spark, sf_dir):
    """Nodes of one tree a side on hard labels: at most 16 leaves, depth 4."""
    forest = T.grow(full_pool(spark, sf_dir), ["symbol", "bar"], FULL_COLS, _side_targets(), T.single_tree())
    return _by_side(spark, forest, T.nodes)


#: Bin edges that SQL can name, for a tree that SQL can grow.
GRID = {c: [round(-1 + 0.1 * k, 1) for k in range(1, 20)] for c in POOL_COLS}
_CASES = " UNION ALL ".join(f"SELECT {i} AS f, '{c}' AS feature, {k} AS b, CAST({e!r} AS DOUBLE) AS threshold" for i, c in enumerate(POOL_COLS) for k, e in enumerate(GRID[c]))


def _split_sql(name, rows):
    """Best split of each node of `rows` (node, y, w in whole parts, x): first feature and edge among the best."""
    return f"""{name}_s AS (SELECT node, f, b, feature, threshold, sum(w) AS h, sum(w * y) AS g, sum(w) FILTER (x[f + 1] <= threshold) AS hl,
  sum(w * y) FILTER (x[f + 1] <= threshold) AS gl, count(*) AS n, count(*) FILTER (x[f + 1] <= threshold) AS nl FROM {rows} CROSS JOIN edges GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) AS r FROM (
  SELECT *, CAST(gl AS DOUBLE) * gl / hl + CAST(g - gl AS DOUBLE) * (g - gl) / (h - hl) - CAST(g AS DOUBLE) * g / h AS gain FROM {name}_s WHERE nl >= 30 AND n - nl >= 30))
  WHERE r = 1 AND gain > 0)"""


M6_SQL = f"""WITH {POOL_SQL}, edges AS ({_CASES}),
r0 AS MATERIALIZED (SELECT 0 AS node, CASE WHEN bottom_tier IN ('strong', 'regular') THEN 1 ELSE 0 END AS y,
  CAST(round((CASE WHEN bottom_tier IN ('strong', 'regular') THEN 1 + bottom_score ELSE 1 END) * {int(T.EXACT)}) AS BIGINT) AS w, [{", ".join(POOL_COLS)}] AS x FROM pool),
{_split_sql("s0", "r0")},
r1 AS MATERIALIZED (SELECT CASE WHEN r0.x[s0.f + 1] <= s0.threshold THEN 1 ELSE 2 END AS node, r0.y, r0.w, r0.x FROM r0, s0),
{_split_sql("s1", "r1")},
pick AS (SELECT * FROM s1 QUALIFY row_number() OVER (ORDER BY gain DESC, node) = 1),
leaf AS (SELECT CASE WHEN p.node IS NULL THEN CAST(r1.node AS VARCHAR) WHEN r1.x[p.f + 1] <= p.threshold THEN r1.node || 'L' ELSE r1.node || 'R' END AS leaf, r1.y, r1.w
  FROM r1 LEFT JOIN pick AS p ON p.node = r1.node)
SELECT leaf, (SELECT feature FROM s0) AS root_feature, (SELECT threshold FROM s0) AS root_threshold, (SELECT feature FROM pick) AS next_feature,
  (SELECT threshold FROM pick) AS next_threshold, count(*) AS n_rows, {r6("CAST(sum(w * y) AS DOUBLE) / sum(w)")} AS pos_share FROM leaf GROUP BY leaf"""


@query("m6_leaf_budget", M6_SQL)
def m6_leaf_budget(spark, sf_dir):
    """The leaves of a tree with a budget of three: the root is split, then the better of its children."""
    edges = [np.array(GRID[c]) for c in POOL_COLS]
    forest = T.grow(materialise(pool(spark, sf_dir)), ["symbol", "bar"], POOL_COLS, [t for t in _side_targets() if t.name == "bottom"], T.single_tree(leaves=3), edges)
    by = {r["node_id"]: r for r in RU.collect_nodes(T.nodes(spark, forest, "bottom"))}
    root = by[0]
    inner = next((by[root[k]] for k in ("left", "right") if not by[root[k]]["is_leaf"]), None)
    rows = []
    for i, side in enumerate(("left", "right")):
        child = by[root[side]]
        rows += [(f"{i + 1}", child)] if child["is_leaf"] else [(f"{i + 1}L", by[child["left"]]), (f"{i + 1}R", by[child["right"]])]
    split = (root["feature"], root["threshold"], inner and inner["feature"], inner and inner["threshold"])
    out = [(leaf, *split, n["n_samples"], n["pos_proba"]) for leaf, n in rows]
    return rounded(spark.createDataFrame(out, "leaf string, root_feature string, root_threshold double, next_feature string, next_threshold double, n_rows long, pos_share double"), "pos_share")


@query("m7_boosted_student")
def m7(spark, sf_dir):
    """Nodes of 40 boosted trees of depth 3 a side."""
    forest = T.grow(full_pool(spark, sf_dir), ["symbol", "bar"], FULL_COLS, _side_targets(), T.small_boost())
    return _by_side(spark, forest, T.nodes)


_TEACH = f"WITH {POOL_SQL} SELECT symbol, time, CASE WHEN 1 / (1 + exp(5 * price_return_L10)) >= 0.6 THEN 1 ELSE 0 END AS pseudo_y, {r6('abs(1 / (1 + exp(5 * price_return_L10)) - 0.5)')} AS pseudo_weight FROM pool"


def _teacher(df):
    return df.withColumn("proba", 1.0 / (1.0 + F.exp(5.0 * F.col("price_return_L10"))))


@query("m8_pseudo_labels", _TEACH)
def m8(spark, sf_dir):
    df = M.pseudo_labels(_teacher(pool(spark, sf_dir)), "proba", 0.6)
    return rounded(df.select("symbol", "time", "pseudo_y", "pseudo_weight"), "pseudo_weight")


def _distilled(rows, cols):
    """Tree fitted to the decisions of a teacher, and its rows."""
    data = M.pseudo_labels(_teacher(rows), "proba", 0.6)
    return T.grow(data, ["symbol", "bar"], cols, [T.Target("student", F.col("pseudo_y"), F.col("pseudo_weight"))], T.single_tree()), data


@query("m8_distilled_student")
def m8b(spark, sf_dir):
    return T.nodes(spark, _distilled(full_pool(spark, sf_dir), FULL_COLS)[0], "student")


@query("m10_tune_boost")
def m10(spark, sf_dir):
    """Boosts of positives by out-of-fold precision: four boosts, six folds, both sides, fitted together."""
    data = full_pool(spark, sf_dir)
    return T.tune_boosts(data, _folds(data), FULL_COLS, {s: (_label(s), F.col(f"{s}_score")) for s in SIDES}, M.BOOST_GRID)


@query("m12_importance")
def m12(spark, sf_dir):
    forest = T.grow(full_pool(spark, sf_dir), ["symbol", "bar"], FULL_COLS, _side_targets(), TEACHER)
    return _by_side(spark, forest, T.importance)


@query("m13_used_features")
def m13(spark, sf_dir):
    return RU.used_features(T.nodes(spark, _distilled(full_pool(spark, sf_dir), FULL_COLS)[0], "student"))


_EXACT_PARITY = f"WITH {POOL_SQL} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_disagree, true AS exact FROM pool"


@query("m18_rule_parity", _EXACT_PARITY)
def m18(spark, sf_dir):
    """A fitted tree and its SQL rules give the same share and label on every row."""
    forest, data = _distilled(materialise(pool(spark, sf_dir)), POOL_COLS)
    nodes = RU.collect_nodes(T.nodes(spark, forest, "student"))
    share = T.margins(forest).select("symbol", "bar", F.col("margins")["student"].alias("score"))
    scored = RU.score_tree(data.join(share, ["symbol", "bar"]), nodes).withColumn("model_label", (F.col("score") >= 0.5).cast("int"))
    return RU.rule_parity(scored, "model_label", "rule_label", "score", "rule_score").select("n_rows", "n_disagree", "exact")


@query("m18_ensemble_parity", _EXACT_PARITY)
def m18b(spark, sf_dir):
    """Forty boosted trees and their leaf masks give the same margin and label on every row."""
    data = materialise(pool(spark, sf_dir))
    forest = T.grow(data, ["symbol", "bar"], POOL_COLS, _side_targets(), T.small_boost())
    nodes = RU.collect_nodes(T.nodes(spark, forest, "bottom"))
    margin = T.margins(forest).select("symbol", "bar", F.col("margins")["bottom"].alias("score"))
    scored = RU.score_masks(data.join(margin, ["symbol", "bar"]), nodes, float(forest.start[1]), 1.0).withColumn("model_label", (F.col("score") >= 0).cast("int"))
    return RU.rule_parity(scored, "model_label", "rule_label").select("n_rows", "n_disagree", "exact")


# --------------------------------------------------------------------------- rules as parameters


def _leaf(i: int, p: float, v: float, stage: int = 0) -> dict:
    return {"stage": stage, "node_id": i, "is_leaf": True, "feature": None, "threshold": None, "left": None, "right": None,
            "pos_proba": p, "predict": int(p >= 0.5), "value": v, "n_samples": 1}


def _split(i: int, f: str, t: float, left: int, right: int, stage: int = 0) -> dict:
    return {"stage": stage, "node_id": i, "is_leaf": False, "feature": f, "threshold": t, "left": left, "right": right,
            "pos_proba": None, "predict": None, "value": None, "n_samples": 1}


TREE = [
    _split(0, "price_return_L10", -0.2, 1, 4), _split(1, "er_dir_p20", -0.1, 2, 3), _leaf(2, 0.9, 1.0), _leaf(3, 0.6, 0.3),
    _split(4, "price_return_L20", 0.5, 5, 6), _leaf(5, 0.1, -1.0), _leaf(6, 0.55, 0.1),
]
ENSEMBLE = [
    *[{**n, "pos_proba": None} for n in TREE],
    _split(0, "er_dir_p10", 0.0, 1, 2, 1), {**_leaf(1, 0.0, 0.4, 1), "pos_proba": None}, {**_leaf(2, 0.0, -0.2, 1), "pos_proba": None},
]
_tree = RU.rules_to_sql(TREE)
_ens = RU.rules_to_sql(ENSEMBLE, 0.45, -0.1, 0.5)


@query("m15_rules_to_expression", f"WITH {POOL_SQL} SELECT symbol, time, {_tree['label']} AS rule_label FROM pool")
def m15(spark, sf_dir):
    return pool(spark, sf_dir).select("symbol", "time", RU.rules_to_column(TREE)["label"].alias("rule_label"))


@query("m16_score_tree", f"WITH {POOL_SQL} SELECT symbol, time, {_tree['score']} AS rule_score, {_tree['label']} AS rule_label FROM pool")
def m16(spark, sf_dir):
    return RU.score_tree(pool(spark, sf_dir), TREE).select("symbol", "time", "rule_score", "rule_label")


@query("m17_score_ensemble", f"WITH {POOL_SQL} SELECT symbol, time, {r6(_ens['score'])} AS rule_score, {_ens['label']} AS rule_label FROM pool")
def m17(spark, sf_dir):
    out = RU.score_ensemble(pool(spark, sf_dir), ENSEMBLE, -0.1, 0.5, 0.45).select("symbol", "time", "rule_score", "rule_label")
    return rounded(out, "rule_score")


_LEAF = """CASE WHEN price_return_L10 <= -0.2 THEN CASE WHEN er_dir_p20 <= -0.1 THEN 2 ELSE 3 END
  ELSE CASE WHEN price_return_L20 <= 0.5 THEN 5 ELSE 6 END END"""


@query("j10_node_walk", f"WITH {POOL_SQL} SELECT symbol, time, {_LEAF} AS leaf_id FROM pool")
def j10(spark, sf_dir):
    nodes = spark.createDataFrame([tuple(n.values()) for n in TREE], RU.NODE_SCHEMA)
    feats = ["price_return_L10", "price_return_L20", "er_dir_p20"]
    return RU.walk_nodes(pool(spark, sf_dir).select("symbol", "time", *feats), nodes, feats, 2).select("symbol", "time", "leaf_id")


@query("o8_rule_features", f"""WITH {POOL_SQL}, n AS (SELECT count(*) AS c FROM pool), f AS (SELECT * FROM (VALUES ('price_return_L10', 1), ('er_dir_p20', 2), ('price_return_L20', 3)) t(feature, first_use))
SELECT feature, CAST(first_use AS INTEGER) AS first_use, {r6('(SELECT avg(CASE WHEN price_return_L10 <= -0.2 THEN 1.0 ELSE 0.0 END) FROM pool)')} AS root_left_share FROM f""")
def o8(spark, sf_dir):
    """Features of a rule table in order of first use, with the share of rows that go left at the root."""
    nodes = spark.createDataFrame([tuple(n.values()) for n in TREE], RU.NODE_SCHEMA)
    share = pool(spark, sf_dir).agg(F.avg((F.col("price_return_L10") <= -0.2).cast("double"))).scalar()
    return rounded(RU.used_features(nodes).withColumn("root_left_share", share), "root_left_share")


_pa = Q.chain(Q.merge(Q.momentum(10), Q.momentum(20)), "bars", "pa")
_pb = Q.chain(Q.merge(Q.momentum(10), Q.momentum(20)), "coarse", "pb")
_PAIR = f"""{SUPP}, coarse AS (SELECT * REPLACE (round(close, -2) AS close) FROM bars),\n{_pa[0]},\n{_pb[0]},
j AS (SELECT symbol, time, 'price_return_L10' AS feature, a.price_return_L10 AS a, b.price_return_L10 AS b, CAST(0 AS DOUBLE) AS thr FROM {_pa[1]} a JOIN {_pb[1]} b USING (symbol, time)
  UNION ALL SELECT symbol, time, 'price_return_L20', a.price_return_L20, b.price_return_L20, CAST(0.5 AS DOUBLE) FROM {_pa[1]} a JOIN {_pb[1]} b USING (symbol, time))"""


@query(
    "m19_feature_parity",
    f"""WITH {_PAIR} SELECT feature, count(*) AS n, {r6('max(abs(a - b))')} AS max_abs_diff, {r6('corr(a, b)')} AS corr,
  CAST(sum(CASE WHEN (a > thr) <> (b > thr) THEN 1 ELSE 0 END) AS BIGINT) AS n_flips FROM j WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY feature""",
)
def m19(spark, sf_dir):
    """Features of exact and of rounded closes: how far apart, how correlated, how many decisions flip."""
    bars, lay = B.bars_supp(spark, sf_dir)
    specs = [X.price_return(10), X.price_return(20)]
    exact = compute(bars, specs, **lay)
    coarse = compute(bars.withColumn("close", F.round("close", -2)), specs, **lay)
    feats = ["price_return_L10", "price_return_L20"]
    return rounded(RU.feature_parity(exact, coarse, feats, {"price_return_L20": 0.5}), "max_abs_diff", "corr")


@query("j6_two_sources", f"WITH {_PAIR} SELECT symbol, time, feature, {r6('a')} AS a, {r6('b')} AS b FROM j WHERE feature = 'price_return_L10'")
def j6(spark, sf_dir):
    bars, lay = B.bars_supp(spark, sf_dir)
    a = compute(bars, [X.price_return(10, "a")], **lay).select("symbol", "time", "a")
    b = compute(bars.withColumn("close", F.round("close", -2)), [X.price_return(10, "b")], **lay).select("symbol", "time", "b")
    out = a.join(b, ["symbol", "time"]).withColumn("feature", F.lit("price_return_L10"))
    return rounded(out, "a", "b")


@query("j2_flag_membership", f"WITH {SUPP}, p AS (SELECT symbol, time FROM bars WHERE volume > 40) SELECT b.symbol, b.time, p.time IS NOT NULL AS flagged FROM bars b LEFT JOIN p ON p.symbol = b.symbol AND p.time = b.time")
def j2(spark, sf_dir):
    bars, _ = B.bars_supp(spark, sf_dir)
    hits = bars.filter("volume > 40").select("symbol", "time", F.lit(True).alias("_f"))
    return bars.select("symbol", "time").join(hits, ["symbol", "time"], "left").select("symbol", "time", F.coalesce("_f", F.lit(False)).alias("flagged"))


@query("j9_absent_symbols", f"WITH {SUPP} SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier WHERE CAST(s_suppkey AS VARCHAR) NOT IN (SELECT symbol FROM bars WHERE volume > 95)")
def j9(spark, sf_dir):
    bars, _ = B.bars_supp(spark, sf_dir)
    asked = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))
    return asked.join(bars.filter("volume > 95").select("symbol"), "symbol", "left_anti")
