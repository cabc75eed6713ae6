"""Event matching, ranking metrics, overfitting statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as C
from tidemark.layout import DAY, compute
from tidemark.operators import events as EV
from tidemark.operators import features as X
from tidemark.operators import labels as L
from tidemark.operators import metrics as M
from tidemark.operators import overfit as O
from tidemark.operators import ranking as R
from tidemark.plans import base as B
from tidemark.plans import sqltext as Q
from tidemark.plans.base import SUPP, query, r6, rounded
from tidemark.plans.q_labels_splits import LOOSE, folds_sql, labels_sql, prf_sql, _indexed, H, E, K
from tidemark.operators import splits as V

TOL = 3
DROP = -0.4

# --------------------------------------------------------------------------- events

_mt, _ml = Q.chain(Q.merge(Q.momentum(10)))
_lt, _ll = labels_sql(LOOSE, _ml)
SCORED = f"{SUPP},\n{_mt},\n{_lt},\nscored AS (SELECT *, coalesce(price_return_L10 < {Q.d(DROP)}, false) AS is_pred, bottom_tier <> 'none' AS is_true FROM {_ll})"


def greedy_sql(src: str, keys: str, tol: int = TOL) -> str:
    """CTEs ending in `counts`(keys, tp, fp, fn): earliest-first matching walked pair by pair."""
    return f"""lists AS (
  SELECT {keys}, coalesce(list(bar ORDER BY bar) FILTER (WHERE is_pred), []) AS p,
         coalesce(list(bar ORDER BY bar) FILTER (WHERE is_true), []) AS t
  FROM {src} WHERE is_pred OR is_true GROUP BY {keys}),
walk AS (
  SELECT {keys}, p, t, 1 AS i, 1 AS j, 0 AS m FROM lists
  UNION ALL
  SELECT {keys}, p, t,
    CASE WHEN abs(p[i] - t[j]) <= {tol} OR p[i] < t[j] THEN i + 1 ELSE i END,
    CASE WHEN abs(p[i] - t[j]) <= {tol} OR p[i] > t[j] THEN j + 1 ELSE j END,
    CASE WHEN abs(p[i] - t[j]) <= {tol} THEN m + 1 ELSE m END
  FROM walk WHERE i <= len(p) AND j <= len(t)),
counts AS (
  SELECT {keys}, CAST(max(m) AS BIGINT) AS tp, CAST(max(len(p)) - max(m) AS BIGINT) AS fp,
         CAST(max(len(t)) - max(m) AS BIGINT) AS fn FROM walk GROUP BY {keys})"""


def scored(spark, sf_dir):
    """Bars with a prediction flag (deep 10-bar fall) and a label flag (bottom turn)."""
    bars, lay = B.bars_supp(spark, sf_dir)
    df = L.with_tiers(compute(bars, [X.price_return(10), *L.label_specs(LOOSE)], **lay), LOOSE)
    return df.withColumns(
        {"is_pred": F.coalesce(F.col("price_return_L10") < DROP, F.lit(False)), "is_true": F.col("bottom_tier") != "none"}
    )


def _events(spark, sf_dir, by=()):
    return EV.to_events(scored(spark, sf_dir), F.col("is_pred"), F.col("is_true"), by)


@query("e1_match_counts", f"WITH RECURSIVE {SCORED},\n{greedy_sql('scored', 'symbol')} SELECT * FROM counts")
def e1(spark, sf_dir):
    return EV.match_counts(_events(spark, sf_dir), TOL)


@query("e1_match_counts_segmented", f"WITH RECURSIVE {SCORED},\n{greedy_sql('scored', 'symbol', 9)} SELECT * FROM counts")
def e1b(spark, sf_dir):
    """Short segments force many hand-overs between them; the result must not change."""
    return EV.match_counts(_events(spark, sf_dir), 9, segment_bars=16)


@query("e2_match_distance")
def e2(spark, sf_dir):
    """Matched pairs of least total distance; brute force in the tests."""
    return EV.match_pairs(_events(spark, sf_dir), TOL)


@query(
    "e2_match_totals",
    f"WITH RECURSIVE {SCORED},\n{greedy_sql('scored', 'symbol')} SELECT symbol, tp AS n_pairs FROM counts WHERE tp > 0",
)
def e2b(spark, sf_dir):
    """Least-distance matchings are as large as the greedy one."""
    return EV.match_pairs(_events(spark, sf_dir), TOL).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_pairs"))


def least_distance_sql(src: str, tol: int = TOL) -> str:
    """CTEs ending in `least`(symbol, n_pairs, distance): best values over the truths, carried on by each prediction."""
    card = 1_000_000
    return f"""lists AS (
  SELECT symbol, coalesce(list(bar ORDER BY bar) FILTER (WHERE is_pred), []) AS p,
         coalesce(list(bar ORDER BY bar) FILTER (WHERE is_true), []) AS t FROM {src} WHERE is_pred OR is_true GROUP BY symbol),
walk AS (
  SELECT symbol, p, t, 0 AS i, list_transform(range(len(t) + 1), lambda x: CAST(0 AS BIGINT)) AS v FROM lists
  UNION ALL
  SELECT symbol, p, t, i, list_transform(range(1, len(c) + 1), lambda k: list_max(c[1:k])) FROM (
    SELECT symbol, p, t, i + 1 AS i, list_transform(range(1, len(t) + 2), lambda j:
      CASE WHEN j > 1 AND abs(p[i + 1] - t[j - 1]) <= {tol} THEN greatest(v[j], v[j - 1] + {card} - abs(p[i + 1] - t[j - 1])) ELSE v[j] END) AS c
    FROM walk WHERE i < len(p))),
least AS (SELECT symbol, CAST(ceil(v[len(t) + 1] / {card}) AS BIGINT) AS n_pairs, v[len(t) + 1] AS total FROM walk WHERE i = len(p))"""


@query(
    "e2_least_distance",
    f"WITH RECURSIVE {SCORED},\n{least_distance_sql('scored')} SELECT symbol, n_pairs, CAST(n_pairs * 1000000 - total AS BIGINT) AS distance FROM least WHERE n_pairs > 0",
)
def e2c(spark, sf_dir):
    """Pairs and their total distance per series; which pairs reach it is not unique."""
    found = EV.match_pairs(_events(spark, sf_dir), TOL).groupBy("symbol")
    return found.agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("delta").alias("distance"))


_POOL = "SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM counts"


@query("e3_event_prf", f"WITH RECURSIVE {SCORED},\n{greedy_sql('scored', 'symbol')}, s AS ({_POOL}) SELECT tp, fp, fn, {prf_sql()} FROM s")
def e3(spark, sf_dir):
    return rounded(EV.event_prf(_events(spark, sf_dir), TOL), "precision", "recall", "f1")


_SLICES = f"""{SCORED},
tagged AS (SELECT *, CASE WHEN time < 946684800 THEN 'early' ELSE 'late' END AS era FROM scored),
{greedy_sql('tagged', 'era, symbol')},
sl AS (
  SELECT era, symbol, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn
  FROM counts GROUP BY GROUPING SETS ((era, symbol), (era), ()))"""
CUT = 946_684_800  # 2000-01-01, inside the span of the ticks


def _era(df):
    return df.withColumn("era", F.when(F.col("time") < CUT, "early").otherwise("late"))


@query(
    "e4_slice_scores",
    f"WITH RECURSIVE {_SLICES} SELECT coalesce(era, 'all') AS era, coalesce(symbol, 'all') AS asset, tp, fp, fn, {prf_sql()}, tp + fp AS n_pred, tp + fn AS n_true FROM sl",
)
def e4(spark, sf_dir):
    ev = EV.to_events(_era(scored(spark, sf_dir)), F.col("is_pred"), F.col("is_true"), ["era"])
    return rounded(M.slice_scores(ev, TOL, ["era"]), "precision", "recall", "f1")


@query(
    "e4_mean_fold_f1",
    f"""WITH RECURSIVE {_SLICES}, f AS (SELECT era, {prf_sql()} FROM sl WHERE era IS NOT NULL AND symbol IS NULL)
    SELECT {r6('avg(f1)', 5)} AS mean_f1, CAST(count(*) AS BIGINT) AS n_slices FROM f""",
)
def e4b(spark, sf_dir):
    ev = EV.to_events(_era(scored(spark, sf_dir)), F.col("is_pred"), F.col("is_true"), ["era"])
    per = EV.event_prf(ev, TOL, ["era"])
    return rounded(per.agg(F.avg("f1").alias("mean_f1"), F.count(F.lit(1)).alias("n_slices")), "mean_f1", digits=5)


@query(
    "e5_label_balance",
    f"""WITH {SCORED}, u AS (
  SELECT symbol, 'top' AS side, top_tier AS tier FROM scored UNION ALL SELECT symbol, 'bottom', bottom_tier FROM scored)
SELECT coalesce(symbol, 'all') AS symbol, coalesce(side, 'both') AS side, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN tier = 'strong' THEN 1 ELSE 0 END) AS BIGINT) AS n_strong,
  CAST(sum(CASE WHEN tier = 'regular' THEN 1 ELSE 0 END) AS BIGINT) AS n_regular,
  CAST(sum(CASE WHEN tier <> 'none' THEN 1 ELSE 0 END) AS BIGINT) AS n_positive,
  {r6("avg(CASE WHEN tier <> 'none' THEN 1.0 ELSE 0.0 END)")} AS positive_rate
FROM u GROUP BY CUBE (symbol, side)""",
)
def e5(spark, sf_dir):
    return rounded(M.label_balance(scored(spark, sf_dir)), "positive_rate")


# --------------------------------------------------------------------------- ranking on documents


def _docs(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").join(B.table(spark, sf_dir, "labels"), "doc_id")
    return d.select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("y"),
        (F.lit(1.0) + F.col("toxic")).alias("w"),
    )


_DOCS = """d AS (SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS score, quality AS y, CAST(1.0 + toxic AS DOUBLE) AS w
  FROM documents JOIN labels USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rk FROM d)"""


def ap_sql(src: str, w: str, by: str = "", name: str = "ap") -> str:
    """CTE `name` with the average precision per group."""
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}," if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"""{name}_s AS (SELECT {lead} score, sum({w} * y) AS tp, sum({w}) AS al FROM {src} GROUP BY {lead} score),
{name}_c AS (SELECT *, sum(tp) OVER ({part} ORDER BY score DESC) AS ctp, sum(al) OVER ({part} ORDER BY score DESC) AS cal FROM {name}_s),
{name} AS (SELECT {lead} coalesce(sum(tp * ctp / NULLIF(cal, 0)) / NULLIF(sum(tp), 0), 0) AS v FROM {name}_c {tail})"""


@query("e6_average_precision", f"WITH {_DOCS},\n{ap_sql('d', 'CAST(1 AS DOUBLE)')} SELECT {r6('v')} AS average_precision FROM ap")
def e6(spark, sf_dir):
    return rounded(R.average_precision(_docs(spark, sf_dir), "score", "y"), "average_precision")


@query("e6_average_precision_weighted", f"WITH {_DOCS},\n{ap_sql('d', 'w', 'lang')} SELECT lang, {r6('v')} AS average_precision FROM ap")
def e6b(spark, sf_dir):
    return rounded(R.average_precision(_docs(spark, sf_dir), "score", "y", "w", ["lang"]), "average_precision")


@query("e7_precision_at_k", f"WITH {_DOCS} SELECT {r6('sum(y) / 25.0')} AS precision_at_k FROM ranked WHERE rk <= 25")
def e7(spark, sf_dir):
    return rounded(R.precision_at_k(_docs(spark, sf_dir), "score", "y", 25, "doc_id"), "precision_at_k")


@query("e8_recall_at_k", f"WITH {_DOCS} SELECT {r6('sum(CASE WHEN rk <= 25 THEN y ELSE 0 END) / CAST(sum(y) AS DOUBLE)')} AS recall_at_k FROM ranked")
def e8(spark, sf_dir):
    return rounded(R.recall_at_k(_docs(spark, sf_dir), "score", "y", 25, "doc_id"), "recall_at_k")


@query("e9_lift_at_k", f"WITH {_DOCS} SELECT {r6('(sum(CASE WHEN rk <= 25 THEN y ELSE 0 END) / CAST(25 AS DOUBLE)) / avg(y)')} AS lift_at_k FROM ranked")
def e9(spark, sf_dir):
    return rounded(R.lift_at_k(_docs(spark, sf_dir), "score", "y", 25, "doc_id"), "lift_at_k")


@query("o2_top_k", f"WITH {_DOCS} SELECT doc_id, score FROM ranked WHERE rk <= 25")
def o2(spark, sf_dir):
    return R.top_k(_docs(spark, sf_dir), "score", "doc_id", 25).select("doc_id", "score")


_AT_K = f"""{SCORED},
best AS (SELECT symbol, bar, row_number() OVER (ORDER BY -coalesce(price_return_L10, 0) DESC, symbol, bar) AS rk FROM scored),
sel AS (SELECT s.symbol, s.bar, b.rk <= 50 AS is_pred, s.is_true FROM scored s JOIN best b USING (symbol, bar)),
{greedy_sql('sel', 'symbol')}"""


def _fall(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("fall", -F.coalesce("price_return_L10", F.lit(0.0)))


@query("e10_precision_at_k_event", f"WITH RECURSIVE {_AT_K} SELECT {r6('sum(tp) / 50.0')} AS precision_at_k FROM counts")
def e10(spark, sf_dir):
    return rounded(R.precision_at_k_event(_fall(spark, sf_dir), "fall", "is_true", 50, TOL), "precision_at_k")


@query("e11_recall_at_k_event", f"WITH RECURSIVE {_AT_K} SELECT {r6('sum(tp) / CAST(sum(tp + fn) AS DOUBLE)')} AS recall_at_k FROM counts")
def e11(spark, sf_dir):
    return rounded(R.recall_at_k_event(_fall(spark, sf_dir), "fall", "is_true", 50, TOL), "recall_at_k")


@query(
    "e12_rank_slice",
    f"""WITH {_DOCS},\n{ap_sql('d', 'CAST(1 AS DOUBLE)', 'lang')},\n{ap_sql('d', 'w', 'lang', 'apw')},
st AS (SELECT lang, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_true FROM d GROUP BY lang),
rk AS (SELECT lang, y, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS r FROM d),
h AS (SELECT lang, n, n_true, sum(CASE WHEN r <= least(25, n) THEN y ELSE 0 END) AS h25,
      sum(CASE WHEN r <= least(greatest(n_true, 1), n) THEN y ELSE 0 END) AS ht,
      CAST(least(25, n) AS DOUBLE) AS k25, CAST(least(greatest(n_true, 1), n) AS DOUBLE) AS kt
      FROM rk JOIN st USING (lang) GROUP BY lang, n, n_true)
SELECT lang, n, n_true, {r6('ap.v')} AS ap, {r6('apw.v')} AS ap_weighted, {r6('h25 / k25')} AS p_at_25,
  {r6('h25 / CAST(n_true AS DOUBLE)')} AS r_at_25, {r6('(h25 / k25) / (n_true / CAST(n AS DOUBLE))')} AS lift_at_25,
  {r6('ht / kt')} AS p_at_ntrue, {r6('ht / CAST(n_true AS DOUBLE)')} AS r_at_ntrue,
  {r6('(ht / kt) / (n_true / CAST(n AS DOUBLE))')} AS lift_at_ntrue
FROM h JOIN ap USING (lang) JOIN apw USING (lang) WHERE n_true > 0""",
)
def e12(spark, sf_dir):
    out = R.rank_slice(_docs(spark, sf_dir), "score", "y", "w", ["doc_id"], ["lang"])
    cols = [c for c in out.columns if c not in ("lang", "n", "n_true")]
    return rounded(out, *cols)


# --------------------------------------------------------------------------- deflation


def horner_sql(coefs, x: str) -> str:
    acc = Q.d(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc} * {x} + {Q.d(c)})"
    return acc


def cdf_sql(z: str) -> str:
    a = f"abs({z})"
    e = f"exp(-{a} * {a} / 2)"
    far = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        far = f"({a} + {Q.d(float(k))} / {far})"
    tail = f"CASE WHEN {a} < {Q.d(C.CDF_SPLIT)} THEN {e} * {horner_sql(C.CDF_NUM, a)} / {horner_sql(C.CDF_DEN, a)} ELSE {e} / {far} / {Q.d(C.SQRT_2PI)} END"
    return f"CASE WHEN {z} > 0 THEN 1 - ({tail}) ELSE {tail} END"


def ppf_sql(p: str) -> str:
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"

    def tail(u: str) -> str:
        t = f"sqrt(-2 * ln({u}))"
        return f"{horner_sql(C.PPF_C, t)} / {horner_sql(C.PPF_D, t)}"

    mid = f"{horner_sql(C.PPF_A, r)} * {q} / {horner_sql(C.PPF_B, r)}"
    return f"CASE WHEN {p} < {Q.d(C.PPF_LOW)} THEN {tail(p)} WHEN {p} > 1 - {Q.d(C.PPF_LOW)} THEN -({tail('(1 - ' + p + ')')}) ELSE {mid} END"


_EMS = f"""CASE WHEN n_trials <= 1 OR trials_std = 0 THEN {Q.d(0.0)} ELSE trials_std * ({Q.d(1 - C.EULER_GAMMA)} *
({ppf_sql('p1')}) + {Q.d(C.EULER_GAMMA)} * ({ppf_sql('p2')})) END"""
# one trial table row per supplier nation: orders shipped as observations, discount as outcome
_TRIALS = f"""raw_t AS (
  SELECT s_nationkey AS config, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_trials, CAST(count(*) AS BIGINT) AS n_obs,
    avg(l_discount) AS m1, avg(l_discount * l_discount) AS m2, avg(l_discount * l_discount * l_discount) AS m3,
    avg(l_discount * l_discount * l_discount * l_discount) AS m4
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
mom AS (SELECT *, sqrt(m2 - m1 * m1) AS sd FROM raw_t),
trials AS (
  SELECT config, n_trials, n_obs, m1 / sd / 10 AS observed, sd AS trials_std,
    (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / (sd * sd * sd) AS skew,
    (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1) / (sd * sd * sd * sd) AS kurt,
    1 - 1 / CAST(n_trials AS DOUBLE) AS p1, 1 - 1 / (n_trials * exp(CAST(1 AS DOUBLE))) AS p2
  FROM mom),
ems AS (SELECT *, {_EMS} AS bench FROM trials),
zs AS (SELECT *, 1 - skew * observed + (kurt - 1) / 4 * observed * observed AS var_term FROM ems)"""


def trials(spark, sf_dir):
    """(config, n_trials, n_obs, observed, trials_std, skew, kurt) per supplier nation."""
    li = B.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_discount")
    su = B.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # map-side partial sums per supplier first, so the join sees one row per supplier
    x = F.col("l_discount")
    per = li.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.pow(x, F.lit(float(k)))).alias(f"s{k}") for k in (1, 2, 3, 4)]
    )
    t = per.join(su, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("config")).agg(
        F.count(F.lit(1)).alias("n_trials"), F.sum("n").alias("n_obs"), *[F.sum(f"s{k}").alias(f"s{k}") for k in (1, 2, 3, 4)]
    )
    m1, m2, m3, m4 = (F.col(f"s{k}") / F.col("n_obs") for k in (1, 2, 3, 4))
    sd = F.sqrt(m2 - m1 * m1)
    return t.select(
        "config", "n_trials", "n_obs", (m1 / sd / 10.0).alias("observed"), sd.alias("trials_std"),
        ((m3 - 3.0 * m1 * m2 + 2.0 * m1 * m1 * m1) / (sd * sd * sd)).alias("skew"),
        ((m4 - 4.0 * m1 * m3 + 6.0 * m1 * m1 * m2 - 3.0 * m1 * m1 * m1 * m1) / (sd * sd * sd * sd)).alias("kurt"),
    )


@query("e13_expected_max_sharpe", f"WITH {_TRIALS} SELECT config, n_trials, {r6('bench', 8)} AS expected_max FROM ems")
def e13(spark, sf_dir):
    t = trials(spark, sf_dir)
    e = C.expected_max_sharpe(F.col("n_trials"), F.col("trials_std")).alias("expected_max")
    return rounded(t.select("config", "n_trials", e), "expected_max", digits=8)


_Z = "(observed - bench) * sqrt(CAST(n_obs AS DOUBLE) - 1) / sqrt(var_term)"


@query("e14_probabilistic_sharpe", f"WITH {_TRIALS}, z AS (SELECT *, (observed - 0.1) * sqrt(CAST(n_obs AS DOUBLE) - 1) / sqrt(var_term) AS z FROM zs) SELECT config, {r6(cdf_sql('z'))} AS psr FROM z")
def e14(spark, sf_dir):
    p = C.probabilistic_sharpe_ratio(F.col("observed"), F.lit(0.1), F.col("n_obs"), F.col("skew"), F.col("kurt"))
    return rounded(trials(spark, sf_dir).select("config", p.alias("psr")), "psr")


@query("e15_deflated_metric", f"WITH {_TRIALS}, z AS (SELECT *, {_Z} AS z FROM zs) SELECT config, {r6('observed - bench')} AS haircut, {r6(cdf_sql('z'))} AS deflated FROM z")
def e15(spark, sf_dir):
    a = (F.col("observed"), F.col("n_trials"), F.col("trials_std"))
    out = trials(spark, sf_dir).select(
        "config", C.deflated_metric(*a).alias("haircut"),
        C.deflated_metric(*a, F.col("n_obs"), F.col("skew"), F.col("kurt")).alias("deflated"),
    )
    return rounded(out, "haircut", "deflated")


# --------------------------------------------------------------------------- overfitting

WEEK = 7 * DAY
S_BLOCKS = 10
_PERF = f"""perf AS (
  SELECT CAST(floor(epoch(l_shipdate) / {WEEK}) AS BIGINT) AS t, s_nationkey AS config, avg(l_discount) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
times AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM perf)),
kept AS (SELECT t, CAST(i // (n // {S_BLOCKS}) AS INTEGER) AS block FROM times WHERE i < (n // {S_BLOCKS}) * {S_BLOCKS}),
combos AS (SELECT m, row_number() OVER (ORDER BY m) AS combo FROM (SELECT CAST(range AS INTEGER) AS m FROM range({1 << S_BLOCKS})) WHERE bit_count(m) = {S_BLOCKS // 2}),
blocked AS (SELECT config, block, value FROM perf JOIN kept USING (t)),
sides AS (
  SELECT combo, config, (m >> block) & 1 AS inside, avg(value) AS mean, stddev_samp(value) AS sd
  FROM blocked CROSS JOIN combos GROUP BY 1, 2, 3),
sc AS (SELECT combo, config, inside, CASE WHEN sd > 0 THEN mean / sd ELSE mean END AS v FROM sides),
tab AS (SELECT a.combo, a.config, a.v AS is_perf, b.v AS oos_perf FROM sc a JOIN sc b USING (combo, config) WHERE a.inside = 1 AND b.inside = 0),
best AS (SELECT combo, arg_max(config, ROW(round(is_perf, 12), -config)) AS best_config FROM tab GROUP BY combo),
refs AS (SELECT b.combo, b.best_config, t.oos_perf AS ref FROM best b JOIN tab t ON t.combo = b.combo AND t.config = b.best_config),
rk AS (SELECT r.combo, r.best_config, sum(CASE WHEN t.oos_perf < r.ref THEN 1 ELSE 0 END) AS less,
  sum(CASE WHEN t.oos_perf = r.ref THEN 1 ELSE 0 END) AS eq, count(*) AS n FROM refs r JOIN tab t USING (combo) GROUP BY 1, 2),
om AS (SELECT *, (less + (eq + 1) / CAST(2 AS DOUBLE)) / (n + 1) AS w FROM rk)"""


def perf(spark, sf_dir):
    """(t, config, value): weekly mean discount per supplier nation."""
    li = B.table(spark, sf_dir, "lineitem")
    su = B.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    t = F.floor(B.epoch_seconds(li, "l_shipdate") / F.lit(WEEK)).alias("t")
    per = li.groupBy("l_suppkey", t).agg(F.sum("l_discount").alias("s"), F.count(F.lit(1)).alias("n"))
    j = per.join(su, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("t", F.col("s_nationkey").alias("config")).agg((F.sum("s") / F.sum("n")).alias("value"))


@query("e16_pbo_cscv", f"WITH {_PERF} SELECT {r6('avg(CASE WHEN ln(w / (1 - w)) <= 0 THEN 1.0 ELSE 0.0 END)')} AS pbo, count(*) AS n_combos FROM om")
def e16(spark, sf_dir):
    return rounded(O.pbo_cscv(perf(spark, sf_dir), S_BLOCKS), "pbo")


@query("e16_pbo_rank_counts", f"WITH {_PERF} SELECT best_config, count(*) AS n_combos, {r6('avg(ln(w / (1 - w)))')} AS mean_logit FROM om GROUP BY 1")
def e16b(spark, sf_dir):
    g = O.pbo_logits(perf(spark, sf_dir), S_BLOCKS).groupBy("best_config")
    return rounded(g.agg(F.count(F.lit(1)).alias("n_combos"), F.avg("logit").alias("mean_logit")), "mean_logit")


# --------------------------------------------------------------------------- reports


@query(
    "e17_scorecard",
    f"""WITH RECURSIVE {_SLICES} SELECT 'bottom' AS side, coalesce(symbol, 'all') AS asset, coalesce(era, 'all') AS era, tp, fp, fn,
    {prf_sql()}, CAST(NULL AS DOUBLE) AS deflated FROM sl""",
)
def e17(spark, sf_dir):
    ev = EV.to_events(_era(scored(spark, sf_dir)), F.col("is_pred"), F.col("is_true"), ["era"])
    card = M.scorecard(M.slice_scores(ev, TOL, ["era"]).withColumn("side", F.lit("bottom")))
    return rounded(card, "precision", "recall", "f1")


@query("e18_agreement_rate", f"WITH {SCORED} SELECT {r6('avg(CASE WHEN is_pred = is_true THEN 1.0 ELSE 0.0 END)')} AS fidelity, count(*) AS n FROM scored")
def e18(spark, sf_dir):
    return rounded(M.agreement_rate(scored(spark, sf_dir), "is_pred", "is_true"), "fidelity")


@query(
    "e19_compare_to_baseline",
    f"""WITH RECURSIVE {_SLICES}, f AS (SELECT era, symbol, {prf_sql()} FROM sl),
a AS (SELECT symbol, f1 FROM f WHERE era = 'late' AND symbol IS NOT NULL),
b AS (SELECT symbol, f1 FROM f WHERE era = 'early' AND symbol IS NOT NULL)
SELECT a.symbol, a.f1 AS f1, b.f1 AS baseline_f1, {r6('a.f1 - b.f1')} AS delta,
  CASE WHEN a.f1 > b.f1 THEN 'better' WHEN a.f1 < b.f1 THEN 'worse' ELSE 'equal' END AS verdict
FROM a JOIN b USING (symbol)""",
)
def e19(spark, sf_dir):
    ev = EV.to_events(_era(scored(spark, sf_dir)), F.col("is_pred"), F.col("is_true"), ["era"])
    s = rounded(EV.match_counts(ev, TOL, ["era"]).transform(C.with_prf), "f1")
    late, early = (s.filter(F.col("era") == e).select("symbol", "f1") for e in ("late", "early"))
    return rounded(M.compare_to_baseline(late, early, ["symbol"], "f1"), "delta")


_TS = f"""{folds_sql()},\n{_mt},\n{_lt},
sc AS (SELECT f.fold, x.symbol, x.bar, -x.price_return_L10 AS score, x.bottom_tier <> 'none' AS is_true
  FROM folds f JOIN {_ll} x ON x.symbol = f.symbol AND x.bar = f.bar WHERE f.role = 'train' AND x.price_return_L10 IS NOT NULL)"""


def fold_scores(spark, sf_dir):
    df = scored(spark, sf_dir).select("symbol", "bar", "time", (-F.col("price_return_L10")).alias("score"), "is_true")
    folds = V.purged_folds(df, H, E, K, carry=("score", "is_true")).filter("role = 'train' and score is not null")
    return folds.select("fold", "symbol", "bar", "score", "is_true")


@query("e20_threshold_candidates", f"WITH {_TS}, q AS (SELECT fold, unnest(quantile_cont(score, [0.0, 0.25, 0.5, 0.75, 1.0])) AS value, unnest(range(5)) AS prob_index FROM sc GROUP BY fold) SELECT fold, CAST(prob_index AS INTEGER) AS prob_index, {r6('value')} AS value FROM q")
def e20a(spark, sf_dir):
    q = R.quantiles(fold_scores(spark, sf_dir), ["fold"], "score", [0.0, 0.25, 0.5, 0.75, 1.0])
    return rounded(q.select("fold", "prob_index", "value"), "value")


GRID = 50
_THRESHOLDS = f"""{_TS},
cand AS (
  SELECT fold, unnest(quantile_cont(score, {[i / (GRID - 1) for i in range(GRID)]})) AS thr FROM sc GROUP BY fold
  UNION SELECT fold, max(score) * CAST('0.99999999999999988898' AS DOUBLE) FROM sc GROUP BY fold),
marked AS MATERIALIZED (SELECT c.fold, c.thr, s.symbol, s.bar, s.score >= c.thr AS is_pred, s.is_true FROM sc s JOIN cand c USING (fold)),
{greedy_sql('marked', 'fold, thr, symbol')},
pooled AS (SELECT fold, thr, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM counts GROUP BY 1, 2),
f AS (SELECT fold, thr, CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) AS f1 FROM pooled)"""


@query(
    "e20_tune_threshold",
    f"""WITH RECURSIVE {_THRESHOLDS}
SELECT fold, {r6('arg_max(thr, ROW(f1, thr))')} AS threshold, {r6('max(f1)')} AS f1 FROM f GROUP BY fold""",
)
def e20(spark, sf_dir):
    """Best train threshold per fold; SQL matches anew for each threshold."""
    return rounded(M.tune_threshold(fold_scores(spark, sf_dir), TOL, GRID, ["fold"]), "threshold", "f1")


@query("e21_constant_score_check", f"WITH {_DOCS} SELECT lang, {r6('max(score) - min(score)')} AS spread, max(score) - min(score) < 1e-9 AS is_constant FROM d GROUP BY lang")
def e21(spark, sf_dir):
    return rounded(M.constant_score_check(_docs(spark, sf_dir), "score", ["lang"]), "spread")


# --------------------------------------------------------------------------- set operations and order


@query("o1_time_order", f"WITH {SUPP} SELECT symbol, time, row_number() OVER (ORDER BY time, symbol) - 1 AS rank FROM bars")
def o1(spark, sf_dir):
    from tidemark.layout import global_rank

    bars, _ = B.bars_supp(spark, sf_dir)
    return global_rank(bars.select("symbol", "time"), [F.col("time"), F.col("symbol")])


@query("o5_distinct_groups", f"WITH {_PERF} SELECT DISTINCT config FROM perf")
def o5(spark, sf_dir):
    return perf(spark, sf_dir).select("config").distinct()


@query("o6_out_of_sample_blocks", f"WITH {_PERF}, b AS (SELECT DISTINCT block FROM kept) SELECT combo, block FROM combos CROSS JOIN b EXCEPT SELECT combo, block FROM combos CROSS JOIN b WHERE (m >> block) & 1 = 1")
def o6(spark, sf_dir):
    return O.out_of_sample_blocks(perf(spark, sf_dir), S_BLOCKS)
