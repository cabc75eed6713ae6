"""Row expressions, labels, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as C
from tidemark.layout import asof_backward, compute
from tidemark.operators import features as X
from tidemark.operators import labels as L
from tidemark.operators import splits as V
from tidemark.plans import base as B
from tidemark.plans import sqltext as Q
from tidemark.plans.base import EVENT, FLAG, SUPP, query, r6, rounded

LOOSE = L.LOOSE
SMALL = L.OracleConfig(scale_nest=(5, 10, 20), drawdown_pct=0.05, horizon=20, tau_strong=0.5, tau_regular=0.25)


# --------------------------------------------------------------------------- labels


def side_sql(cfg: L.OracleConfig, ext: str, rev: str, top: bool) -> tuple[list[dict[str, str]], str, dict[str, str]]:
    """Window stage, score expression and the single conditions of one side."""
    t = "t" if top else "b"
    best, worst, cmp_ = ("max", "min", ">") if top else ("min", "max", "<")
    stage, conf = {}, []
    parts: dict[str, str] = {}
    h = cfg.horizon
    for s in cfg.scale_nest:
        f = min(s, h)
        stage[f"{t}b{s}"] = Q.over(f"{best}({ext})", -s, -1)
        stage[f"{t}f{s}"] = Q.over(f"{best}({ext})", 1, f)
        stage[f"{t}r{s}"] = Q.over(f"{worst}({rev})", 1, f)
        parts[f"extreme_{s}"] = f"(coalesce({ext} {cmp_} {t}b{s}, true) AND coalesce({ext} {cmp_} {t}f{s}, true))"
        move = f"({ext} - {t}r{s})" if top else f"({t}r{s} - {ext})"
        parts[f"reversal_{s}"] = f"coalesce({move} / greatest({ext}, {Q.d(1e-12)}) >= {Q.d(cfg.drawdown_pct)}, false)"
    for s, w in zip(cfg.scale_nest, cfg.weights()):
        conf.append(f"CASE WHEN {parts[f'extreme_{s}']} AND {parts[f'reversal_{s}']} THEN {Q.d(w)} ELSE {Q.d(0.0)} END")
    last = cfg.scale_nest[-1]
    ok = f"bar + {h} < n_bars AND {parts[f'extreme_{last}']}"
    score = f"CASE WHEN {ok} THEN greatest({Q.d(0.0)}, least({Q.d(1.0)}, {' + '.join(conf)})) ELSE {Q.d(0.0)} END"
    return [stage], score, parts


def tier_sql(score: str, cfg: L.OracleConfig) -> str:
    return f"CASE WHEN {score} >= {cfg.tau_strong!r} THEN 'strong' WHEN {score} >= {cfg.tau_regular!r} THEN 'regular' ELSE 'none' END"


def labels_sql(cfg: L.OracleConfig, base: str = "bars", prefix: str = "lb") -> tuple[str, str]:
    """CTEs and last relation with scores and tiers of both sides."""
    ts, tscore, _ = side_sql(cfg, "high", "low", True)
    bs, bscore, _ = side_sql(cfg, "low", "high", False)
    return Q.chain(
        [
            ts[0] | bs[0],
            {"top_score": tscore, "bottom_score": bscore},
            {"top_tier": tier_sql("top_score", cfg), "bottom_tier": tier_sql("bottom_score", cfg)},
        ],
        base,
        prefix,
    )


def _label_query(name: str, load, cte: str, cfg: L.OracleConfig) -> None:
    text, last = labels_sql(cfg)
    sql = (
        f"WITH {cte},\n{text} SELECT symbol, time, {r6('top_score')} AS top_score, {r6('bottom_score')} AS bottom_score,"
        f" top_tier, bottom_tier, {r6('top_score')} AS top_weight, {r6('bottom_score')} AS bottom_weight FROM {last}"
    )

    @query(name, sql)
    def _(spark, sf_dir):
        bars, lay = load(spark, sf_dir)
        df = L.label_turns(bars, cfg, **lay).select(
            "symbol", "time", "top_score", "bottom_score", "top_tier", "bottom_tier", "top_weight", "bottom_weight"
        )
        return rounded(df, "top_score", "bottom_score", "top_weight", "bottom_weight")


_label_query("l7_label_turns", B.bars_supp, SUPP, L.STRUCTURAL)
_label_query("l7_label_turns_loose", B.bars_flag, FLAG, LOOSE)
_label_query("l5_quadratic_weights", B.bars_supp, SUPP, L.OracleConfig(weight_curve="quadratic", scale_nest=(5, 10, 20, 40), horizon=40))


def _detail_query(name: str, keep: str, top: bool) -> None:
    ext, rev = ("high", "low") if top else ("low", "high")
    st, _, parts = side_sql(LOOSE, ext, rev, top)
    text, last = Q.chain(st)
    dec = f"bar + {LOOSE.horizon} < n_bars"
    cols = {
        "decidable": dec,
        "candidate": f"{dec} AND {parts['extreme_40']}",
        **{k: f"{dec} AND {v}" for k, v in parts.items()},
    }
    names = [c for c in cols if c.startswith(keep)]
    sql = f"WITH {SUPP},\n{text} SELECT symbol, time, " + ", ".join(f"{cols[c]} AS {c}" for c in names) + f" FROM {last}"

    @query(name, sql)
    def _(spark, sf_dir):
        bars, lay = B.bars_supp(spark, sf_dir)
        return compute(bars, [L.detail_spec(ext, rev, top, LOOSE)], **lay).select("symbol", "time", *names)


_detail_query("l1_decidability", "decidable", False)
_detail_query("l2_candidate_gate", "candidate", False)
_detail_query("l3_scale_extremes", "extreme", True)
_detail_query("l4_scale_reversals", "reversal", True)
_st, _score, _ = side_sql(LOOSE, "close", "close", True)
_text, _last = Q.chain(_st)


@query("l8_single_series_label", f"WITH {SUPP},\n{_text} SELECT symbol, time, {r6(_score)} AS score FROM {_last}")
def l8(spark, sf_dir):
    bars, lay = B.bars_supp(spark, sf_dir)
    return rounded(L.label_side(bars, "close", "close", True, LOOSE, **lay).select("symbol", "time", "score"), "score")


_text, _last = labels_sql(LOOSE)


@query(
    "l6_score_histogram",
    f"""WITH {SUPP},\n{_text} SELECT {r6('top_score')} AS top_score, CAST(count(*) AS BIGINT) AS n FROM {_last} GROUP BY 1""",
)
def l6(spark, sf_dir):
    bars, lay = B.bars_supp(spark, sf_dir)
    df = rounded(L.label_turns(bars, LOOSE, **lay).select("top_score"), "top_score")
    return df.groupBy("top_score").agg(F.count(F.lit(1)).alias("n"))


@query(
    "l9_truncation_check",
    "SELECT CAST(NULL AS VARCHAR) AS symbol, CAST(0 AS BIGINT) AS bar, CAST(0 AS DOUBLE) AS top_score, CAST(0 AS DOUBLE) AS bottom_score WHERE false",
)
def l9(spark, sf_dir):
    """Empty: labels do not look past their horizon."""
    bars, lay = B.bars_flag(spark, sf_dir)
    return L.truncation_check(compute(bars, [], **lay), LOOSE, keep_bars=600, **lay)


_TARGETS = """targets AS (
  SELECT symbol, 'lowest' AS event, arg_min(time, ROW(low, time)) + 43200 AS target FROM bars GROUP BY symbol
  UNION ALL
  SELECT symbol, 'highest', arg_max(time, ROW(high, -time)) + 43200 FROM bars GROUP BY symbol)"""


@query(
    "l10_known_event_check",
    f"""WITH {SUPP},\n{_TARGETS},\n{_text},
nearest AS (
  SELECT t.symbol, t.event, t.target, arg_min(b.bar, ROW(abs(b.time - t.target), b.time)) AS nearest_bar
  FROM targets t JOIN bars b USING (symbol) GROUP BY 1, 2, 3)
SELECT n.symbol, n.event, n.target, n.nearest_bar, {r6('max(l.bottom_score)')} AS best_score,
  CASE max(CASE l.bottom_tier WHEN 'strong' THEN 2 WHEN 'regular' THEN 1 ELSE 0 END)
    WHEN 2 THEN 'strong' WHEN 1 THEN 'regular' ELSE 'none' END AS best_tier,
  max(CASE WHEN l.bottom_tier <> 'none' THEN 1 ELSE 0 END) = 1 AS passed
FROM nearest n JOIN {_last} l ON l.symbol = n.symbol AND l.bar BETWEEN n.nearest_bar - 3 AND n.nearest_bar + 3
GROUP BY 1, 2, 3, 4""",
)
def l10(spark, sf_dir):
    bars, lay = B.bars_supp(spark, sf_dir)
    half = F.lit(43_200)
    lo = bars.groupBy("symbol").agg(F.min_by("time", F.struct("low", "time")).alias("t")).select(
        "symbol", F.lit("lowest").alias("event"), (F.col("t") + half).alias("target"))
    hi = bars.groupBy("symbol").agg(F.max_by("time", F.struct("high", -F.col("time"))).alias("t")).select(
        "symbol", F.lit("highest").alias("event"), (F.col("t") + half).alias("target"))
    out = L.known_event_check(L.label_turns(bars, LOOSE, **lay), lo.unionByName(hi), 3, **lay)
    return rounded(out, "best_score")


# --------------------------------------------------------------------------- row expressions


@query("p1_drop_warmup", f"""WITH {SUPP},\n{Q.chain(Q.merge(Q.momentum(20)))[0]}
SELECT symbol, time, {r6('price_return_L20')} AS price_return_L20, {r6('mom_velocity_L20')} AS mom_velocity_L20
FROM st3 WHERE price_return_L20 IS NOT NULL AND mom_velocity_L20 IS NOT NULL""")
def p1(spark, sf_dir):
    from tidemark.operators.pool import drop_warmup

    bars, lay = B.bars_supp(spark, sf_dir)
    cols = ["price_return_L20", "mom_velocity_L20"]
    df = compute(bars, [X.price_return(20), X.mom_velocity(20)], **lay).select("symbol", "time", *cols)
    return rounded(drop_warmup(df, cols), *cols)


def _target_query(name: str, cols: dict[str, str], boost: float = 1.0) -> None:
    text, last = labels_sql(LOOSE)
    sel = ", ".join(f"{e} AS {c}" for c, e in cols.items())

    @query(name, f"WITH {SUPP},\n{text} SELECT symbol, time, {sel} FROM {last}")
    def _(spark, sf_dir):
        bars, lay = B.bars_supp(spark, sf_dir)
        df = C.with_targets(L.label_turns(bars, LOOSE, **lay), "bottom", boost).select("symbol", "time", *cols)
        return rounded(df, *[c for c in cols if c != "y"])


_Y = "CASE WHEN bottom_tier IN ('strong', 'regular') THEN 1 ELSE 0 END"
_W = f"CASE WHEN bottom_tier IN ('strong', 'regular') THEN 1 + bottom_score ELSE {Q.d(1.0)} END"
_target_query("p2_binary_target", {"y": _Y})
_target_query("p3_sample_weight", {"y": _Y, "sample_weight": r6(_W)})
_target_query(
    "p4_boosted_weight",
    {"boosted_weight": r6(_W.replace("THEN 1 + bottom_score", "THEN 10 * (1 + bottom_score)")), "ap_weight": r6(_W)},
    10.0,
)


@query("p5_class_ratio", f"""SELECT toxic, CAST(sum(quality) AS BIGINT) AS n_pos, CAST(sum(1 - quality) AS BIGINT) AS n_neg,
{r6('CASE WHEN sum(quality) = 0 THEN 1 ELSE greatest(1, least(1.5, sum(1 - quality) / greatest(sum(quality), 1))) END')} AS ratio
FROM labels GROUP BY toxic""")
def p5(spark, sf_dir):
    return rounded(C.class_ratio(B.table(spark, sf_dir, "labels"), "quality", cap=1.5, by=("toxic",)), "ratio")


@query("p6_scored_only", """SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS score FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE CASE WHEN l.doc_id IS NOT NULL THEN d.n_chars END IS NOT NULL AND d.lang = 'en'""")
def p6(spark, sf_dir):
    docs, labels = B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "labels")
    df = docs.join(labels.select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    df = df.withColumn("score", F.when(F.col("has"), F.col("n_chars").cast("double")))
    return C.scored_only(df, "score", F.col("lang") == "en").select("doc_id", "score")


_EXPRS = {
    "p7_safe_log_ratio": (lambda: C.safe_log_ratio(F.col("high"), F.col("low")), Q.safe_log("high", "low")),
    "p8_clamp_unit": (lambda: C.clamp_unit(F.col("close") / 10.0 - 5.0), Q.clamp("close / 10 - 5")),
    "p8_clip01": (lambda: C.clip01(F.col("close") / 50.0), f"greatest({Q.d(0.0)}, least({Q.d(1.0)}, close / 50))"),
    "p9_logit": (
        lambda: C.logit(F.col("close") / 100.0),
        "ln(greatest(1e-12, least(1 - 1e-12, close / 100)) / (1 - greatest(1e-12, least(1 - 1e-12, close / 100))))",
    ),
    "p10_tanh": (lambda: F.tanh(F.col("close") / 25.0), "tanh(close / 25)"),
    "p13_signed_log": (lambda: C.signed_log(F.col("close") - 20.0), "sign(close - 20) * ln(1 + abs(close - 20))"),
}


def _expr_query(name: str, col, sql: str) -> None:
    @query(name, f"WITH {EVENT} SELECT symbol, time, {r6(sql)} AS value FROM bars")
    def _(spark, sf_dir):
        bars, _ = B.bars_event(spark, sf_dir)
        return rounded(bars.select("symbol", "time", col().alias("value")), "value")


for _n, (_c, _s) in _EXPRS.items():
    _expr_query(_n, _c, _s)


@query("p11_tier", f"WITH {EVENT} SELECT symbol, time, CASE WHEN close / 50 >= 0.6 THEN 'strong' WHEN close / 50 >= 0.3 THEN 'regular' ELSE 'none' END AS tier FROM bars")
def p11(spark, sf_dir):
    bars, _ = B.bars_event(spark, sf_dir)
    return bars.select("symbol", "time", C.tier(F.col("close") / 50.0, 0.6, 0.3).alias("tier"))


def prf_sql(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    p = f"coalesce({tp} / NULLIF(CAST({tp} + {fp} AS DOUBLE), 0), 0)"
    r = f"coalesce({tp} / NULLIF(CAST({tp} + {fn} AS DOUBLE), 0), 0)"
    f1 = f"coalesce(2 * {p} * {r} / NULLIF({p} + {r}, 0), 0)"
    return f"{r6(p)} AS precision, {r6(r)} AS recall, {r6(f1)} AS f1"


@query("p12_prf", f"""WITH c AS (SELECT source, CAST(sum(CASE WHEN n_chars > 1000 AND quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
CAST(sum(CASE WHEN n_chars > 1000 AND quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
CAST(sum(CASE WHEN n_chars <= 1000 AND quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT source, tp, fp, fn, {prf_sql()} FROM c""")
def p12(spark, sf_dir):
    df = B.table(spark, sf_dir, "documents").join(B.table(spark, sf_dir, "labels"), "doc_id")
    big, good = F.col("n_chars") > 1000, F.col("quality") == 1
    cnt = {"tp": big & good, "fp": big & ~good, "fn": ~big & good}
    c = df.groupBy("source").agg(*[F.sum(x.cast("long")).alias(k) for k, x in cnt.items()])
    return rounded(C.with_prf(c), "precision", "recall", "f1")


# --------------------------------------------------------------------------- as-of join


@query(
    "j4_asof_backward",
    f"""WITH {FLAG},
piv AS (SELECT symbol, time, close FROM bars WHERE volume > 200)
SELECT b.symbol, b.time, arg_max(p.time, p.time) AS seen_time, arg_max(p.close, p.time) AS seen_close
FROM bars b LEFT JOIN piv p ON p.symbol = b.symbol AND p.time < b.time GROUP BY 1, 2""",
)
def j4(spark, sf_dir):
    bars, lay = B.bars_flag(spark, sf_dir)
    right = bars.filter("volume > 200").select("symbol", "time", F.col("time").alias("seen_time"), F.col("close").alias("seen_close"))
    return asof_backward(bars.select("symbol", "time"), right, ["seen_time", "seen_close"], max_bars=lay["max_bars"])


# --------------------------------------------------------------------------- folds

H, E, K = 20, 5, 5
_POS = f"{SUPP},\nposd AS (SELECT symbol, bar, time, row_number() OVER (ORDER BY time, symbol) - 1 AS pos, count(*) OVER () AS n FROM bars)"
_BLK = f"""{_POS},
blk AS (SELECT *, CAST(CASE WHEN pos < (n % {K}) * (n // {K} + 1) THEN pos // (n // {K} + 1)
  ELSE n % {K} + (pos - (n % {K}) * (n // {K} + 1)) // (n // {K}) END AS INTEGER) AS block FROM posd)"""


def folds_sql(pooled: bool = True, expanding: bool = False) -> str:
    if pooled:
        band = f"band AS (SELECT block AS fold, symbol, min(bar) - {H} AS lo, max(bar) + {E} AS hi FROM blk GROUP BY 1, 2)"
        on, clock = "b.fold = f.fold AND b.symbol = k.symbol", "bar"
    else:
        band = f"band AS (SELECT block AS fold, min(pos) - {H} AS lo, max(pos) + {E} AS hi FROM blk GROUP BY 1)"
        on, clock = "b.fold = f.fold", "pos"
    extra = "OR k.block >= f.fold" if expanding else ""
    return f"""{_BLK},
{band},
folds AS (
  SELECT k.symbol, k.bar, k.time, f.fold,
    CASE WHEN k.block = f.fold THEN 'test' WHEN coalesce(k.{clock} BETWEEN b.lo AND b.hi, false) {extra} THEN 'purged' ELSE 'train' END AS role
  FROM blk k CROSS JOIN (SELECT CAST(range AS INTEGER) AS fold FROM range({K})) f LEFT JOIN band b ON {on})"""


def _indexed(spark, sf_dir):
    bars, lay = B.bars_supp(spark, sf_dir)
    return compute(bars, [], **lay)


@query("v1_global_position", f"WITH {_POS} SELECT symbol, bar, time, pos FROM posd")
def v1(spark, sf_dir):
    return V.with_position(_indexed(spark, sf_dir).select("symbol", "bar", "time"))


@query("v2_contiguous_blocks", f"WITH {_BLK} SELECT symbol, bar, block FROM blk")
def v2(spark, sf_dir):
    return V.with_block(_indexed(spark, sf_dir).select("symbol", "bar", "time"), K).select("symbol", "bar", "block")


@query("v2_blocks_aligned", f"WITH {_BLK}, m AS (SELECT time, min(block) AS block FROM blk GROUP BY time) SELECT b.symbol, b.bar, m.block FROM blk b JOIN m USING (time)")
def v2b(spark, sf_dir):
    return V.with_block(_indexed(spark, sf_dir).select("symbol", "bar", "time"), K, True).select("symbol", "bar", "block")


@query("v3_single_timeline_folds", f"WITH {folds_sql(False)} SELECT * FROM folds WHERE role <> 'purged'")
def v3(spark, sf_dir):
    return V.purged_folds(_indexed(spark, sf_dir), H, E, K, pooled=False)


@query("v4_purge_bands", f"WITH {folds_sql()} SELECT fold AS block, symbol, lo, hi FROM band")
def v4(spark, sf_dir):
    return V.bands(V.with_block(_indexed(spark, sf_dir).select("symbol", "bar", "time"), K), H, E)


@query("v5_fold_table", f"WITH {folds_sql()} SELECT * FROM folds WHERE role <> 'purged'")
def v5(spark, sf_dir):
    return V.purged_folds(_indexed(spark, sf_dir), H, E, K)


@query("v5_fold_table_expanding", f"WITH {folds_sql(expanding=True)} SELECT * FROM folds")
def v5b(spark, sf_dir):
    return V.purged_folds(_indexed(spark, sf_dir), H, E, K, mode="expanding", keep_purged=True)


@query("v6_leak_check", f"""WITH {folds_sql()},
t AS (SELECT fold, symbol, min(bar) - {H} AS lo, max(bar) + {E} AS hi FROM folds WHERE role = 'test' GROUP BY 1, 2)
SELECT f.fold, CAST(count(*) AS BIGINT) AS n_train, CAST(sum(CASE WHEN f.bar BETWEEN t.lo AND t.hi THEN 1 ELSE 0 END) AS BIGINT) AS n_leaked
FROM folds f LEFT JOIN t USING (fold, symbol) WHERE f.role = 'train' GROUP BY f.fold""")
def v6(spark, sf_dir):
    return V.leaks(V.purged_folds(_indexed(spark, sf_dir), H, E, K), H, E)


@query("v8_time_tail", f"WITH {SUPP} SELECT symbol, bar, bar >= floor(n_bars * {Q.d(1.0 - 0.2)}) AS is_tail FROM bars")
def v8(spark, sf_dir):
    return V.time_tail(_indexed(spark, sf_dir), 0.2).select("symbol", "bar", "is_tail")


@query("o7_disjoint_roles", f"WITH {folds_sql()} SELECT symbol, bar, fold FROM folds WHERE role = 'train' INTERSECT SELECT symbol, bar, fold FROM folds WHERE role = 'test'")
def o7(spark, sf_dir):
    f = V.purged_folds(_indexed(spark, sf_dir), H, E, K)
    pick = lambda r: f.filter(F.col("role") == r).select("symbol", "bar", "fold")
    return pick("train").intersect(pick("test"))


# --------------------------------------------------------------------------- flagship


_sp, _se = Q.scale_pir(20, 20)
_ft, _fl = Q.chain(Q.merge(_sp, Q.momentum(20)) + [{"pir_s20": _se}])
_lt, _ll = labels_sql(LOOSE, _fl, "lb")


@query(
    "flagship_turn_summary",
    f"""WITH {SUPP},\n{_ft},\n{_lt}
SELECT symbol, count(*) AS n_bars, CAST(sum(CASE WHEN top_tier <> 'none' THEN 1 ELSE 0 END) AS BIGINT) AS n_tops,
  CAST(sum(CASE WHEN bottom_tier <> 'none' THEN 1 ELSE 0 END) AS BIGINT) AS n_bottoms,
  {r6("avg(CASE WHEN top_tier <> 'none' THEN pir_s20 END)")} AS pir_at_tops,
  {r6("avg(CASE WHEN bottom_tier <> 'none' THEN pir_s20 END)")} AS pir_at_bottoms,
  {r6("avg(CASE WHEN bottom_tier <> 'none' THEN price_return_L20 END)")} AS return_at_bottoms
FROM {_ll} GROUP BY symbol""",
)
def flagship(spark, sf_dir):
    bars, lay = B.bars_supp(spark, sf_dir)
    df = compute(bars, [X.pir_for_scale(20, 20), X.price_return(20), *L.label_specs(LOOSE)], **lay)
    df = L.with_tiers(df, LOOSE)
    top, bottom = F.col("top_tier") != "none", F.col("bottom_tier") != "none"
    out = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.sum(top.cast("long")).alias("n_tops"),
        F.sum(bottom.cast("long")).alias("n_bottoms"),
        F.avg(F.when(top, F.col("pir_s20"))).alias("pir_at_tops"),
        F.avg(F.when(bottom, F.col("pir_s20"))).alias("pir_at_bottoms"),
        F.avg(F.when(bottom, F.col("price_return_L20"))).alias("return_at_bottoms"),
    )
    return rounded(out, "pir_at_tops", "pir_at_bottoms", "return_at_bottoms")
