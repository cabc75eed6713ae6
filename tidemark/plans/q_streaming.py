"""Streaming operators, drained over the event table and compared with the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.layout import compute
from tidemark.operators import features as X
from tidemark.plans import base as B
from tidemark.plans import sqltext as Q
from tidemark.plans.base import EVENT, HOUR, ORACLES, query, r6, rounded
from tidemark.plans.q_detector import cooldown_sql
from tidemark.plans.q_labels_splits import LOOSE, labels_sql
from tidemark.session import materialise, scratch_folder
from tidemark.sources.bars import instant
from tidemark.streaming import stream as T


def _as_stream(df, parts: int = 1, order="time"):
    """A materialised table, read as a stream of `parts` micro-batches that follow each other in `order`."""
    kept = materialise(df if parts == 1 else df.repartitionByRange(parts, order))
    source = df.sparkSession.readStream.schema(kept.schema)
    if parts > 1:
        # files are numbered in order of time, and written one after the other as the source takes them by age
        folder = f"{scratch_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"
        for i, f in enumerate(sorted(kept.inputFiles())):
            df.sparkSession.read.schema(kept.schema).parquet(f).coalesce(1).write.mode("append").parquet(folder)
        return source.option("maxFilesPerTrigger", 1).parquet(folder)
    return source.parquet(kept.inputFiles()[0].rsplit("/", 1)[0])


@query(
    "t1_stream_bars",
    f"WITH {EVENT}, m AS (SELECT max(ts) AS last FROM events) SELECT symbol, time, open, high, low, close, volume FROM bars, m WHERE time + {HOUR} <= epoch(last) - 600",
)
def t1(spark, sf_dir):
    """Bars final under a watermark of ten minutes."""
    ev = B.table(spark, sf_dir, "events")
    src = spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ts = src.withColumn("ts", instant(src, "ts"))
    return T.run_to_table(
        T.stream_bars(ts, F.col("event_type"), "ts", F.col("value"), F.lit(1.0), "1 hour", [F.col("ts")], "10 minutes")
    )


_ft, _fl = Q.chain(Q.merge(Q.TRUE_RANGE, Q.GJR_INPUT, Q.up_streak(5, "streak_norm")))


@query(
    "t2_stream_features",
    f"""WITH RECURSIVE {EVENT},\n{_ft.replace(_fl + ' AS (', _fl + ' AS MATERIALIZED (')},\n{Q.rma_rec('tr', 14, _fl, 'a14')},\n{Q.gjr_rec(_fl)}
SELECT t.symbol, t.time, {r6('a14')} AS atr, {r6(Q.GJR_OUT.replace('bar', 't.bar'))} AS gjr_asym, {r6('streak_norm')} AS up_streak_norm
FROM {_fl} t LEFT JOIN rec_a14 a ON a.symbol = t.symbol AND a.bar = t.bar LEFT JOIN rec_gjr j ON j.symbol = t.symbol AND j.bar = t.bar""",
)
def t2(spark, sf_dir):
    out = T.run_to_table(T.stream_features(_as_stream(B.bars_event(spark, sf_dir)[0])))
    return rounded(out, "atr", "gjr_asym", "up_streak_norm")


_ct, _cl = Q.chain([*Q.momentum(3)[:2], {"candidate": "coalesce(price_return_L3 < -0.2, false)"}])


@query(
    "t3_stream_detect",
    f"""WITH RECURSIVE {EVENT},\n{_ct},\n{cooldown_sql(_cl, 5)}, e AS (SELECT *, lag(fired) OVER (PARTITION BY symbol ORDER BY bar) AS pf FROM fire)
SELECT c.symbol, c.time, e.fired, e.fired AND NOT coalesce(e.pf, false) AS signal FROM {_cl} c JOIN e ON e.symbol = c.symbol AND e.bar = c.bar""",
)
def t3(spark, sf_dir):
    bars, lay = B.bars_event(spark, sf_dir)
    cand = compute(bars, [X.price_return(3)], **lay).select(
        "symbol", "time", F.coalesce(F.col("price_return_L3") < -0.2, F.lit(False)).alias("candidate"))
    return T.run_to_table(T.stream_detect(_as_stream(cand), 5))


_lt, _ll = labels_sql(LOOSE)


@query(
    "t4_stream_labels",
    f"WITH {EVENT},\n{_lt} SELECT symbol, time, {r6('top_score')} AS top_score, {r6('bottom_score')} AS bottom_score FROM {_ll} WHERE bar + {LOOSE.horizon} < n_bars",
)
def t4(spark, sf_dir):
    bars, _ = B.bars_event(spark, sf_dir)
    return rounded(T.run_to_table(T.stream_labels(_as_stream(bars), LOOSE)), "top_score", "bottom_score")


@query("t2_stream_features_batches", ORACLES["t2_stream_features"])
def t2b(spark, sf_dir):
    """The same in several micro-batches: state passes from one to the next."""
    out = T.run_to_table(T.stream_features(_as_stream(B.bars_event(spark, sf_dir)[0], 4)))
    return rounded(out, "atr", "gjr_asym", "up_streak_norm")


@query("t4_stream_labels_batches", ORACLES["t4_stream_labels"])
def t4b(spark, sf_dir):
    bars, _ = B.bars_event(spark, sf_dir)
    return rounded(T.run_to_table(T.stream_labels(_as_stream(bars, 4), LOOSE)), "top_score", "bottom_score")


LATE = 6 * HOUR
_PASSED = f" WHERE t.time <= (SELECT max(time) FROM bars) - {LATE}"


def _shuffled(df, parts: int):
    """Bars as a stream of micro-batches in which each bar arrives up to LATE seconds after its time."""
    arrival = F.col("time") + F.pmod(F.xxhash64("symbol", "time"), F.lit(LATE))
    return _as_stream(df, parts, arrival)


@query("t2_stream_features_late", ORACLES["t2_stream_features"] + _PASSED)
def t2c(spark, sf_dir):
    """Bars out of order within the delay: they wait for the watermark, and the last ones still do at the end."""
    with T.timer_state(spark):
        out = T.run_to_table(T.stream_features(_shuffled(B.bars_event(spark, sf_dir)[0], 4), delay=f"{LATE} seconds"))
    return rounded(out, "atr", "gjr_asym", "up_streak_norm")


@query(
    "t3_stream_detect_late",
    ORACLES["t3_stream_detect"] + f" WHERE c.time <= (SELECT max(time) FROM bars) - {LATE}",
)
def t3b(spark, sf_dir):
    """Cooldown over bars that arrive out of order."""
    bars, lay = B.bars_event(spark, sf_dir)
    cand = compute(bars, [X.price_return(3)], **lay).select(
        "symbol", "time", F.coalesce(F.col("price_return_L3") < -0.2, F.lit(False)).alias("candidate"))
    with T.timer_state(spark):
        return T.run_to_table(T.stream_detect(_shuffled(cand, 4), 5, delay=f"{LATE} seconds"))


@query(
    "t4_stream_labels_late",
    f"""WITH {EVENT},\n{_lt}, p AS (SELECT max(time) - {LATE} AS passed FROM bars),
seen AS (SELECT symbol, count(*) AS n FROM bars, p WHERE time <= passed GROUP BY symbol)
SELECT symbol, time, {r6('top_score')} AS top_score, {r6('bottom_score')} AS bottom_score FROM {_ll} JOIN seen USING (symbol) WHERE bar + {LOOSE.horizon} < n""",
)
def t4c(spark, sf_dir):
    """A label leaves once its horizon has passed the watermark."""
    bars, _ = B.bars_event(spark, sf_dir)
    with T.timer_state(spark):
        out = T.run_to_table(T.stream_labels(_shuffled(bars, 4), LOOSE, delay=f"{LATE} seconds"))
    return rounded(out, "top_score", "bottom_score")
