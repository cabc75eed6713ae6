"""Structured Streaming forms of the bar-at-a-time operators.

State per symbol is a few numbers or one bounded buffer, and the time of the last bar. Within a micro-batch the bars
of a symbol are put in time order, so a micro-batch should hold a bounded stretch of time (set by the trigger or the
file limit of the source). A bar that isn't newer than the last one of an earlier micro-batch comes too late for
recursions that have passed it: it is left out and gives no row. With `idle_ms` the state of a symbol without bars for
so long is freed, and the symbol begins anew.

With a `delay` bars wait in state until the watermark, the newest bar of all symbols less the delay, has passed them.
Bars that arrive in any order within the delay then give what the batch form gives, the bars of the last `delay` are
still waiting when a stream is stopped, and `idle_ms` counts bar time. This needs the RocksDB state store, see
`timer_state`.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

from tidemark.operators import features as X
from tidemark.operators.labels import OracleConfig
from tidemark.session import checkpoint_root


def run_to_table(sdf: DataFrame) -> DataFrame:
    """Drain what is available into a table below the checkpoint folder and read it."""
    spark = sdf.sparkSession
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        sdf.writeStream.format("parquet").option("path", f"{root}/data").option("checkpointLocation", f"{root}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(f"{root}/data")


def stream_bars(
    sdf: DataFrame, key: Column, ts: str, price: Column, qty: Column, width: str, order: Sequence[Column], delay: str
) -> DataFrame:
    """Ticks to tumbling bars; ticks later than `delay` behind the newest are dropped, bars are final when emitted."""
    t = sdf.withWatermark(ts, delay).select(
        key.cast("string").alias("symbol"), F.col(ts), price.cast("double").alias("_p"), qty.cast("double").alias("_q"),
        (order[0] if len(order) == 1 else F.struct(*order)).alias("_o"),
    )
    agg = t.groupBy("symbol", F.window(ts, width)).agg(
        F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"),
        F.max_by("_p", "_o").alias("close"), F.sum("_q").alias("volume"),
    )
    return agg.select("symbol", F.unix_seconds("window.start").alias("time"), "open", "high", "low", "close", "volume")


#: Watermarks begin at 1970 and pandas times end in 2262, so event times are moved on by a century: bars of 1870 to 2162
#: can wait.
SHIFT = 3_155_760_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timer_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which list state and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _stateful(
    sdf: DataFrame, out: str, state_ddl: str, step: Callable[[dict, pd.DataFrame], pd.DataFrame], fresh: Callable[[], dict],
    idle_ms: int | None = None, delay: str | None = None,
) -> DataFrame:
    """Run `step(state, newer bars in time order)` per symbol; the state dict is kept as columns of `state_ddl`."""
    names = [f.split()[0] for f in state_ddl.split(", ")]
    kept_ddl = f"{state_ddl}, last_time long"
    if delay is not None:
        timed = sdf.withColumn("_ts", F.timestamp_seconds(F.col("time") + F.lit(SHIFT))).withWatermark("_ts", delay)
        bars = Waiting(sdf.schema, kept_ddl, names, step, fresh, idle_ms)
        return timed.groupBy("symbol").transformWithStateInPandas(bars, out, "Append", "EventTime")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *kept, last = state.get if state.exists else (None, None)
        held = dict(zip(names, kept)) if state.exists else fresh()
        pdf = pd.concat(list(batches)).sort_values("time", kind="stable")
        if last is not None:
            pdf = pdf[pdf["time"] > last]
        if len(pdf):
            made = step(held, pdf)
            last = int(pdf["time"].iloc[-1])
            state.update((*(held[n] for n in names), last))
            if len(made):
                yield made
        if idle_ms is not None and state.exists:
            state.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return sdf.groupBy("symbol").applyInPandasWithState(run, out, kept_ddl, "append", timeout)


class Waiting(StatefulProcessor):
    """Bars of a symbol wait as a list until the watermark has passed them, then go through `step` in time order.

    A timer stands at the earliest bar that waits, and one at the time at which the symbol counts as idle. Of bars with
    the same time the one that came first counts.
    """

    def __init__(self, schema: StructType, kept_ddl: str, names: list[str], step: Callable, fresh: Callable, idle_ms: int | None):
        self.schema, self.kept_ddl, self.names = schema, kept_ddl, names
        self.step, self.fresh, self.idle_ms = step, fresh, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.kept = handle.getValueState("kept", self.kept_ddl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = self.kept.get()[-1] if self.kept.exists() else None
        pdf = pd.concat(list(rows))[self.schema.names]
        pdf = pdf if last is None else pdf[pdf["time"] > last]
        if len(pdf):
            self.waiting.appendList([tuple(r) for r in pdf.astype(object).itertuples(index=False)])
            self._wake_at(int(pdf["time"].min()))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() - SHIFT * 1000
        at = self.schema.names.index("time")
        rows = sorted(self.waiting.get(), key=lambda r: r[at]) if self.waiting.exists() else []
        ready = [r for r in rows if r[at] * 1000 <= passed]
        if ready:
            later = rows[len(ready) :]
            if later:
                self.waiting.put([tuple(r) for r in later])
                self._wake_at(int(later[0][at]))
            else:
                self.waiting.clear()
            held = dict(zip(self.names, self.kept.get())) if self.kept.exists() else self.fresh()
            pdf = pd.DataFrame([tuple(r) for r in ready], columns=self.schema.names).drop_duplicates("time")
            made = self.step(held, pdf)
            last = int(pdf["time"].iloc[-1])
            self.kept.update((*(held[n] for n in self.names), last))
            if self.idle_ms is not None:
                self.handle.registerTimer((last + SHIFT) * 1000 + self.idle_ms)
            if len(made):
                yield made
        elif self.idle_ms is not None and not rows and self.kept.exists() and self.kept.get()[-1] * 1000 + self.idle_ms <= passed:
            self.kept.clear()

    def _wake_at(self, time: int) -> None:
        # a timer fires once the watermark is beyond it
        self.handle.registerTimer((time + SHIFT) * 1000 - 1)

    def close(self) -> None:
        pass


def stream_features(sdf: DataFrame, atr_len: int = 14, cap: int = 5, idle_ms: int | None = None, delay: str | None = None) -> DataFrame:
    """(symbol, time, atr, gjr_asym, up_streak_norm) from one pass over arriving bars."""
    win, beta = X.LONG_RUN_WINDOW, X.GJR_BETA
    omega_k = 1.0 - X.GJR_ALPHA - beta - X.GJR_GAMMA / 2.0

    def fresh() -> dict:
        return {"n": 0, "pc": 0.0, "plr": 0.0, "pr2": 0.0, "g": 0.0, "s": 0.0, "atr": 0.0, "streak": 0, "r2": []}

    def step(st: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        r2s = deque(st["r2"], maxlen=win)
        rows = []
        for r in pdf.itertuples(index=False):
            n, first = st["n"], st["n"] == 0
            pc = r.close if first else st["pc"]
            tr = r.high - r.low if first else max(r.high - r.low, abs(r.high - pc), abs(r.low - pc))
            st["atr"] = st["atr"] + tr / atr_len if n < atr_len else (st["atr"] * (atr_len - 1) + tr) / atr_len
            st["streak"] = st["streak"] + 1 if not first and r.close > pc else 0
            lr = float(np.log(max(r.close, 1e-10) / max(pc, 1e-10)))
            r2 = lr * lr
            r2s.append(r2)
            warm = len(r2s) == win
            lrv = max(sum(r2s) / win if warm else r2, X.GJR_FLOOR)
            omega = max(lrv * omega_k, X.GJR_FLOOR)
            pr2 = lrv if first else st["pr2"]
            lev = X.GJR_GAMMA if not first and st["plr"] < 0 else 0.0
            st["g"] = omega + (X.GJR_ALPHA + lev) * pr2 + beta * (lrv if first else st["g"])
            st["s"] = omega + (X.GJR_ALPHA + X.GJR_GAMMA * 0.5) * pr2 + beta * (lrv if first else st["s"])
            gjr = min(max((st["g"] / st["s"] - 1.0) / X.GJR_NORM, -1.0), 1.0) if warm else None
            rows.append(
                (r.symbol, r.time, st["atr"] if n >= atr_len - 1 else None, gjr, min(st["streak"], cap) / cap)
            )
            st.update(n=n + 1, pc=r.close, plr=lr, pr2=r2)
        st["r2"] = list(r2s)
        return pd.DataFrame(rows, columns=["symbol", "time", "atr", "gjr_asym", "up_streak_norm"]).astype(
            {"atr": "float64", "gjr_asym": "float64"}
        )

    state = "n long, pc double, plr double, pr2 double, g double, s double, atr double, streak long, r2 array<double>"
    return _stateful(
        sdf.select("symbol", "time", "high", "low", "close"),
        "symbol string, time long, atr double, gjr_asym double, up_streak_norm double", state, step, fresh, idle_ms, delay,
    )


def stream_detect(sdf: DataFrame, cooldown: int, idle_ms: int | None = None, delay: str | None = None) -> DataFrame:
    """(symbol, time, fired, signal) from arriving (symbol, time, candidate): cooldown and rising edge."""

    def fresh() -> dict:
        return {"since": 999, "last": False}

    def step(st: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.itertuples(index=False):
            since = st["since"] + 1
            fired = bool(r.candidate) and since > cooldown
            rows.append((r.symbol, r.time, fired, fired and not st["last"]))
            st.update(since=0 if fired else since, last=fired)
        return pd.DataFrame(rows, columns=["symbol", "time", "fired", "signal"])

    return _stateful(
        sdf.select("symbol", "time", "candidate"), "symbol string, time long, fired boolean, signal boolean",
        "since long, last boolean", step, fresh, idle_ms, delay,
    )


def stream_labels(sdf: DataFrame, cfg: OracleConfig, idle_ms: int | None = None, delay: str | None = None) -> DataFrame:
    """(symbol, time, top_score, bottom_score): a bar's label leaves once `horizon` later bars have arrived."""
    h, nest, weights = cfg.horizon, cfg.scale_nest, cfg.weights()
    reach = nest[-1]

    def score(ext: np.ndarray, rev: np.ndarray, i: int, sign: float) -> float:
        """Bottom-side score of position i; the top side passes negated series and sign -1."""
        x = ext[i]
        base = max(sign * x, 1e-12)

        def strict(s: int, f: int) -> bool:
            before, after = ext[max(i - s, 0) : i], ext[i + 1 : i + f + 1]
            return bool((before > x).all() and (after > x).all())

        if not strict(reach, min(reach, h)):
            return 0.0
        total = 0.0
        for s, w in zip(nest, weights):
            f = min(s, h)
            if strict(s, f) and (rev[i + 1 : i + f + 1].max() - x) / base >= cfg.drawdown_pct:
                total += w
        return min(max(total, 0.0), 1.0)

    def fresh() -> dict:
        return {"t": [], "hi": [], "lo": [], "done": 0}

    def step(st: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.concatenate([np.asarray(st["t"], dtype=np.int64), pdf["time"].to_numpy()])
        hi = np.concatenate([np.asarray(st["hi"], dtype=float), pdf["high"].to_numpy()])
        lo = np.concatenate([np.asarray(st["lo"], dtype=float), pdf["low"].to_numpy()])
        stop = max(len(t) - h, st["done"])
        sym = pdf["symbol"].iloc[0]
        rows = [(sym, int(t[i]), score(-hi, -lo, i, -1.0), score(lo, hi, i, 1.0)) for i in range(st["done"], stop)]
        cut = max(stop - reach, 0)
        st.update(t=t[cut:].tolist(), hi=hi[cut:].tolist(), lo=lo[cut:].tolist(), done=stop - cut)
        return pd.DataFrame(rows, columns=["symbol", "time", "top_score", "bottom_score"])

    return _stateful(
        sdf.select("symbol", "time", "high", "low"), "symbol string, time long, top_score double, bottom_score double",
        "t array<long>, hi array<double>, lo array<double>, done long", step, fresh, idle_ms, delay,
    )
