"""Physical layout of long bar series.

A window over `partitionBy(symbol)` puts a whole series into one task. Series differ in length by orders of
magnitude, so every operator here works on bounded chunks instead: a series is cut into runs of `chunk_rows`
consecutive bars, and each chunk carries copies of the `lookback` bars before it (and `lead` bars after it).
All reference semantics have a bounded lookback, or a carry that is passed between chunks through a small
per-chunk summary, so a chunked result equals the unchunked one.

If the caller can prove that no series is longer than one chunk (`max_bars`), the copies and the position index
are skipped and a plain per-symbol window is used.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.looks import Each, Look, rounded, same, with_looks
from tidemark.session import materialise

CHUNK_ROWS = 16_384
DAY = 86_400
UNB = Window.unboundedPreceding


# --------------------------------------------------------------------------- positions


def index_bars(df: DataFrame, bar_seconds: int = DAY, slice_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add `bar` (0-based position in the series) and `n_bars` without a task per series.

    A slice spans `bar_seconds * slice_rows` seconds, so it holds at most `slice_rows` bars. Positions inside a
    slice come from a window over the slice; the offset of a slice from the per-slice counts.
    """
    sliced = df.withColumn("_slice", F.floor(F.col("time") / F.lit(bar_seconds * slice_rows)))
    counts = sliced.groupBy("symbol", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    per_symbol = Window.partitionBy("symbol")
    offsets = counts.select(
        "symbol",
        "_slice",
        F.coalesce(F.sum("_n").over(per_symbol.orderBy("_slice").rowsBetween(UNB, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(per_symbol).alias("n_bars"),
    )
    within = F.row_number().over(Window.partitionBy("symbol", "_slice").orderBy("time"))
    return (
        sliced.withColumn("_rn", within)
        .join(offsets, ["symbol", "_slice"])
        .withColumn("bar", F.col("_off") + F.col("_rn") - F.lit(1))
        .drop("_slice", "_off", "_rn")
    )


def max_bars_of(df: DataFrame, bar_seconds: int = DAY) -> int:
    """Upper bound on the length of any series: the pooled time span in bars (one cheap aggregate)."""
    lo, hi = df.agg(F.min("time"), F.max("time")).first()
    return 0 if lo is None else int((hi - lo) // bar_seconds + 1)


# --------------------------------------------------------------------------- chunks with halo


def lay_out(
    bars: DataFrame,
    lookback: int = 0,
    lead: int = 0,
    *,
    bar_seconds: int = DAY,
    max_bars: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Bars ready for windows: `bar`, `n_bars` and, for long series, `chunk` and `_core`.

    `_core` is false on halo copies; `trim` removes them after the windows have run.
    """
    if max_bars is not None and max_bars <= chunk_rows:
        if "bar" in bars.columns:
            return bars
        per = Window.partitionBy("symbol")
        return bars.withColumn("bar", F.row_number().over(per.orderBy("time")).cast("long") - F.lit(1)).withColumn(
            "n_bars", F.count(F.lit(1)).over(per.orderBy("time").rowsBetween(UNB, Window.unboundedFollowing))
        )
    indexed = bars if "bar" in bars.columns else index_bars(bars, bar_seconds, chunk_rows)
    size = F.lit(chunk_rows)
    first = F.floor(F.greatest(F.col("bar") - F.lit(lead), F.lit(0)) / size)
    last = F.floor(F.least(F.col("bar") + F.lit(lookback), F.col("n_bars") - F.lit(1)) / size)
    return indexed.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn(
        "_core", F.col("chunk") == F.floor(F.col("bar") / size)
    )


def trim(df: DataFrame) -> DataFrame:
    """Drop halo copies and the chunk columns."""
    if "_core" not in df.columns:
        return df
    return df.filter(F.col("_core")).drop("_core", "chunk")


@dataclass(frozen=True)
class Frames:
    """Window specs that match a laid-out frame."""

    keys: tuple[str, ...]

    @staticmethod
    def of(df: DataFrame) -> Frames:
        return Frames(("symbol", "chunk") if "chunk" in df.columns else ("symbol",))

    @cached_property
    def order(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy("time")

    @property
    def over(self) -> str:
        """The same order as SQL text."""
        return f"OVER (PARTITION BY {', '.join(self.keys)} ORDER BY time)"

    def w(self, lo: int, hi: int = 0) -> WindowSpec:
        return self.order.rowsBetween(lo, hi)

    def lag(self, col: str, k: int) -> Column:
        return F.expr(f"lag({col}, {k}) {self.over}")

    def running(self, col: Column) -> Column:
        return F.sum(col).over(self.w(UNB))


@dataclass(frozen=True)
class Calc:
    """One calculation on a laid-out frame.

    `stages[k]` may use looks and window functions over raw columns and over columns of earlier stages; `out` uses none.
    Looks and `Each` columns of all calculations that follow one another without other columns between share one pass;
    stages of Spark columns of the same depth share Window operators.
    """

    stages: Sequence[dict[str, Column | Look | Each]]
    out: dict[str, Column | Each]
    lookback: int = 0
    lead: int = 0


Spec = Callable[[Frames], Calc]


def apply_calcs(df: DataFrame, calcs: Iterable[Calc], keys: Sequence[str] = ("symbol",), count: bool = False) -> DataFrame:
    """Run calculations stage by stage; equal temporary names mean equal definitions.

    Spark columns run as soon as they can; then all stages of looks and `Each` columns that can follow share one pass,
    which hands out only outputs and what later stages name. A temporary goes when the calculations that name it are
    done. Looks need rows that lie series by series, sorted by time. The last pass leaves halo copies out. With `count`,
    for calculations of one pass, the pass adds `bar` and `n_bars`.
    """
    calcs = list(calcs)
    for name in (n for i, c in enumerate(calcs) for n in c.out):
        if name in df.columns or sum(name in c.out for c in calcs) > 1:
            raise ValueError(f"duplicate output column {name!r}")
    users: dict[str, set[int]] = {}
    for i, calc in enumerate(calcs):
        for name in (n for stage in calc.stages for n in stage):
            users.setdefault(name, set()).add(i)
    at, done, seen = [0] * len(calcs), set(), set()

    def arrays(cols: dict[str, Column | Look | Each]) -> bool:
        return all(isinstance(v, Look | Each) or k in seen for k, v in cols.items())

    while len(done) < len(calcs):
        moved = True
        while moved:
            moved, level = False, {}
            for i, calc in enumerate(calcs):
                if i in done:
                    continue
                if at[i] == len(calc.stages):
                    if not any(isinstance(v, Each) for v in calc.out.values()):
                        level |= calc.out
                        done.add(i)
                elif not any(isinstance(v, Look | Each) and k not in seen for k, v in calc.stages[at[i]].items()):
                    level |= {k: v for k, v in calc.stages[at[i]].items() if k not in seen}
                    at[i] += 1
                    moved = True
            seen.update(k for k in level if k in users)
            if level:
                df = df.withColumns(level)
        gone = {n for n in seen if users[n] <= done}
        df, seen = df.drop(*gone), seen - gone
        level = {}
        looks: dict[str, Look | Each] = {}
        for i, calc in enumerate(calcs):
            if i in done:
                continue
            first = at[i]
            while at[i] < len(calc.stages) and (at[i] == first or arrays(calc.stages[at[i]])):
                stage = {k: v for k, v in calc.stages[at[i]].items() if k not in seen}
                looks |= {k: v for k, v in stage.items() if k not in looks and isinstance(v, Look | Each)}
                level |= {k: v for k, v in stage.items() if not isinstance(v, Look | Each)}
                at[i] += 1
            if at[i] == len(calc.stages) and all(isinstance(v, Each) for v in calc.out.values()):
                looks |= calc.out
                done.add(i)
        if level:
            df = df.withColumns(level)
        if looks:
            last = all(at[i] == len(c.stages) for i, c in enumerate(calcs))
            df = with_looks(df, keys, looks, [n for n in looks if not users.get(n, set()) <= done or n not in users], "_core" if last and "_core" in df.columns else None, count)
        seen.update(level, (n for n in looks if n in users and not users[n] <= done))
    return df.drop(*(n for n in seen if n in df.columns))


def _rounding(spec: Spec, digits: int) -> Spec:
    def spec_(fr: Frames) -> Calc:
        calc = spec(fr)
        return replace(calc, out={n: rounded(v, digits) if isinstance(v, Each) else v for n, v in calc.out.items()})

    return spec_


def compute(
    bars: DataFrame,
    specs: Iterable[Spec],
    *,
    bar_seconds: int = DAY,
    max_bars: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
    digits: int | None = None,
) -> DataFrame:
    """Lay out bars for the widest calculation, run all, drop the halo.

    With `digits` outputs that are doubles made in NumPy are rounded where they are made.
    """
    specs = [s if digits is None else _rounding(s, digits) for s in specs]
    probe = [s(Frames(("symbol",))) for s in specs]
    looking = any(isinstance(v, Look | Each) for c in probe for made in (*c.stages, c.out) for v in made.values())
    plain = max_bars is not None and max_bars <= chunk_rows
    arrays = all(isinstance(v, Look | Each) for c in probe for made in (*c.stages, c.out) for v in made.values())
    if looking and plain and arrays and not {"bar", "n_bars"} & {*bars.columns}:
        # whole series meet the one pass, which counts their bars as well
        return apply_calcs(bars.repartition("symbol").sortWithinPartitions("symbol", "time"), probe, count=True)
    laid = lay_out(
        bars.repartition("symbol") if looking and plain else bars,
        max((c.lookback for c in probe), default=0),
        max((c.lead for c in probe), default=0),
        bar_seconds=bar_seconds,
        max_bars=max_bars,
        chunk_rows=chunk_rows,
    )
    fr = Frames.of(laid)
    calcs = probe if fr.keys == ("symbol",) else [s(fr) for s in specs]
    if looking:
        laid = (laid if plain else laid.repartition(*fr.keys)).sortWithinPartitions(*fr.keys, "time")
    return trim(apply_calcs(laid, calcs, fr.keys))


# --------------------------------------------------------------------------- first-order recursion


def decay_rows(a: float, digits: float = 40.0) -> int:
    """Power of four of bars after which a factor `a` per bar has shrunk below e**-digits (4e-18)."""
    return 4 ** math.ceil(math.log(max(4.0, digits / -math.log(a)), 4))


def affine_scan_stages(fr: Frames, name: str, a: float, b: Column | Each) -> tuple[list[dict[str, Column | Look | Each]], str]:
    """x[t] = a * x[t-1] + b[t], 0 < a < 1: stages and the result column.

    x[t] is the sum of a**j * b[t-j]. The sum over 4w terms is the sum over w terms plus the same sum w, 2w and 3w
    bars earlier, scaled by a**w, a**2w, a**3w; it stops where the factor is far below the precision of a double. So
    only single-row looks back are needed: no state, no extra sort, and a bounded lookback.
    """
    return [{f"_{name}_1": b}, {f"_{name}_x": Look("scan", f"_{name}_1", decay_rows(a), a)}], f"_{name}_x"


def affine_max_scan(df: DataFrame, a: float, b: Column, name: str, **layout) -> DataFrame:
    """Column `name` with x[t] = a * x[t-1] + b[t] along each series.

    A lower bound c as in max(a*x + b, c) never binds when b >= c and x >= 0, the only form used here.
    """

    def spec(fr: Frames) -> Calc:
        stages, out = affine_scan_stages(fr, name, a, b)
        return Calc(stages, {name: same(out)}, lookback=decay_rows(a))

    return compute(df, [spec], **layout)


# --------------------------------------------------------------------------- carries between chunks


def running_carry(
    df: DataFrame,
    sums: dict[str, Column] | None = None,
    maxs: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    *,
    chunk_rows: int = CHUNK_ROWS,
    max_bars: int | None = None,
    strict: bool = False,
    chunk_by: Column | None = None,
    order: Sequence[str] = ("time",),
) -> DataFrame:
    """Running sum / max / last-not-null from the start of the series (`strict`: up to the row before).

    Local to chunks, plus the totals of earlier chunks from a per-chunk summary. `chunk_by` must grow with `order`;
    by default it is `bar` over the chunk size.
    """
    parts = [("s", sums or {}), ("m", maxs or {}), ("l", lasts or {})]
    agg = {"s": F.sum, "m": F.max, "l": lambda c: F.last(c, ignorenulls=True)}
    hi = -1 if strict else 0
    single = max_bars is not None and max_bars <= chunk_rows
    ck = F.floor(F.col("bar") / F.lit(chunk_rows)) if chunk_by is None else chunk_by
    keyed = df if single else df.withColumn("_ck", ck)
    keys = ["symbol"] if single else ["symbol", "_ck"]
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(UNB, hi)
    keyed = keyed.withColumns({f"_in_{n}": c for _, cols in parts for n, c in cols.items()})
    names = [(kind, n) for kind, cols in parts for n in cols]
    out = keyed.withColumns({n: agg[kind](F.col(f"_in_{n}")).over(local) for kind, n in names})
    if not single:
        # one row per chunk; last value by position, so the summary needs no order inside the chunk
        totals = {"s": F.sum, "m": F.max, "l": lambda c: F.max_by(c, F.when(c.isNotNull(), F.struct(*order)))}
        summary = keyed.groupBy("symbol", "_ck").agg(*[totals[k](F.col(f"_in_{n}")).alias(f"_t_{n}") for k, n in names])
        before = Window.partitionBy("symbol").orderBy("_ck").rowsBetween(UNB, -1)
        carry = summary.select(
            "symbol", "_ck", *[agg[k](F.col(f"_t_{n}")).over(before).alias(f"_c_{n}") for k, n in names]
        )
        merge = {
            "s": lambda n: F.when(
                F.col(n).isNotNull() | F.col(f"_c_{n}").isNotNull(),
                F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)),
            ),
            "m": lambda n: F.greatest(F.col(n), F.col(f"_c_{n}")),
            "l": lambda n: F.coalesce(F.col(n), F.col(f"_c_{n}")),
        }
        out = out.join(carry, ["symbol", "_ck"]).withColumns({n: merge[k](n) for k, n in names})
        out = out.drop("_ck", *[f"_c_{n}" for _, n in names])
    return out.drop(*[f"_in_{n}" for _, n in names])


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    cols: Sequence[str],
    *,
    strict: bool = True,
    bar_seconds: int = DAY,
    chunk_rows: int = CHUNK_ROWS,
    max_bars: int | None = None,
) -> DataFrame:
    """Rows of `left` with `cols` of the latest `right` row of the same symbol before `time` (strict) or up to it.

    One union and one pass in time order instead of a range join; chunks hand the last value on. `right` has at
    most one row per (symbol, time).
    """
    side = F.lit(1 if strict else -1)
    packed = F.struct(*cols)
    rows = left.withColumns({"_side": F.lit(0), "_keep": F.lit(True)}).unionByName(
        right.select("symbol", "time", packed.alias("_v")).withColumns({"_side": side, "_keep": F.lit(False)}),
        allowMissingColumns=True,
    )
    span = F.floor(F.col("time") / F.lit(bar_seconds * chunk_rows))
    seen = running_carry(
        rows, lasts={"_seen": F.col("_v")}, chunk_by=span, order=("time", "_side"), max_bars=max_bars, chunk_rows=chunk_rows
    )
    out = seen.filter("_keep")
    return out.select(*left.columns, *[F.col(f"_seen.{c}").alias(c) for c in cols])


# --------------------------------------------------------------------------- global order


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """0-based position of every row in a total order, without a one-task sort.

    Range partitions split hot key values by the tie-break columns in `order`. The sorted rows are written once, so
    the position inside a partition is fixed; offsets come from the per-partition counts.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    mid = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_mid", mid)
    fixed = materialise(
        ordered.withColumn("_pid", F.shiftright("_mid", 33).cast("int")).withColumn(
            "_idx", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
        )
    ).drop("_mid")
    # one row per range partition: bounded by the partition count, safe to broadcast
    sizes = fixed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = prefix_small(sizes, "_pid", {"_off": F.col("_n")}).select("_pid", "_off")
    return (
        fixed.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_off") + F.col("_idx"))
        .drop("_pid", "_idx", "_off")
    )


def prefix_small(df: DataFrame, order: str, sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Exclusive running sums over a table with one row per range partition (never row-sized)."""
    spec = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = spec.orderBy(order).rowsBetween(UNB, -1)
    return df.withColumns({n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()})


def global_running(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, Column], partitions: int | None = None
) -> DataFrame:
    """Inclusive running sums inside each `by` group along `order`, split over range partitions."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = [F.col(c) for c in by]
    ordered = df.withColumns({f"_x_{k}": c for k, c in sums.items()})
    ordered = ordered.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    fixed = materialise(
        ordered.withColumn("_mid", F.monotonically_increasing_id()).withColumn(
            "_pid", F.shiftright("_mid", 33).cast("int")
        )
    )
    # rows: (partition, group) pairs, at most partitions + groups
    totals = fixed.groupBy("_pid", *by).agg(*[F.sum(f"_x_{k}").alias(f"_t_{k}") for k in sums])
    offsets = prefix_small(totals, "_pid", {f"_o_{k}": F.col(f"_t_{k}") for k in sums}, by)
    offsets = offsets.drop(*[f"_t_{k}" for k in sums])
    local = Window.partitionBy("_pid", *by).orderBy("_mid").rowsBetween(UNB, 0)
    out = fixed.withColumns({k: F.sum(f"_x_{k}").over(local) for k in sums}).join(offsets, ["_pid", *by])
    out = out.withColumns({k: F.col(k) + F.col(f"_o_{k}") for k in sums})
    return out.drop("_pid", "_mid", *[f"_x_{k}" for k in sums], *[f"_o_{k}" for k in sums])


# --------------------------------------------------------------------------- small-state folds


def carry_states(maps: DataFrame, by: Sequence[str], seg: str, table: str, idle: int, span: int = 1024) -> DataFrame:
    """Start state of every segment of a sequential process with few states, 1..S.

    `table` is an array: position = start state, value = end state of the segment. Tables compose, so segments are
    folded in groups of `span`, then the groups, and start states are handed back down; no task sees more than
    `span` segments, or the group list of one series. A segment that does not directly follow its predecessor
    starts from `idle` (segments are longer than the memory of the process).
    """
    by = list(by)
    follows = F.lag(seg).over(Window.partitionBy(*by).orderBy(seg)) == F.col(seg) - 1
    stepped = maps.select(
        *by, F.col(seg).cast("long").alias("_seg"), F.coalesce(follows, F.lit(False)).alias("_fl"), F.col(table).alias("_t")
    ).withColumn("_grp", F.floor(F.col("_seg") / F.lit(span)))
    listed = stepped.groupBy(*by, "_grp").agg(F.sort_array(F.collect_list(F.struct("_seg", "_fl", "_t"))).alias("_ls"))

    def entry(x: Column, s: Column) -> Column:
        return F.when(x["_fl"], s).otherwise(F.lit(idle))

    composed = listed.select(
        *by,
        "_grp",
        F.aggregate(
            "_ls",
            F.sequence(F.lit(1), F.size(F.col("_ls")[0]["_t"])),
            lambda acc, x: F.transform(acc, lambda s: F.element_at(x["_t"], entry(x, s))),
        ).alias("_t"),
        F.lit(True).alias("_fl"),
    )
    groups = composed.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_grp", "_fl", "_t"))).alias("_gl"))
    starts = groups.select(*by, F.explode(_fold_starts("_gl", F.lit(idle), "_grp", entry)).alias("_e"))
    starts = starts.select(*by, F.col("_e.id").alias("_grp"), F.col("_e.start").alias("_s0"))
    inner = listed.join(starts, [*by, "_grp"])
    out = inner.select(*by, F.explode(_fold_starts("_ls", F.col("_s0"), "_seg", entry)).alias("_e"))
    return out.select(*by, F.col("_e.id").alias(seg), F.col("_e.start").alias("start"))


def _fold_starts(items: str, init: Column, ident: str, entry: Callable[[Column, Column], Column]) -> Column:
    """Array of (id, start): the state each list item starts from."""
    zero = F.struct(init.cast("int").alias("s"), F.expr("cast(array() as array<struct<id:bigint,start:int>>)").alias("o"))

    def merge(acc: Column, x: Column) -> Column:
        start = entry(x, acc["s"]).cast("int")
        item = F.struct(x[ident].cast("long").alias("id"), start.alias("start"))
        return F.struct(F.element_at(x["_t"], start).cast("int").alias("s"), F.array_append(acc["o"], item).alias("o"))

    return F.aggregate(items, zero, merge, lambda acc: acc["o"])
