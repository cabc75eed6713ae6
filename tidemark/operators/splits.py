"""Purged and embargoed folds as membership tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.layout import CHUNK_ROWS, global_rank, global_running
from tidemark.session import materialise


class LeakageError(RuntimeError):
    """Training rows inside a purge or embargo band."""


def validate(n: int, horizon: int, embargo: int, n_folds: int) -> None:
    if n == 0:
        raise ValueError("no rows to split")
    if horizon < 0 or embargo < 0:
        raise ValueError("horizon and embargo must be >= 0")
    if not 2 <= n_folds <= n:
        raise ValueError(f"n_folds must be in [2, {n}], got {n_folds}")


def with_position(df: DataFrame) -> DataFrame:
    """`pos`: stable position of each row on the pooled time axis (ties by symbol)."""
    return global_rank(df, [F.col("time"), F.col("symbol")], "pos")


def block_of(pos: Column, n: int, k: int) -> Column:
    """Contiguous near-equal blocks; the first n % k blocks hold one row more."""
    q, r = divmod(n, k)
    head = r * (q + 1)
    late = F.lit(r) + F.floor((pos - F.lit(head)) / F.lit(max(q, 1)))
    return F.when(pos < head, F.floor(pos / F.lit(q + 1))).otherwise(late).cast("int")


def with_block(df: DataFrame, n_folds: int, align_time: bool = False) -> DataFrame:
    """`pos` and `block`; `align_time` moves a timestamp that straddles two blocks into the first."""
    placed = with_position(df)
    n = placed.count()
    validate(n, 0, 0, n_folds)
    out = placed.withColumn("block", block_of(F.col("pos"), n, n_folds))
    if align_time:
        firsts = out.groupBy("time").agg(F.min("block").alias("_first"))
        out = out.join(firsts, "time").withColumn("block", F.col("_first")).drop("_first")
    return out


def with_block_by_edges(df: DataFrame, n_folds: int) -> DataFrame:
    """`block` as in `with_block`, without a sort of all rows; `df` is a stored table, read three times.

    Rows are counted by time, and only times that hold the first row of a block are ranked by symbol. Each row is then
    compared with these first rows. Rows of equal time and symbol lie by `bar`.
    """
    order = ["time", "symbol", "bar"]
    counts = materialise(df.groupBy("time").agg(F.count(F.lit(1)).alias("_c")))
    n = counts.agg(F.sum("_c")).first()[0] or 0
    validate(n, 0, 0, n_folds)
    q, r = divmod(n, n_folds)
    starts = [b * q + min(b, r) for b in range(1, n_folds)]
    run = global_running(counts, [], [F.col("time")], {"_until": F.col("_c")})
    held = " or ".join(f"(_until - _c <= {p} and {p} < _until)" for p in starts)
    times = run.filter(held).select("time", "_c", "_until").orderBy("_until").collect()  # a row for each edge at most
    kinds = dict(df.select(*order).dtypes)

    def lit(col: str, value) -> Column:
        return F.lit(value).cast(kinds[col])

    here = df.filter(reduce(or_, [F.col("time").eqNullSafe(lit("time", t["time"])) for t in times])).select(*order)
    wanted, before = [], 0
    for t in times:
        wanted += [before + p - (t["_until"] - t["_c"]) for p in starts if t["_until"] - t["_c"] <= p < t["_until"]]
        before += t["_c"]
    ranked = global_rank(here, [F.col(c) for c in order], "_at")
    firsts = ranked.filter(F.col("_at").isin(wanted)).orderBy("_at").collect()
    row = F.struct(*order)
    late = [(row >= F.struct(*[lit(c, f[c]).alias(c) for c in order])).cast("int") for f in firsts]
    return df.withColumn("block", sum(late[1:], late[0]))


def per_symbol_join(rows: DataFrame, per_symbol: DataFrame, n_col: str, chunk_rows: int = CHUNK_ROWS, keys: Sequence[str] = ("symbol",), how: str = "left") -> DataFrame:
    """Join of bar rows with one row per symbol (or `keys`), keyed by (symbol, chunk of bars).

    The small side is repeated once per chunk, so a symbol with a third of all rows is spread over many tasks, and
    hashed, so that no task sorts the rows.
    """
    last = F.floor((F.col(n_col) - F.lit(1)) / F.lit(chunk_rows))
    spread = per_symbol.withColumn("_ck", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop(n_col)
    keyed = rows.withColumn("_ck", F.floor(F.col("bar") / F.lit(chunk_rows)))
    return keyed.join(spread.hint("shuffle_hash"), [*keys, "_ck"], how).drop("_ck")


def bands(blocked: DataFrame, horizon: int, embargo: int) -> DataFrame:
    """Forbidden bar range per (block, symbol), in the clock of the symbol; absent pairs forbid nothing."""
    return blocked.groupBy("block", "symbol").agg(
        (F.min("bar") - F.lit(horizon)).alias("lo"), (F.max("bar") + F.lit(embargo)).alias("hi")
    )


def purged_folds(
    df: DataFrame,
    horizon: int,
    embargo: int,
    n_folds: int,
    pooled: bool = True,
    mode: str = "all",
    align_time: bool = False,
    keep_purged: bool = False,
    chunk_rows: int = CHUNK_ROWS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(symbol, bar, time, fold, role, carry) with role train or test (and purged with `keep_purged`).

    `bar` must count the rows of each symbol densely. Train rows lie outside the test block and its purge band, on
    both sides of it; `mode="expanding"` keeps only rows of earlier blocks. With `pooled=False` the band is taken on
    the pooled axis instead of each symbol's own clock.
    """
    if mode not in ("all", "expanding"):
        raise ValueError(f"unknown mode {mode!r}")
    given = df.select("symbol", "bar", "time", *carry)
    blocked = with_block_by_edges(materialise(given), n_folds) if pooled and not align_time else with_block(given, n_folds, align_time)
    validate(n_folds, horizon, embargo, n_folds)
    if pooled:
        band = F.struct(F.col("block").alias("b"), "lo", "hi")
        per = bands(blocked, horizon, embargo).groupBy("symbol").agg(
            F.collect_list(band).alias("_bands"), F.max(F.col("hi") - F.lit(embargo) + 1).alias("_n")
        )
        rows = per_symbol_join(blocked, per, "_n", chunk_rows)
        # at most n_folds bands per symbol
        banned = F.expr("exists(_bands, x -> x.b = fold and bar between x.lo and x.hi)")
    else:
        edges = blocked.groupBy("block").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).orderBy("block").collect()
        rows = blocked
        test = " or ".join(
            f"(fold = {e['block']} and pos between {e['lo'] - horizon} and {e['hi'] + embargo})" for e in edges
        )
        banned = F.expr(f"({test})")
    out = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    usable = ~banned if mode == "all" else ~banned & (F.col("block") < F.col("fold"))
    role = F.when(F.col("block") == F.col("fold"), "test").when(usable, "train").otherwise("purged")
    out = out.withColumn("role", role).select("symbol", "bar", "time", "fold", "role", *carry)
    return out if keep_purged else out.filter("role <> 'purged'")


def leaks(folds: DataFrame, horizon: int, embargo: int) -> DataFrame:
    """Train rows inside the band of their fold, counted per fold; every count must be 0."""
    test = F.when(F.col("role") == "test", F.col("bar"))
    per = folds.groupBy("symbol", "fold").agg((F.min(test) - F.lit(horizon)).alias("lo"), (F.max(test) + F.lit(embargo)).alias("hi"), (F.max("bar") + 1).alias("_n"))
    # at most as many bands per symbol as folds; a fold without a test row of the symbol forbids nothing there
    band = F.struct(F.col("fold").alias("f"), "lo", "hi")
    listed = per.groupBy("symbol").agg(F.collect_list(F.when(F.col("lo").isNotNull(), band)).alias("_bands"), F.max("_n").alias("_n"))
    joined = per_symbol_join(folds.filter("role = 'train'").select("symbol", "bar", "fold"), listed, "_n")
    inside = F.coalesce(F.expr("exists(_bands, x -> x.f = fold and bar between x.lo and x.hi)"), F.lit(False))
    return joined.groupBy("fold").agg(F.count(F.lit(1)).alias("n_train"), F.sum(inside.cast("long")).alias("n_leaked"))


def assert_no_leak(folds: DataFrame, horizon: int, embargo: int) -> None:
    bad = leaks(folds, horizon, embargo).filter("n_leaked > 0").limit(1).collect()
    if bad:
        raise LeakageError(f"fold {bad[0]['fold']}: {bad[0]['n_leaked']} training rows inside the band")


def time_tail(df: DataFrame, frac: float) -> DataFrame:
    """`is_tail`: the last `frac` of each symbol's rows in time; needs `bar`, `n_bars`."""
    return df.withColumn("is_tail", F.col("bar") >= F.floor(F.col("n_bars") * F.lit(1.0 - frac)))
