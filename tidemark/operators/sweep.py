"""Largest matchings of a growing set of predictions, all sizes in one pass.

Sets of predictions that can all be matched to different truths form a matroid. So when predictions join one after
another, in any order, each one either adds one match for good or never does, and the largest matching of every prefix
is the number of those that added one. A threshold sweep over falling scores needs no matching for each threshold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain as joined_up

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.looks import series_begin
from tidemark.operators.events import SEGMENT_BARS, match_counts
from tidemark.session import materialise

#: Segments that one task matches together; longer rows of truths without a gap are matched step by step.
CHAIN = 16


def gaining(truths: np.ndarray, bars: np.ndarray, tolerance: int) -> np.ndarray:
    """Whether each prediction, in the given order, enlarges the largest matching of those before it.

    `truths` are sorted. A prediction reaches the truths within the tolerance and, through their owners, those that the
    owners could take instead: a range that grows both ways. It gains if the range holds a free truth; if not, the
    range is closed for good, and closed ranges are skipped from then on.
    """
    lo = np.searchsorted(truths, bars - tolerance, "left").tolist()
    hi = np.searchsorted(truths, bars + tolerance, "right").tolist()
    owner, held = [-1] * len(truths), [-1] * len(bars)
    onward = list(range(len(truths) + 1))
    out = np.zeros(len(bars), bool)

    def open_from(t: int) -> int:
        root = t
        while onward[root] != root:
            root = onward[root]
        while onward[t] != root:
            onward[t], t = root, onward[t]
        return root

    for p, (left, right) in enumerate(zip(lo, hi, strict=True)):
        if open_from(left) >= right:
            continue
        pieces = [(left, right, p)]
        free, at = -1, -1
        for at, (a, b, _) in enumerate(pieces):  # grows while it is read
            t = open_from(a)
            while t < b and owner[t] >= 0:
                o = owner[t]
                if lo[o] < left:
                    pieces.append((lo[o], left, o))
                    left = lo[o]
                if hi[o] > right:
                    pieces.append((right, hi[o], o))
                    right = hi[o]
                t = open_from(t + 1)
            if t < b:
                free = t
                break
        if free < 0:
            t = open_from(left)
            while t < right:
                onward[t] = t + 1
                t = open_from(t + 1)
            continue
        out[p] = True
        for a, b, q in reversed(pieces[: at + 1]):
            if a <= free < b:
                owner[free], held[q], free = q, free, held[q]
    return out


def _blocks(rows: DataFrame, reach: int, keys: Sequence[str], size: int) -> DataFrame:
    """Segments joined to a neighbour, as truths on both sides of the edge may compete for one prediction: `_block` (first
    of the segments joined), its length, and which neighbours. One row per such segment; other segments are blocks."""
    seg = F.floor(F.col("bar") / F.lit(size)).alias("_seg")
    found = rows.filter("_y").groupBy(*keys, seg).agg(F.min("bar").alias("_lo"), F.max("bar").alias("_hi"))
    w = Window.partitionBy(*keys).orderBy("_seg")
    near = (F.lag("_seg").over(w) == F.col("_seg") - 1) & (F.col("_lo") - F.lag("_hi").over(w) <= 2 * reach)
    joined = found.withColumn("_before", F.coalesce(near, F.lit(False)))
    first = F.last(F.when(~F.col("_before"), F.col("_seg")), ignorenulls=True)
    joined = joined.withColumns(
        {
            "_after": F.coalesce(F.lead("_before").over(w), F.lit(False)),
            "_block": first.over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        }
    )
    lengths = joined.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_length"))
    joined = joined.filter("_before or _after").join(lengths, [*keys, "_block"])
    return materialise(joined.select(*keys, "_seg", "_block", "_before", "_after", "_length"))


def match_gains(
    rows: DataFrame, tolerance: int, by: Sequence[str] = (), segment_bars: int = SEGMENT_BARS, chain: int = CHAIN
) -> DataFrame:
    """(by, _k, gain): by how much the largest matching within `tolerance` bars grows when the predictions of step
    `_k` join those of smaller steps; steps without gain are left out.

    `rows` is a stored table of by, symbol, bar, `_y` (a truth, all of which count from the start), `_k` (the step at
    which the row is predicted; null: never) and `_steps` (steps of its group). A series is cut where truths are more
    than twice the tolerance apart, as no prediction reaches across. Where they are closer for more than `chain`
    segments, that part is matched once for each step, in segments.
    """
    if tolerance < 0:
        raise ValueError("tolerance must be >= 0")
    keys = [*by, "symbol"]
    size = max(segment_bars, 2 * tolerance + 1)
    rows = rows.dropna(subset=keys)
    segments = _blocks(rows, tolerance, keys, size)
    seg, rest = F.floor(F.col("bar") / F.lit(size)), F.col("bar") % F.lit(size)

    def side(part: DataFrame, to: int) -> DataFrame:
        """Rows for segment `seg - to`."""
        return part.withColumns({"_seg": seg - to, "_side": F.lit(to), "_y": F.coalesce("_y", F.lit(False)) if to == 0 else F.lit(False)})

    # a prediction near an edge also goes to the neighbour, unless both belong together
    predicted = rows.filter(F.col("_k").isNotNull())
    placed = side(rows.filter(F.col("_y") | F.col("_k").isNotNull()), 0)
    if tolerance:
        placed = placed.unionByName(side(predicted.filter(rest < tolerance), 1)).unionByName(side(predicted.filter(rest >= size - tolerance), -1))
    blocks = {"_block": F.col("_seg"), "_length": F.lit(1).cast("long")}
    if not segments.isEmpty():
        apart = (F.col("_side") == 0) | ((F.col("_side") == 1) & ~F.coalesce("_after", F.lit(False))) | ((F.col("_side") == -1) & ~F.coalesce("_before", F.lit(False)))
        placed = placed.join(segments.hint("shuffle_hash"), [*keys, "_seg"], "left").filter(apart)
        blocks = {c: F.coalesce(c, own) for c, own in blocks.items()}
    placed = placed.withColumns(blocks)

    bounds = [*keys, "_block"]
    short = placed.filter(F.col("_length") <= chain).select(*bounds, F.col("bar").cast("long"), F.col("_k").cast("int"), "_y")
    short = short.repartition(*bounds).sortWithinPartitions(*bounds)
    schema = T.StructType([*rows.select(*by).schema.fields, T.StructField("_k", T.IntegerType()), T.StructField("gain", T.LongType())])

    def matched(part: pa.Table, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
        bar, k = part["bar"].to_numpy(), part["_k"].fill_null(-1).to_numpy()
        true = part["_y"].to_numpy()
        at, ks, ns = [], [], []
        for lo, hi in zip(begin, [*begin[1:], part.num_rows], strict=True):
            t, on = np.sort(bar[lo:hi][true[lo:hi]]), k[lo:hi] >= 0
            if not len(t) or not on.any():
                continue
            bars, steps = bar[lo:hi][on], k[lo:hi][on]
            order = np.lexsort((bars, steps))
            found, n = np.unique(steps[order][gaining(t, bars[order], tolerance)], return_counts=True)
            at.append(np.full(len(found), lo))
            ks.append(found)
            ns.append(n)
        if at:
            cols = [part[c].take(pa.array(np.concatenate(at))).combine_chunks() for c in by]
            cols += [pa.array(np.concatenate(ks), pa.int32()), pa.array(np.concatenate(ns), pa.int64())]
            yield from pa.Table.from_arrays(cols, names=[*by, "_k", "gain"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in joined_up(batches, [None]):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
            if held is None or not held.num_rows:
                continue
            begin = np.flatnonzero(series_begin(held, bounds))
            if batch is None:
                yield from matched(held, begin)
            elif len(begin) > 1:
                yield from matched(held.slice(0, begin[-1]), begin[:-1])
                held = held.slice(begin[-1])

    gains = short.mapInArrow(run, schema)
    if chain < 1 or not segments.filter(F.col("_length") > chain).isEmpty():
        dense = placed.filter(F.col("_length") > chain)
        start = F.when(F.col("_y"), F.lit(0)).otherwise(F.col("_k").cast("int"))
        steps = dense.filter("_steps > 0").withColumn("_i", F.explode(F.sequence(start, F.col("_steps").cast("int") - 1)))
        pred = F.coalesce(F.col("_k") <= F.col("_i"), F.lit(False))
        events = steps.select(*keys, "_block", "_i", "bar", pred.alias("is_pred"), F.col("_y").alias("is_true"))
        whole = match_counts(events, tolerance, [*by, "_block", "_i"], segment_bars)
        sums = whole.groupBy(*by, "_i").agg(F.sum("tp").alias("tp"))
        last = F.lag("tp", 1, 0).over(Window.partitionBy(*by).orderBy("_i"))
        gains = gains.unionByName(sums.select(*by, F.col("_i").alias("_k"), (F.col("tp") - last).alias("gain")))
    return gains.groupBy(*by, "_k").agg(F.sum("gain").alias("gain")).filter("gain > 0")
