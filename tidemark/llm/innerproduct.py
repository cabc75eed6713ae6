"""Exact top-k inner products over integer vectors, longest vectors first.

All vectors are rotated by the singular vectors of the whole table, so that the first coordinates carry most of a
product, and kept in blocks by descending length. A block of queries meets a block of vectors: the product of the
first coordinates plus the product of the residual lengths (Cauchy-Schwarz) bounds each score from above, and what
stays below a query's k-th best score so far is dropped, first whole runs of vectors by length alone, then pairs,
coordinate range by coordinate range. What is left is scored exactly in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import groups_for, rows_of
from tidemark.session import materialise

SCALE = 1024
VECTOR_BLOCK, QUERY_BLOCK, RUN = 4096, 1024, 512
NONE = np.iinfo(np.int64).min  # score of an empty place
STAGES = (8, 24)  # rotated coordinates known at each bound
BLOCK = "block long, longest double, ids binary, ints binary, turned binary"
FOUND = "query_block long, block long, ids binary, scores binary"
RESULT = "query_id long, row long, vec_id long, score long"


def integer_vectors(table: DataFrame) -> DataFrame:
    """vec_id and floor(SCALE * x) of each component; unfit vectors left out."""
    x = F.col("embedding").cast("array<double>")
    fit = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ints = F.transform(x, lambda v: F.floor(v * SCALE).cast("long"))
    return table.where(F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("long"), ints.alias("ints"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), dims), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of the whole table, from sums of products per partition: dims * dims numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            m = _matrix(batch.column(0), dims).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], ["cell", "value"])

    cells = vectors.select("ints").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    gram = np.zeros(dims * dims)
    for c in cells:
        gram[c.cell] = c.value
    return np.linalg.eigh(gram.reshape(dims, dims))[1][:, ::-1].copy()


def _pack(rows: pa.Table, block: int, dims: int, turn: np.ndarray) -> dict:
    m = _matrix(rows["ints"].combine_chunks(), dims)
    length = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
    return {
        "block": block,
        "longest": float(length.max(initial=0)),
        "ids": rows["vec_id"].to_numpy().astype("<i8").tobytes(),
        "ints": m.astype("<i8").tobytes(),
        "turned": (m.astype(np.float64) @ turn).astype("<f8").tobytes(),
    }


def blocks_by_length(vectors: DataFrame, dims: int, turn: np.ndarray, n: int) -> DataFrame:
    """Blocks of vectors, numbered by descending length; equally long ones are split by vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_pylist([_pack(pa.Table.from_batches(held), TaskContext.get().partitionId(), dims, turn)], schema=_schema())

    square = F.aggregate("ints", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    ordered = vectors.withColumn("square", square).repartitionByRange(n, F.desc("square"), "vec_id").sortWithinPartitions(F.desc("square"), "vec_id")
    return ordered.select("vec_id", "ints").mapInArrow(run, BLOCK)


def blocks_of_queries(queries: DataFrame, dims: int, turn: np.ndarray, n: int) -> DataFrame:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([_pack(rows.sort_by("vec_id"), key[0].as_py(), dims, turn)], schema=_schema())

    block = F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block")
    return queries.select(block, "vec_id", "ints").groupBy("block").applyInArrow(run, BLOCK)


def _schema() -> pa.Schema:
    return pa.schema([("block", pa.int64()), ("longest", pa.float64()), ("ids", pa.binary()), ("ints", pa.binary()), ("turned", pa.binary())])


class Side:
    """Unpacked block: ids, integer and rotated vectors, and the length that is left beyond each stage."""

    def __init__(self, ids: bytes, ints: bytes, turned: bytes, dims: int):
        self.ids = np.frombuffer(ids, "<i8")
        self.ints = np.frombuffer(ints, "<i8").reshape(-1, dims)
        self.turned = np.frombuffer(turned, "<f8").reshape(-1, dims)
        rest = np.zeros((len(self.ids), dims + 1))
        rest[:, :-1] = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = np.sqrt(rest)
        self.length = self.rest[:, 0]


def best_of(q: Side, v: Side, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of each query's k best vectors of the block among those that reach its known k-th score.

    Shorter lists are filled up with score NONE. Vectors come by descending length, in runs; after each run the k-th
    score rises.
    """
    dims, m = q.ints.shape[1], len(q.ids)
    ids, scores = np.full((m, k), -1, np.int64), np.full((m, k), NONE, np.int64)
    least = known.astype(np.float64)
    stages = [s for s in STAGES if s < dims]
    for a in range(0, len(v.ids), RUN):
        b = min(a + RUN, len(v.ids))
        slack = 1e-6 + 1e-9 * q.length * v.length[a]
        live = np.flatnonzero(q.length * v.length[a] + slack >= least)
        if not len(live):
            break  # every later vector is shorter
        part = np.zeros((len(live), b - a))
        alive, at = np.ones((len(live), b - a), bool), 0
        for s in stages:
            part += q.turned[live, at:s] @ v.turned[a:b, at:s].T
            alive = part + q.rest[live, s][:, None] * v.rest[a:b, s] + slack[live][:, None] >= least[live][:, None]
            at = s
            if alive.mean() < 0.05:
                break
        i, j = np.nonzero(alive)
        i, j = live[i], j + a
        other = q.ids[i] != v.ids[j]
        i, j = i[other], j[other]
        if not len(i):
            continue
        score = np.concatenate([np.einsum("ij,ij->i", q.ints[i[x : x + 65536]], v.ints[j[x : x + 65536]]) for x in range(0, len(i), 65536)])
        good = score >= least[i] - slack[i]  # `least` is rounded; order and ties are settled by whole scores
        i, j, score = i[good], j[good], score[good]
        which = np.unique(i)
        row = np.concatenate([i, np.repeat(which, k)])
        vec = np.concatenate([v.ids[j], ids[which].ravel()])
        val = np.concatenate([score, scores[which].ravel()])
        order = np.lexsort((vec, -val, row))
        order = order[val[order] != NONE]
        row, vec, val = row[order], vec[order], val[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, vec, val, rank = (x[rank < k] for x in (row, vec, val, rank))
        ids[row, rank], scores[row, rank] = vec, val
        full = scores[which, k - 1]
        least[which] = np.maximum(least[which], np.where(full == NONE, -np.inf, full))
    return ids, scores


def _meet(pairs: DataFrame, dims: int, k: int) -> DataFrame:
    """Best vectors of each pair of blocks; `pairs` has a query block, a vector block and known k-th scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, v = (Side(r[f"{x}_ids"], r[f"{x}_ints"], r[f"{x}_turned"], dims) for x in "qv")
                known = np.frombuffer(r["known"], "<f8") if r["known"] else np.full(len(q.ids), -np.inf)
                ids, scores = best_of(q, v, k, known)
                yield pa.RecordBatch.from_pylist([{"query_block": r["query_block"], "block": r["block"], "ids": ids.tobytes(), "scores": scores.tobytes()}])

    return pairs.select("query_block", "block", "known", *(f"{x}_{c}" for x in "qv" for c in ("ids", "ints", "turned"))).mapInArrow(run, FOUND)


def top_inner_products(table: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Each query's k vectors of the highest integer inner product, ties to the smaller vec_id.

    Both tables have vec_id and embedding; other columns are ignored. A query's own row, the rows of its vec_id, is no
    candidate. Vectors that are null, hold a null or non-finite component, or have no vec_id take no part; tables whose
    longest vectors could score beyond a long are an error; shorter ones count as filled with zeros; one without components scores 0. Repeated candidates count
    each, repeated queries are answered each. Empty tables give no rows. Blocks have a bounded size whatever the
    data: a vector that fills a third of the table is split over blocks by vec_id.
    """
    vectors, asked = integer_vectors(table), integer_vectors(queries)
    length = F.sqrt(F.max(F.aggregate("ints", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))).alias("length")
    seen, put = (t.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("ints")).alias("dims"), length).first() for t in (vectors, asked))
    dims = max(seen.dims or 0, put.dims or 0, 1)
    if (seen.length or 0) * (put.length or 0) >= 2.0**63 * (1 - 1e-9):
        raise ValueError(f"vectors of length {put.length:.3g} and {seen.length:.3g} (in 1/{SCALE}) can score beyond a long")
    turn = rotation(vectors, dims)
    stored = materialise(blocks_by_length(vectors, dims, turn, groups_for(seen.n, VECTOR_BLOCK)))
    query_blocks = materialise(blocks_of_queries(asked, dims, turn, groups_for(rows_of(asked), QUERY_BLOCK)))

    # the longest vectors first: they give every query a k-th score to beat
    order = [r.block for r in stored.select("block").orderBy("block").collect()]  # one number for each VECTOR_BLOCK rows
    if not order:
        return asked.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q = query_blocks.select(F.col("block").alias("query_block"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "ints", "turned")))
    v = stored.select("block", *(F.col(c).alias(f"v_{c}") for c in ("ids", "ints", "turned")))

    def against(some: DataFrame, numbers: list[int]) -> DataFrame:
        """Query blocks repeated for each vector block, and joined on its number."""
        span = F.explode(F.sequence(F.lit(min(numbers)), F.lit(max(numbers)))).alias("block")
        return some.select("*", span).join(v, "block")

    first = materialise(_meet(against(q.withColumn("known", F.lit(None).cast("binary")), order[:1]), dims, k))
    if len(order) > 1:

        def known(scores: bytes) -> bytes:
            s = np.frombuffer(scores, "<i8").reshape(-1, k)[:, -1]
            return np.where(s == NONE, -np.inf, s).astype("<f8").tobytes()

        least = first.select("query_block", F.udf(known, "binary")("scores").alias("known"))
        found = first.unionByName(_meet(against(q.join(least, "query_block"), order[1:]), dims, k))
    else:
        found = first

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qid = np.repeat(np.frombuffer(r["q_ids"], "<i8"), k)
                vec, score = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["scores"], "<i8")
                row = (r["query_block"] << 32) + np.repeat(np.arange(len(qid) // k), k)
                on = score != NONE
                yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (qid, row, vec, score)], ["query_id", "row", "vec_id", "score"])

    every = found.join(q.select("query_block", "q_ids"), "query_block").select("query_block", "ids", "scores", "q_ids").mapInArrow(rows, RESULT)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

