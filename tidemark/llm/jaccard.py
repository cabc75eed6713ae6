"""Exact n-gram Jaccard join of whole documents as a blocked product of the document by n-gram incidence.

Rows of the incidence are cut into slots of documents, columns into buckets of n-gram hashes, and each (slot, bucket)
block travels as one compressed list. A bucket counts each column; columns with one document can't add to any
overlap and fall out. Summed over buckets, what is left bounds a document's overlap with every other from above, and
documents below the bound that their size asks for are done. For the others, columns are taken rarest first: a pair
that can reach the similarity meets within the first few columns of both. Blocks of documents that meet are discarded
when the sizes and what is left of both rows bound every overlap below what is needed; for the rest the product of
both blocks' incidences adds up overlap counts, block of columns by block of columns. Documents with equal sets are one class, and a class stands for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.linking import Forest, link_groups
from tidemark.llm.packed import bucket_of, pack_numbers, pack_parts, unpack_numbers, unpack_parts
from tidemark.llm.tables import groups_for, rows_of, unused
from tidemark.llm.wordhash import distinct, text_shingles
from tidemark.session import materialise

SHINGLE = 5
PERCENT = 75  # links: 100 * overlap >= PERCENT * union
SLOT_SHINGLES, SLOT_ROWS = 2_000_000, 50_000
BUCKET_ROWS, LEAST_BUCKETS = 2000, 64
#: A column is the upper 48 bits of the hash; the rest holds the document's number in its slot.
NUMBER_BITS = np.uint64(0xFFFF)

PARTS = "slot long, bucket int, head boolean, data binary, doc_ids array<long>, nodes array<binary>"
PARTS_NAMES = ["slot", "bucket", "head", "data", "doc_ids", "nodes"]
SETS = "doc_id long, n long, node binary, center double, prefix binary, columns binary"
COLUMN_BLOCK = 1 << 13


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], PARTS_NAMES)


def _slot_rows(doc_ids: list, sets: list[np.ndarray], buckets: int) -> list[tuple]:
    """Blocks of one slot, and its head: documents, their numbers of shingles, and digests of their sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
    values = (np.concatenate(sets) & ~NUMBER_BITS) | np.repeat(np.arange(len(sets), dtype=np.uint64), sizes)
    values.sort()
    digest = hashlib.blake2b(repr(doc_ids).encode(), digest_size=8)
    digest.update(values.tobytes())
    slot = int.from_bytes(digest.digest(), "little", signed=True)
    bucket = bucket_of(values, buckets)
    edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    rows = [(slot, slot % buckets, True, pack_numbers(sizes), doc_ids, nodes)]
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        columns = values[a:b] >> np.uint64(16)
        block = pack_parts(pack_numbers(np.diff(columns, prepend=np.uint64(0)), 8), pack_numbers(values[a:b] & NUMBER_BITS, 2))
        rows.append((slot, int(bucket[a]), False, block, None, None))
    return rows


def incidence(docs: DataFrame, shingle: int, buckets: int) -> DataFrame:
    """Blocks of the incidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, sets, size = [], [], 0
        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), text_shingles(batch.column(1), shingle), strict=True):
                doc_ids.append(doc)
                sets.append(found)
                size += len(found)
                if size >= SLOT_SHINGLES or len(sets) >= SLOT_ROWS:
                    yield _batch(_slot_rows(doc_ids, sets, buckets))
                    doc_ids, sets, size = [], [], 0
        if sets:
            yield _batch(_slot_rows(doc_ids, sets, buckets))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PARTS)


def shared_columns(blocks: DataFrame) -> DataFrame:
    """The same blocks with only the columns that several documents have, and how rare each is."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        head = rows["head"].to_pylist()
        found = [unpack_parts(d) for h, d in zip(head, rows["data"].to_pylist(), strict=True) if not h]
        columns = [np.cumsum(unpack_numbers(c, 8), dtype=np.uint64) for c, _ in found]
        every = np.concatenate(columns) if columns else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        by = every[order]
        new = np.ones(len(by), bool)
        new[1:] = by[1:] != by[:-1]
        group = np.cumsum(new) - 1
        count = np.empty(len(by), np.int64)
        count[order] = np.bincount(group)[group] if len(by) else 0
        out, at = [], 0
        for c, (_, numbers) in zip(columns, found, strict=True):
            n = count[at : at + len(c)]
            at += len(c)
            on = n > 1
            rare = np.minimum(np.log2(n[on]), 60).astype(np.uint8)
            kept = pack_numbers(np.diff(c[on], prepend=np.uint64(0)), 8), pack_numbers(unpack_numbers(numbers, 2)[on], 2), pack_numbers(rare, 1)
            out.append(pack_parts(*kept))
        out = iter(out)
        data = pa.array([d if h else next(out) for h, d in zip(head, rows["data"].to_pylist(), strict=True)], pa.binary())
        return rows.set_column(3, "data", data)

    return blocks.groupBy("bucket").applyInArrow(run, PARTS)


def need(size: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a document with any that it links to."""
    return -(-percent * size // 100)


def bounded_sets(blocks: DataFrame, percent: int) -> DataFrame:
    """One row per document: size, digest of its set, and, if its shared columns reach its need, prefix and columns.

    `center` tells how common its shingles are; the original of a group of near copies has the most common ones. `prefix` lists the rarest shared columns, enough that two documents that link have one in common; `columns` lists
    all shared ones in order.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        head = rows["head"].to_pylist()
        copies = sum(head)  # slots that hold the same
        top = head.index(True)
        sizes = unpack_numbers(rows["data"][top].as_py()).astype(np.int64)
        parts = {b: d for b, h, d in zip(rows["bucket"].to_pylist(), head, rows["data"].to_pylist(), strict=True) if not h}
        parts = [unpack_parts(parts[b]) for b in sorted(parts)]
        columns = np.concatenate([np.cumsum(unpack_numbers(c, 8), dtype=np.uint64) for c, _, _ in parts]) if parts else np.zeros(0, np.uint64)
        number = np.concatenate([unpack_numbers(n, 2) for _, n, _ in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        rare = np.concatenate([unpack_numbers(r, 1) for _, _, r in parts]) if parts else np.zeros(0, np.uint8)
        shared = np.bincount(number, minlength=len(sizes))
        center = np.bincount(number, weights=rare, minlength=len(sizes)) / np.maximum(1, sizes)
        least = need(sizes, percent)
        on = (sizes > 0) & (shared >= least)
        take = on[number]
        columns, number, rare = columns[take], number[take], rare[take]
        by_doc = np.argsort(number, kind="stable")
        sorted_columns = columns[by_doc]
        by_rarity = columns[np.lexsort((columns, rare, number))]
        end = np.cumsum(np.where(on, shared, 0))
        prefix, whole = [None] * len(sizes), [None] * len(sizes)
        for k in np.flatnonzero(on).tolist():
            a, b = end[k] - shared[k], end[k]
            whole[k] = sorted_columns[a:b].tobytes()
            prefix[k] = by_rarity[a : a + max(0, shared[k] - least[k] + 1)].tobytes()
        out = {"doc_id": rows["doc_ids"][top].as_py(), "n": sizes, "node": rows["nodes"][top].as_py(), "center": center, "prefix": prefix, "columns": whole}
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.binary(), pa.binary()]
        made = pa.table([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], names=list(out))
        return pa.concat_tables([made] * copies)

    return blocks.groupBy("slot").applyInArrow(run, SETS)


def _entries(classes: DataFrame) -> DataFrame:
    """Columns of each class's prefix, with its size and how many of its shingles are left from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = [np.frombuffer(p, "<i8") for p in batch.column(3).to_pylist()]
            length = np.fromiter(map(len, prefix), np.int64, len(prefix))
            row = np.repeat(np.arange(len(prefix)), length)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            shared = np.fromiter((len(c) // 8 for c in batch.column(4).to_pylist()), np.int64, len(prefix))
            g = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(g), *(batch.column(c).take(at) for c in (0, 1, 2)), pa.array(shared[row] - rank)], ["g", "node", "n", "rank", "rest"])

    found = classes.select("node", "n", "center", "prefix", "columns").mapInArrow(run, "g long, node binary, n long, rank double, rest long")
    # documents that link differ by less than one band and the next in size
    return found.withColumn("band", F.floor(F.log(F.col("n")) / F.lit(float(np.log(4 / 3)))).cast("int"))


def _may(percent: int):
    """Whether a link is possible between documents that meet in a column: by their sizes, and by what is left in both."""

    def test(x: str, y: str) -> Column:
        left = F.least(f"{x}_rest", f"{y}_rest")
        alike = 100 * F.least(f"{x}_most", f"{y}_most") >= percent * F.greatest(f"{x}_least", f"{y}_least")
        return alike & ((100 + percent) * left >= percent * (F.col(f"{x}_least") + F.col(f"{y}_least")))

    return test


def overlaps(x: list[np.ndarray], y: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """Numbers of common columns of all pairs, summed over blocks of columns; 0 for pairs that were discarded.

    A block adds the product of both incidences. When no pair can reach its least overlap with the columns left, the
    rest isn't multiplied.
    """
    size = [np.fromiter(map(len, s), np.int64, len(s)) for s in (x, y)]
    flat = [np.concatenate(s) for s in (x, y)]
    known = np.intersect1d(distinct(np.sort(flat[0])), distinct(np.sort(flat[1])), assume_unique=True)
    place = [np.searchsorted(known, f) for f in flat]
    both = [(p < len(known)) & (known[np.minimum(p, max(0, len(known) - 1))] == f) if len(known) else np.zeros(len(f), bool) for p, f in zip(place, flat, strict=True)]
    row = [np.repeat(np.arange(len(s)), s)[b] for s, b in zip(size, both, strict=True)]
    place = [p[b] for p, b in zip(place, both, strict=True)]
    left = [np.bincount(r, minlength=len(s)) for r, s in zip(row, size, strict=True)]
    total = np.zeros((len(x), len(y)))
    for a in range(0, len(known), COLUMN_BLOCK):
        if not (total + np.minimum(left[0][:, None], left[1][None, :]) >= least).any():
            return np.zeros_like(total)
        part = []
        for k in (0, 1):
            on = (place[k] >= a) & (place[k] < a + COLUMN_BLOCK)
            m = np.zeros((len(size[k]), min(COLUMN_BLOCK, len(known) - a)), np.float32)
            m[row[k][on], place[k][on] - a] = 1
            left[k] = left[k] - np.bincount(row[k][on], minlength=len(size[k]))
            part.append(m)
        total += part[0] @ part[1].T
    return np.where(total >= least, total, 0)


def _tile(percent: int):
    """Links between the documents of two blocks."""

    def links(a: pa.Table, b: pa.Table, forest: Forest) -> Iterator[tuple]:
        sides = [(t["node"].to_pylist(), t["n"].to_numpy(), [np.frombuffer(c, "<u8") for c in t["columns"].to_pylist()]) for t in (a, b)]
        (xs, nx, cx), (ys, ny, cy) = sides
        least = -(-percent * (nx[:, None] + ny[None, :]) // (100 + percent))
        for i, j in zip(*(k.tolist() for k in np.nonzero(overlaps(cx, cy, least))), strict=True):
            if forest.add(xs[i], ys[j]):
                yield xs[i], ys[j]

    return links


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach, of every document.

    `docs` has doc_id and text; other columns are ignored. Words are runs without blanks, A-Z lower-cased; a document
    with fewer than `shingle` words has all of them as its one shingle. Null and empty texts have none, link with
    nothing and are their own component. Repeated rows give repeated rows; a null doc_id stays null, is linked like
    others, and names no component unless it is alone. An empty table gives no rows. Shingles are compared by 48 bits
    of their hashes within a pair and 64 bits within a document. Groups of copies are one class; large groups of near
    copies are compared block by block and yield a forest of links, so no step emits all pairs of a group.
    """
    buckets = groups_for(rows_of(docs), BUCKET_ROWS, LEAST_BUCKETS)
    sets = materialise(bounded_sets(shared_columns(incidence(docs, shingle, buckets)), percent))
    near = sets.where(F.col("columns").isNotNull())
    classes = materialise(near.select("node", "n", "center", "prefix", "columns").dropDuplicates(["node"]))
    bounds = {"rest": F.max("rest"), "least": F.min("n"), "most": F.max("n")}
    labels = link_groups(_entries(classes), classes.select("node", "n", "columns"), bounds, _may(percent), _tile(percent))
    member = near.select("doc_id", "n", "node").join(labels, "node", "left").select("doc_id", "n", F.coalesce("label", "node").alias("label"))
    member = materialise(member)
    least = materialise(member.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    linked = member.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sets.where(F.col("columns").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return alone.unionByName(linked)


def representatives(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, all columns, that stand for their component: those of the smallest doc_id.

    Rows that repeat a doc_id with another text are documents of their own, each in its text's component. Of rows
    that repeat both one stays, whichever its other columns; rows without a doc_id can't be told apart and stay.
    """
    doc_id, key = F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    k, wanted = unused(docs, "key", "wanted")  # columns beside those of the table
    found = materialise(jaccard_components(docs.select(key.alias("doc_id"), "text"), shingle, percent))
    found = found.groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("component"), F.count(F.lit(1)).alias("rows"))
    ids = docs.where(doc_id.isNotNull()).select(doc_id.alias("id"), key.alias("key")).distinct()
    named = materialise(found.join(ids, "key"))
    first = named.groupBy("component").agg(F.min_by(F.struct("key", "rows"), F.struct("id", "key")).alias("first"))
    keep = materialise(first.select("first.*"))
    some = docs.where(doc_id.isNotNull()).withColumn(k, key)
    out = some.join(keep.where("rows = 1").select(F.col("key").alias(wanted)), F.col(k) == F.col(wanted), "left_semi").drop(k)
    if not keep.where("rows > 1").isEmpty():
        again = some.join(keep.where("rows > 1").select(F.col("key").alias(wanted)), F.col(k) == F.col(wanted), "left_semi")
        out = out.unionByName(again.dropDuplicates([k]).drop(k))
    if not docs.where(doc_id.isNull()).isEmpty():
        out = out.unionByName(docs.where(doc_id.isNull()))
    return out
