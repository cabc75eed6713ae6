"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, connected groups.

A line is normalised to its words: runs of letters, digits and non-ASCII bytes, A-Z lower-cased, digits alike. Lines
with equal words are one node. Nodes get a 64-bit SimHash over their words, longer words weighing more. Two SimHashes
within DISTANCE bits agree in all but DISTANCE of the BLOCKS blocks, so they meet under one choice of blocks. Nodes
that meet a partner within that distance are linked if their edit similarity is high enough, and of each connected
group the first occurrence stays.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.linking import Forest, link_groups
from tidemark.llm.packed import bucket_of, pack_numbers, pack_parts, unpack_numbers, unpack_parts
from tidemark.llm.tables import arrow_rows, groups_for, unused
from tidemark.llm.wordhash import MIX_1, MIX_2, blocks, hash_ranges, hash_runs, mix, word_ranges
from tidemark.session import materialise

BITS, DISTANCE = 64, 3
#: Blocks whose agreement is asked for have this many bits beyond those that tell all nodes apart.
SPARE_BITS = 4
SIMILARITY = 0.9
#: Shorter lines are never duplicates: blank ones, rules, single words. Two characters of a script without blanks count
#: as a word.
MIN_WORDS, MIN_BYTES = 3, 12
LONGEST_WEIGHT = 8
GROUP_PAIRS = 64  # larger groups are not searched for partners before they are linked
SLOT_NODES = 1 << 18
BUCKET_NODES, LEAST_BUCKETS = 16_000, 64

#: Bytes between words: ASCII but for letters and digits.
_SPACE = np.ones(256, bool)
_SPACE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: First bytes of characters of three bytes, but for general punctuation, symbols and box drawing.
_WIDE = np.zeros(256, bool)
_WIDE[[0xE0, 0xE1, *range(0xE3, 0xEE)]] = True
_FOLDED = np.arange(256)
_FOLDED[65:91] += 32
_FOLDED[48:58] = 48
_TABLE = mix(_FOLDED.astype(np.uint64) + np.uint64(0x1F123BB5))

LINES = "doc_id long, key long, line_no long, node long, sig long"
PARTS = "slot long, bucket int, data binary"


def normal_form(line: str) -> str:
    """The text whose edits count: words as they are hashed, joined by blanks."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), re.sub("[0-9]", "0", line))
    return " ".join(re.findall(r"[a-z0\x80-\U0010ffff]+", lowered))


def simhash(words: np.ndarray, weights: np.ndarray, start: np.ndarray) -> np.ndarray:
    """SimHash of each run of word hashes that begins at `start`: sign of the weighted sum of each bit."""
    out = np.empty(len(start), np.uint64)
    edges = np.append(start, len(words))
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + 65536, "right")) - 1)
        a, b = int(edges[i]), int(edges[j])
        bits = np.unpackbits(words[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = (bits.astype(np.int16) * 2 - 1) * weights[a:b, None]
        total = np.add.reduceat(votes, edges[i:j] - a, axis=0, dtype=np.int32)
        out[i:j] = np.packbits(total > 0, axis=1, bitorder="little").view("<u8").ravel()
        i = j
    return out


def _wide_simhash(raw, wide, start, end, hashes, weight, lo, pick, size) -> np.ndarray:
    """SimHash of lines with wide characters: neighbours among them take the place of the words that hold them."""
    gram = wide[:-1][np.diff(wide) == 3]
    word = np.searchsorted(start, gram, "right") - 1
    line = np.full(len(start), -1)
    line[pick] = np.repeat(np.arange(len(lo)), size)
    on = (line[word] >= 0) & (gram + 6 <= end[word]) if len(gram) else np.zeros(0, bool)
    gram, word = gram[on], word[on]
    # neighbours overlap, so every other one is hashed at a time
    found = np.empty(len(gram), np.uint64)
    for k in (0, 1):
        found[k::2] = hash_ranges(raw, gram[k::2], gram[k::2] + 6, table=_TABLE)
    left = np.ones(len(start), bool)
    left[word] = False
    rest = pick[left[pick]]
    of = np.concatenate([line[rest], line[word]])
    order = np.argsort(of, kind="stable")
    votes = np.concatenate([weight[rest], np.full(len(gram), 4, np.int16)])[order]
    return simhash(np.concatenate([hashes[rest], found])[order], votes, np.searchsorted(of[order], np.arange(len(lo))))


def line_hashes(at: np.ndarray, raw: np.ndarray, signed: bool = True) -> tuple[np.ndarray, ...]:
    """Text, line number, node, SimHash if `signed`, start and end byte of every line that takes part."""
    newline = np.flatnonzero(raw == 10)
    first = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], (newline + 1)[~np.isin(newline + 1, at)]]))
    start, end = word_ranges(at, raw, _SPACE)
    hashes = hash_ranges(raw, start, end, table=_TABLE)
    lo = np.searchsorted(start, first)
    hi = np.append(lo[1:], len(start))
    last = np.append(first[1:], len(raw))
    letters = np.concatenate([[0], np.cumsum(end - start)])
    wide = np.flatnonzero(_WIDE[raw])
    many = hi - lo
    if len(wide):
        many = many + (np.searchsorted(wide, last) - np.searchsorted(wide, first)) // 2
    on = (many >= MIN_WORDS) & (hi > lo) & (letters[hi] - letters[lo] + hi - lo - 1 >= MIN_BYTES) if len(first) else np.zeros(0, bool)
    text = np.searchsorted(at, first, "right") - 1
    number = np.searchsorted(newline, first) - np.searchsorted(newline, at[text])
    lo, hi = lo[on], hi[on]
    node = hash_runs(mix(hashes ^ np.uint64(MIX_1)), lo, hi)
    if not signed:
        return text[on], number[on], node, None, first[on], last[on]
    weight = np.clip(end - start - 2, 1, LONGEST_WEIGHT).astype(np.int16)
    # lines that take part are not adjacent in general, so words are picked first
    size = hi - lo
    begin = np.cumsum(size) - size
    pick = np.repeat(lo - begin, size) + np.arange(size.sum())
    if len(wide) and len(lo):
        sig = _wide_simhash(raw, wide, start, end, hashes, weight, lo, pick, size)
    else:
        sig = simhash(hashes[pick], weight[pick], begin) if len(lo) else np.zeros(0, np.uint64)
    return text[on], number[on], node, sig, first[on], last[on]


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _key() -> Column:
    """With doc_id, what tells documents apart: ids may be missing, or repeat with another text."""
    return F.xxhash64(F.col("text").cast("string"))


def lines_of(docs: DataFrame) -> DataFrame:
    """One row per line that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            for row, at, raw in blocks(batch.column(1)):
                text, number, node, sig, _, _ = line_hashes(at, raw)
                of = pa.array(text + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), batch.column(2).take(of), pa.array(number), pa.array(node.view(np.int64)), pa.array(sig.view(np.int64))], ["doc_id", "key", "line_no", "node", "sig"]
                )

    return _text(docs).withColumn("key", _key()).mapInArrow(run, LINES)


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Normal form of each of the nodes: columns node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            for _, at, raw in blocks(batch.column(1)):
                _, _, node, _, start, end = line_hashes(at, raw, signed=False)
                data = raw.tobytes()
                _, once = np.unique(node, return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[once].view(np.int64)), pa.array([data[a:b].decode() for a, b in zip(start[once].tolist(), end[once].tolist(), strict=True)], pa.string())], ["node", "text"]
                )

    lines = _text(docs).mapInArrow(run, "node long, text string")
    # the same plan whether the nodes are few or many
    return lines.join(nodes.hint("shuffle_merge"), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))


def block_masks(nodes: int) -> list[int]:
    """Bits that agree for some choice of blocks; more and smaller blocks as there are more nodes to tell apart.

    The pairs within DISTANCE bits are the same for every choice of BLOCKS.
    """
    want = math.log2(max(nodes, 2)) + SPARE_BITS
    count = next((b for b in range(DISTANCE + 1, BITS) if BITS * (b - DISTANCE) / b >= want), BITS)
    edge = [BITS * i // count for i in range(count + 1)]
    part = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(count)]
    return [sum(c) for c in combinations(part, count - DISTANCE)]


def block_keys(sig: np.ndarray, masks: list[int]) -> np.ndarray:
    """Key of each signature under each choice of blocks, one column for each."""
    out = np.empty((len(sig), len(masks)), np.uint64)
    for i, m in enumerate(masks):
        out[:, i] = mix(mix(sig & np.uint64(m)) ^ np.uint64(i * MIX_2 & 0xFFFFFFFFFFFFFFFF))
    return out


def _has_partner(key: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Whether another signature of the same key is within DISTANCE bits; True throughout large groups."""
    order = np.argsort(key, kind="stable")
    by, s = key[order], sig[order]
    found = np.zeros(len(by), bool)
    for step in range(1, GROUP_PAIRS):
        same = by[step:] == by[:-step]
        if not same.any():
            break
        near = np.flatnonzero(same)
        near = near[np.bitwise_count(s[near] ^ s[near + step]) <= DISTANCE]
        found[near] = found[near + step] = True
    else:
        near = np.flatnonzero(by[GROUP_PAIRS:] == by[:-GROUP_PAIRS]) if len(by) > GROUP_PAIRS else np.zeros(0, np.int64)
        edge = np.searchsorted(by, by[near]), np.searchsorted(by, by[near], "right")
        for a, b in set(zip(*(e.tolist() for e in edge), strict=True)):
            found[a:b] = True
    out = np.empty(len(by), bool)
    out[order] = found
    return out


def near_nodes(nodes: DataFrame, count: int) -> DataFrame:
    """Entries (g, node, sig) of the nodes that meet a partner within DISTANCE bits under some choice of blocks.

    Keys and signatures of a slot's nodes go to buckets of keys as compressed lists; a bucket answers with one bit for
    each. `nodes` is a stored table.
    """
    masks = block_masks(count)
    buckets = groups_for(count, BUCKET_NODES, LEAST_BUCKETS)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        held = pa.Table.from_batches(list(batches), pa.schema([("node", pa.int64()), ("sig", pa.int64())]))
        for i in range(0, held.num_rows, SLOT_NODES):
            part = held.slice(i, SLOT_NODES)
            node, sig = (part[c].to_numpy().view(np.uint64) for c in ("node", "sig"))
            yield int.from_bytes(hashlib.blake2b(node.tobytes(), digest_size=8).digest(), "little", signed=True), node, sig

    def in_order(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = block_keys(sig, masks).ravel()
        order = np.argsort(key, kind="stable")
        return key[order], order // len(masks)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, _, sig in slots(batches):
            key, row = in_order(sig)
            bucket = bucket_of(key, buckets)
            edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            rows = [
                (slot, int(bucket[a]), pack_parts(pack_numbers(np.diff(key[a:b], prepend=np.uint64(0)), 8), pack_numbers(sig[row[a:b]], 8)))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)
            ]
            yield _parts(rows)

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        found = [[unpack_numbers(p, 8) for p in unpack_parts(d)] for d in rows["data"].to_pylist()]
        keys, sigs = [np.cumsum(k, dtype=np.uint64) for k, _ in found], [s for _, s in found]
        near = _has_partner(np.concatenate(keys), np.concatenate(sigs))
        edge = np.cumsum([0, *map(len, keys)])
        data = [pack_numbers(np.packbits(near[a:b]), 1) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        sizes = [len(k).to_bytes(8, "little") for k in keys]
        return pa.table([rows["slot"], rows["bucket"], pa.array([n + d for n, d in zip(sizes, data, strict=True)], pa.binary())], names=["slot", "bucket", "data"])

    def _parts(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.binary()], strict=True)], ["slot", "bucket", "data"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(slot, -1, pack_parts(pack_numbers(node, 8), pack_numbers(sig, 8))) for slot, node, sig in slots(batches)]
        if rows:
            yield _parts(rows)

    def choose(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        data = rows["data"].to_pylist()
        node, sig = (unpack_numbers(p, 8) for p in unpack_parts(data[0]))
        bits = [np.unpackbits(unpack_numbers(d[8:], 1), count=int.from_bytes(d[:8], "little")) for d in data[1:]]
        near = np.concatenate(bits).astype(bool)
        key_, row = in_order(sig)
        return pa.table({"g": key_[near].view(np.int64), "node": node[row[near]].view(np.int64), "sig": sig[row[near]].view(np.int64)})

    nodes = nodes.select("node", "sig")
    answers = nodes.mapInArrow(ask, PARTS).groupBy("bucket").applyInArrow(answer, PARTS)
    return answers.unionByName(nodes.mapInArrow(lists, PARTS)).groupBy("slot").applyInArrow(choose, "g long, node long, sig long")


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel over the longer text; common ends are cut off first."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, distance = mask, 0, len(a)
    for c in b:
        hit = where.get(c, 0)
        diagonal = (((hit & plus) + plus) ^ plus) | hit | minus
        up, down = minus | ~(diagonal | plus) & mask, plus & diagonal
        distance += (up & top > 0) - (down & top > 0)
        up, down = (up << 1 | 1) & mask, down << 1 & mask
        plus, minus = down | ~(diagonal | up) & mask, up & diagonal
    return distance


def similar(a: str, b: str, least: float) -> bool:
    """Whether 1 - distance / longer length is at least `least`."""
    longer = max(len(a), len(b))
    return abs(len(a) - len(b)) <= (1 - least) * longer + 1e-9 and edit_distance(a, b) <= (1 - least) * longer + 1e-9


def line_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Every occurrence of a line that occurs again, alike or nearly: doc_id, line_no (from 0, lines end with LF),
    first_doc_id and first_line_no of its group's first occurrence, occurrences of the group, whether it is the kept one.

    `docs` has doc_id and text and is a table, as its texts are read twice; other columns are ignored. Lines of fewer
    than MIN_WORDS words or MIN_BYTES normalised bytes take no part, so null and empty texts have none. Rows with equal
    doc_id and text are the same document, whose lines are one occurrence; rows that share an id, or have none, and
    differ in text are documents of their own. A null doc_id comes last. An empty table gives no
    rows. Equal lines are one node before anything is compared; a group of near lines
    is compared block by block and yields a forest of links.
    """
    return _grouped(docs, similarity).drop("key")


def _grouped(docs: DataFrame, similarity: float) -> DataFrame:
    """`line_groups` with the key of each occurrence's document."""
    lines = materialise(lines_of(docs).distinct())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "line_no")
    nodes = materialise(lines.groupBy("node").agg(F.min("sig").alias("sig"), F.min(order).alias("first"), F.count(F.lit(1)).alias("n")))
    entries = materialise(near_nodes(nodes, nodes.count()))
    texts = materialise(texts_of(docs, materialise(entries.select("node").distinct())).select("node", normal_text(F.col("text")).alias("text")))

    def links(a: pa.Table, b: pa.Table, forest: Forest) -> Iterator[tuple]:
        (xs, sx, tx), (ys, sy, ty) = ((t["node"].to_pylist(), t["sig"].to_numpy(), t["text"].to_pylist()) for t in (a, b))
        near = np.bitwise_count(sx[:, None].view(np.uint64) ^ sy[None, :].view(np.uint64)) <= DISTANCE
        for i, j in zip(*(k.tolist() for k in np.nonzero(near)), strict=True):
            if forest.root(xs[i]) != forest.root(ys[j]) and similar(tx[i], ty[j], similarity):
                forest.add(xs[i], ys[j])
                yield xs[i], ys[j]

    contents = materialise(texts.join(nodes.select("node", "sig"), "node").select("node", "sig", "text"))
    # no block of nodes is shut out beforehand
    everywhere = entries.select("g", "node", F.lit(0.0).alias("rank"), F.lit(0).alias("band"))
    labels = link_groups(everywhere, contents, {}, lambda x, y: F.lit(True), links)
    joined = nodes.join(labels, "node", "left").select("node", "first", "n", F.coalesce("label", "node").alias("label"))
    joined = materialise(joined)
    groups = joined.groupBy("label").agg(F.min("first").alias("first"), F.sum("n").alias("occurrences")).where("occurrences > 1")
    groups = materialise(groups.select("label", F.col("first.doc_id").alias("first_doc_id"), F.col("first.key").alias("first_key"), F.col("first.line_no").alias("first_line_no"), "occurrences"))
    of_node = materialise(joined.select("node", "label").join(groups, "label").drop("label"))
    kept = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("key") == F.col("first_key")) & (F.col("line_no") == F.col("first_line_no"))
    return lines.join(of_node, "node").select("doc_id", "key", "line_no", "first_doc_id", "first_line_no", "occurrences", kept.alias("kept"))


def normal_text(text: Column) -> Column:
    """`normal_form` as a column."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz" + "0" * 9)
    return F.trim(F.regexp_replace(folded, r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " "))


def without_repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without the lines that repeat an earlier one; documents that lose all they held go.

    All columns stay, whatever their names; n_chars, where there is one, is counted anew for texts that change. See
    `line_groups` for what repeats, and for ties: the occurrence with the smallest doc_id stays, null ids last, then the
    one first by its text's hash and line number. Equal rows are one document and all keep or lose the same
    lines. Documents that had no text, null or empty, stay as they are; an empty table stays empty.
    """
    gone = _grouped(docs, similarity).where(~F.col("kept"))
    doc_id, key, lost = unused(docs, "doc_id_", "key", "lost")
    gone = gone.groupBy(F.col("doc_id").alias(doc_id), F.col("key").alias(key)).agg(F.collect_set(F.col("line_no").cast("int")).alias(lost))
    gone = materialise(gone)
    same = (_key() == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id))
    joined = docs.join(gone, same, "left")
    changed = F.col(lost).isNotNull()
    left = F.filter(F.split(F.col("text"), "\n", -1), lambda line, i: ~F.array_contains(lost, i))
    out = joined.withColumn("text", F.when(changed, F.array_join(left, "\n")).otherwise(F.col("text")))
    out = out.where(~changed | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
