"""SentencePiece BPE over whole corpora through a table of distinct marked words.

Pieces of the models at hand never cross a white-space mark that follows another character, so a text falls into
chunks, runs of marks with what follows them, that are segmented alone. A slot, some megabytes of documents of one
input partition, sends each of its distinct chunks once to the chunk's bucket; a bucket segments each distinct chunk
once and answers every slot in order; the slot's documents, kept as positions in its list of chunks, take the ids.
Texts are not shuffled: what moves is distinct chunks per slot, their ids, and compressed positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.packed import bucket_of, deflate, inflate, pack_numbers, pack_parts, unpack_numbers, unpack_parts
from tidemark.llm.spmodel import mergeable_pieces
from tidemark.llm.tables import groups_for, rows_of
from tidemark.llm.wordhash import blocks, hash_ranges

MARK = "▁".encode()
SLOT_BYTES = 16 << 20
BUCKET_ROWS = 2000
LEAST_BUCKETS = 64

PARTS = "slot long, bucket int, data binary, doc_ids array<long>, chunks array<long>"
PARTS_NAMES = ["slot", "bucket", "data", "doc_ids", "chunks"]
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"

_models: dict = {}


def load(path: str):
    """The model, one per Python worker, once it is known that chunks can be segmented alone."""
    if path not in _models:
        import sentencepiece

        mergeable_pieces(path)
        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def chunk_ranges(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each chunk without its first mark; a text's first mark is implied."""
    blank = raw == 32
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    head = at[:-1][np.diff(at) > 0]
    begins[head] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(raw))[: len(start)]
    first = np.zeros(len(raw) + 1, bool)
    first[head] = True
    return start + ~first[start], end


class Slot:
    """Chunks of some megabytes of documents."""

    def __init__(self) -> None:
        self.doc_ids: list[int | None] = []
        self.chunks: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.words: dict[int, bytes] = {}
        self.size = 0

    def add(self, ids: list[int | None], at: np.ndarray, raw: np.ndarray, words: bool) -> None:
        data = raw.tobytes()
        if MARK in data:  # a mark in the text is the same as a blank
            texts = [data[a:b].replace(MARK, b" ") for a, b in zip(at[:-1], at[1:], strict=True)]
            at = np.cumsum([0, *map(len, texts)])
            data = b"".join(texts)
            raw = np.frombuffer(data, np.uint8)
        start, end = chunk_ranges(at, raw)
        hashes = hash_ranges(raw, start, end)
        self.doc_ids += ids
        self.chunks.append(np.diff(np.searchsorted(end, at, "right")))
        self.hashes.append(hashes)
        self.size += len(raw)
        if words:
            order = np.argsort(hashes, kind="stable")
            by = hashes[order]
            new = np.ones(len(by), bool)
            new[1:] = by[1:] != by[:-1]
            for h, k in zip(by[new].tolist(), order[new].tolist(), strict=True):
                if h not in self.words:
                    self.words[h] = data[start[k] : end[k]]

    def finish(self, buckets: int, words: bool) -> Iterator[tuple]:
        """Rows of PARTS: a list of chunks for each bucket, or positions. A slot is named by a digest of what it holds."""
        hashes = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        by = hashes[order]
        new = np.ones(len(by), bool)
        new[1:] = by[1:] != by[:-1]
        known = by[new]
        digest = hashlib.blake2b(repr(self.doc_ids).encode(), digest_size=8)
        digest.update(hashes.tobytes())
        slot = int.from_bytes(digest.digest(), "little", signed=True)
        if words:
            bucket = bucket_of(known, buckets)
            edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                texts = [self.words[h] for h in known[a:b].tolist()]
                size = np.fromiter(map(len, texts), np.uint32, len(texts))
                yield slot, int(bucket[a]), pack_parts(pack_numbers(size), deflate(b"".join(texts))), None, None
        else:
            rank = np.cumsum(new) - 1
            often = np.argsort(-np.bincount(rank, minlength=len(known)), kind="stable")
            place = np.empty(len(known), np.int64)
            place[often] = np.arange(len(known))
            position = np.empty(len(hashes), np.int64)
            position[order] = place[rank]
            yield slot, -1, pack_parts(pack_numbers(often), pack_numbers(position)), self.doc_ids, np.concatenate(self.chunks).tolist()


def _spell(docs: DataFrame, buckets: int, words: bool) -> DataFrame:
    """Chunk lists for buckets, or positions, of each slot."""

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], PARTS_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = Slot()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, at, raw in blocks(batch.column(1)):
                slot.add(ids[row : row + len(at) - 1], at, raw, words)
                if slot.size >= SLOT_BYTES:
                    yield rows(list(slot.finish(buckets, words)))
                    slot = Slot()
        if out := list(slot.finish(buckets, words)) if slot.doc_ids else []:
            yield rows(out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PARTS)


def _segment(parts: DataFrame, model: str) -> DataFrame:
    """Ids of each listed chunk: each distinct chunk of a bucket is segmented once."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        sp = load(model)
        alone = sp.piece_to_id("▁")
        lists, index = [], {}
        for data in rows["data"].to_pylist():
            size, text = unpack_parts(data)
            end = np.cumsum(unpack_numbers(size), dtype=np.int64)
            text = inflate(text)
            lists.append([index.setdefault(text[b - n : b], len(index)) for b, n in zip(end.tolist(), np.diff(end, prepend=0).tolist(), strict=True)])
        known = sp.encode([w.decode() for w in index], num_threads=1)
        known = [ids or [alone] for ids in known]
        count = np.fromiter(map(len, known), np.int64, len(known))
        flat = np.fromiter((i for ids in known for i in ids), np.uint32, int(count.sum()))
        first = np.cumsum(count) - count
        out = []
        for chunks in lists:
            n = count[chunks]
            before = np.cumsum(n) - n
            ids = flat[np.repeat(first[chunks] - before, n) + np.arange(n.sum())]
            out.append(pack_parts(pack_numbers(n), pack_numbers(ids)))
        empty = pa.nulls(rows.num_rows, pa.list_(pa.int64()))
        return pa.table([rows["slot"], rows["bucket"], pa.array(out, pa.binary()), empty, empty], names=PARTS_NAMES)

    return parts.groupBy("bucket").applyInArrow(run, PARTS)


def encode_decode(docs: DataFrame, model: str, keep: bool = True) -> DataFrame:
    """Ids of every whole text as the sentencepiece library gives them, and the text it decodes from them.

    `docs` has doc_id and text and is a table, or another source whose partitions read the same twice, as it is read
    for chunks and for positions; a difference is noticed and raised. Other columns are ignored. A null text counts as
    empty and has no ids. Repeated rows give repeated rows; an empty table gives none. Without `keep`, `ids` and
    `decoded` are null and only their digests are made. A frequent chunk is sent once by each slot, so none is hot.
    """
    buckets = groups_for(rows_of(docs), BUCKET_ROWS, LEAST_BUCKETS)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        sp = load(model)
        rows = rows.sort_by("bucket")
        bucket, data = rows["bucket"].to_pylist(), rows["data"].to_pylist()
        copies = bucket.count(-1)  # slots that hold the same
        answers = [[unpack_numbers(p) for p in unpack_parts(d)] for d in dict(zip(bucket[copies:], data[copies:], strict=True)).values()]
        if not copies or sum(len(n) for n, _ in answers) != len(unpack_numbers(unpack_parts(data[0])[0])):
            raise RuntimeError("the documents were not the same when they were read again")
        often, position = map(unpack_numbers, unpack_parts(data[0]))
        count = np.concatenate([n for n, _ in answers]).astype(np.int64) if answers else np.zeros(0, np.int64)
        flat = np.concatenate([i for _, i in answers]) if answers else np.zeros(0, np.uint32)
        end = np.cumsum(count)
        whole = list(map(str, flat.tolist()))
        texts = [",".join(whole[b - n : b]) for b, n in zip(end[often].tolist(), count[often].tolist(), strict=True)]
        first, count = (end - count)[often], count[often]
        out, at = [], 0
        for doc, n in zip(rows["doc_ids"][0].as_py(), rows["chunks"][0].as_py(), strict=True):
            chunks = position[at : at + n].astype(np.int64)
            at += n
            size = count[chunks]
            total = int(size.sum())
            before = np.cumsum(size) - size
            ids = flat[np.repeat(first[chunks] - before, size) + np.arange(total)].tolist()
            text = sp.decode(ids) if ids else ""
            spelled = ",".join([texts[k] for k in chunks.tolist()])
            out.append((doc, total, hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids if keep else None, text if keep else None))
        out *= copies
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        names = [c.split()[0] for c in RESULT.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    answers = _segment(_spell(docs, buckets, True), model)
    return answers.unionByName(_spell(docs, buckets, False)).groupBy("slot").applyInArrow(run, RESULT)
