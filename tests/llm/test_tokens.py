import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from cases import awkward, awkward_texts, empty
from tokenizers import Tokenizer

from tidemark.llm import chunktable, packing, pretokens, transducer
from tidemark.llm.idtable import IdTable
from tidemark.llm.wordhash import blocks

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(BYTES)


def noise(seed, n, alphabet):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(n)]


MIXED = [*"abcdeéßñ 株式会社の \n\t▁  .,012<|>'\"-_=\x00😀ethaionrs", "the", "ing", "   ", "        ", "<s>", "ation"]


def test_encode_decode(spark, pieces):
    docs = awkward(spark)
    want = Counter()
    for r in docs.collect():
        ids = pieces.encode(r.text or "")
        text = pieces.decode(ids) if ids else ""
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        want[r.doc_id, len(ids), *digest, tuple(ids), text] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in chunktable.encode_decode(docs, PIECES).collect())
    assert got == want


def test_encode_decode_slots(spark, pieces, monkeypatch):
    texts = noise(1, 400, MIXED)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(chunktable, "SLOT_BYTES", 200)
    got = {r.doc_id: r.ids for r in chunktable.encode_decode(docs, PIECES).collect()}
    assert got == {i: pieces.encode(t) for i, t in enumerate(texts)}
    assert chunktable.encode_decode(empty(spark), PIECES).count() == 0


def test_counts(spark, pieces):
    docs = awkward(spark)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(pieces.encode(r.text or "")), len(pieces.encode(r.text or "")) > 4096) for r in docs.collect())
    assert Counter(tuple(r) for r in transducer.token_counts(docs, PIECES).collect()) == want
    assert transducer.token_counts(empty(spark), PIECES).count() == 0


@pytest.mark.parametrize("chunk", [3, 64, 512])
def test_transducer_chunks(pieces, monkeypatch, chunk):
    monkeypatch.setattr(transducer, "CHUNK", chunk)
    machine = transducer.load(PIECES)
    texts = [*noise(chunk, 200, MIXED), *("a" * n for n in range(0, 300, 61)), *(" " * n for n in range(60)), "株式会社の日本" * 20, "etaoin" * 60, *filter(None, (t and t[:3000] for t in awkward_texts()))]
    got = []
    for _, at, raw in blocks(pa.array(texts)):
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        got += machine.counts(np.searchsorted(np.flatnonzero((raw & 0xC0) != 0x80), at), points).tolist()
    assert got == [len(pieces.encode(t)) for t in texts]


def test_transducer_begins_anew(pieces, monkeypatch):
    machine = transducer.load(PIECES)
    monkeypatch.setattr(transducer, "MAX_STATES", 10)
    points = np.array([ord(c) for c in "some words some words"], np.uint32)
    for _ in range(3):
        assert machine.counts(np.array([0, len(points)]), points).tolist() == [len(pieces.encode("some words some words"))]


def test_pretoken_ids(whole):
    alphabet = [*"aZé9½ \n\t\r'  \"'.,-!<|>sdtmrevl\xa0 株ñß①\x1c\x85😀̀", "'s", "'re", "'ll", " 've", "<|endoftext|>", "\r\n", "   ", " ", "　", "​"]
    texts = [*noise(5, 3000, alphabet), *filter(None, awkward_texts())]
    got = list(pretokens.text_ids(pa.array(texts), BYTES))
    assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_id_table_limit():
    table = IdTable(lambda b: list(b), limit=5)
    for k in range(20):
        raw = np.frombuffer(bytes([k, k + 1, k]), np.uint8)
        entries = table.entries(np.array([k + 1, k + 2, k + 1], np.uint64), raw, np.arange(3), np.arange(1, 4))
        assert table.gather(entries)[0].tolist() == [k, k + 1, k]


def test_pack(spark, whole):
    docs = awkward(spark)
    want = Counter()
    for r in docs.collect():
        want[r.doc_id, tuple([*whole.encode(r.text or "", add_special_tokens=False).ids, 0])] += 1
    rows = packing.pack(docs, BYTES, group_rows=20).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces_ in by_sequence.values():
        at = 0
        for r in sorted(pieces_, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024 and {r.sequence_length for r in pieces_} == {at}
        assert {r.padded_length for r in pieces_} == {at if at & (at - 1) == 0 else 1024}
    cover = Counter((r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in rows)
    expected = Counter()
    for (doc, ids), n in want.items():
        data = np.array(ids, "<u4")
        for a in range(0, len(ids), 1024):
            expected[doc, len(ids), a, len(data[a : a + 1024]), zlib.crc32(data[a : a + 1024])] += n
    assert cover == expected
    assert packing.pack(empty(spark), BYTES).count() == 0


def test_fill_window():
    rng = random.Random(4)
    for _ in range(300):
        counts = Counter(rng.randint(1, 20) for _ in range(rng.randint(1, 12)))
        room = rng.randint(0, 60)
        sums = {0}
        for x in counts.elements():
            sums |= {s + x for s in sums}
        used = packing.fill_window(dict(counts), room)
        assert all(counts[x] >= c for x, c in used.items())
        assert sum(x * c for x, c in used.items()) == max(s for s in sums if s <= room)


def test_pack_lengths_slack():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1024, 3000)
    window, offset, n = packing.pack_lengths(lengths, 1024)
    assert np.bincount(window, weights=lengths).max() <= 1024
    assert n <= 1.02 * lengths.sum() / 1024 + 1
    same, _, n = packing.pack_lengths(np.full(1000, 512), 1024)
    assert n == 500
