import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from cases import awkward, documents, empty, sentence

from tidemark.llm import jaccard, lines
from tidemark.llm.linking import components
from tidemark.llm.wordhash import text_shingles, text_words


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(300, 360)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {n: r for n, r in union(pairs, nodes).items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes():
    texts = ["A b", "a B ", None, "", "x" * 700_000 + " y", "ab", "a", "b", "é É", "a\x0bb\x0cc"]
    got = [len(w) for w in text_words(pa.array(texts))]
    assert got == [2, 2, 0, 0, 2, 1, 1, 1, 2, 3]
    first = [w.tolist() for w in text_words(pa.array(["one Two three", "two", "THREE x"]))]
    assert first[0][1] == first[1][0] and first[0][2] == first[2][0] and first[0][0] != first[0][1]
    assert [len(s) for s in text_shingles(pa.array(["a b c d e f", "a b", "a a a a a a a", ""]), 5)] == [2, 1, 1, 0]


def check_jaccard(rows, got):
    sets = [shingles(t) for _, t in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                links.append((j, i))
    root = union(links, range(len(rows)))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root[i]] = min(doc, least.get(root[i], doc))
    want = Counter((d, len(sets[i]), least.get(root[i])) for i, (d, _) in enumerate(rows))
    assert got == want


def test_jaccard_awkward(spark, monkeypatch):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_jaccard(rows, Counter(tuple(r) for r in jaccard.jaccard_components(docs).collect()))
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_jaccard_clusters(spark, monkeypatch):
    """Chains and groups of near copies around the threshold, in many slots."""
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        words = sentence(rng, rng.randint(20, 60)).split()
        for _ in range(rng.randint(1, 14)):
            words = list(words)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 999)}"
            texts.append(" ".join(words))
    shared = sentence(rng, 30)
    texts += [shared + " " + sentence(rng, rng.randint(5, 40)) for _ in range(40)]
    rng.shuffle(texts)
    monkeypatch.setattr(jaccard, "SLOT_ROWS", 17)
    docs = documents(spark, texts)
    check_jaccard(list(enumerate(texts)), Counter(tuple(r) for r in jaccard.jaccard_components(docs).collect()))


def test_representatives(spark):
    docs = awkward(spark)
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect() if r.doc_id is not None}
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter([*(d for d, c in found.items() if d == c), None])


# --------------------------------------------------------------------------- lines


def brute_lines(rows):
    """Groups of near lines by SimHash distance and edit similarity over all pairs."""
    found, first = {}, {}
    for doc, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            normal = lines.normal_form(line)
            if len(re.findall(r"[a-z0\x80-\U0010ffff]+", normal)) >= lines.MIN_WORDS and len(normal.encode()) >= lines.MIN_BYTES:
                found[doc, no] = normal
    nodes = sorted(set(found.values()))
    sig = {}
    for normal in nodes:
        raw = np.frombuffer(normal.encode(), np.uint8)
        sig[normal] = int(lines.line_hashes(np.array([0, len(raw)]), raw)[3][0])
    links = [(a, b) for a in nodes for b in nodes if a < b and (sig[a] ^ sig[b]).bit_count() <= lines.DISTANCE and lines.similar(a, b, lines.SIMILARITY)]
    root = union(links, nodes)
    for at in found:
        first.setdefault(root[found[at]], []).append(at)
    order = lambda at: (at[0] is None, at[0] or 0, at[1])
    out = set()
    for group in first.values():
        if len(group) > 1:
            top = min(group, key=order)
            out |= {(*at, *top, len(group), at == top) for at in group}
    return out, len(links)


def near_lines(rng):
    long = [sentence(rng, 120) for _ in range(6)]
    texts = []
    for _ in range(25):
        part = []
        for _ in range(rng.randint(1, 6)):
            x = rng.choice(long)
            if rng.random() < 0.5:
                w = x.split()
                w[rng.randrange(len(w))] = "edited"
                x = " ".join(w)
            if rng.random() < 0.3:
                x = x.upper().replace(" ", ",  ")
            part.append(x)
        texts.append("\n".join([*part, "", "short", sentence(rng, 12)]))
    return texts


def test_line_groups(spark):
    texts = near_lines(random.Random(2))
    docs = documents(spark, texts)
    want, links = brute_lines(list(enumerate(texts)))
    assert links > 5
    assert {tuple(r) for r in lines.line_groups(docs).collect()} == want


def test_line_groups_awkward(spark):
    docs = awkward(spark)
    want, _ = brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    got = lines.line_groups(docs).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert lines.line_groups(empty(spark)).count() == 0


def test_without_repeats(spark):
    texts = ["keep this line of words\nagain this line of words\n\nx", "again this line of words\nand one more line here", "Again, this line of words!", None, "", "x"]
    docs = documents(spark, texts)
    out = lines.without_repeats(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {0: (texts[0], len(texts[0])), 1: ("and one more line here", 22), 3: (None, None), 4: ("", 0), 5: ("x", 1)}
    assert lines.without_repeats(empty(spark)).count() == 0


def test_without_repeats_tells_rows_of_one_id_apart(spark):
    """Rows without an id, and rows that repeat one with another text, lose their own repeats alone."""
    shared = "a line that several rows hold"
    texts = [f"{shared}\nthe first document ends with this", *(f"{shared}\n{w}" for w in ("red apples grow on old trees", "seven ships sail without a captain"))]
    texts += ["winter nights are long and very cold", "our bakery opens early every morning", f"music fills the empty concert hall\n{shared}"]
    docs = documents(spark, texts, [1, None, None, None, 2, 2])
    got = sorted((r.doc_id or 0, r.text) for r in lines.without_repeats(docs).collect())
    want = [(1, texts[0]), (2, texts[4]), (2, "music fills the empty concert hall"), *((None, t.removeprefix(f"{shared}\n")) for t in texts[1:4])]
    assert got == sorted((d or 0, t) for d, t in want)
    rows = lines.line_groups(docs).collect()
    assert sorted((r.doc_id is None, r.line_no, r.kept) for r in rows) == [(False, 0, True), (False, 1, False), (True, 0, False), (True, 0, False)]
    assert {r.occurrences for r in rows} == {4}


def test_representatives_of_one_id_with_other_texts(spark):
    a, b = sentence(random.Random(4), 40), sentence(random.Random(5), 40)
    docs = documents(spark, [a, a, b, b, f"{b} more", "one of its own"], [3, 5, 5, 5, 5, 9])
    kept = Counter((r.doc_id, r.text) for r in jaccard.representatives(docs).collect())
    near = [t for t in (b, f"{b} more") if (5, t) in kept]
    assert len(near) == 1 and kept == Counter([(3, a), (5, near[0]), (9, "one of its own")])


def test_lines_of_scripts_without_blanks(spark):
    """Exact and near repeats of lines that have no ASCII blank or punctuation."""
    rng = random.Random(8)
    long = "".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(900))
    near = long[:400] + "変" + long[401:]
    japanese, thai = "これは何度も現れる長い段落です", "นี่คือย่อหน้ายาวที่ปรากฏหลายครั้ง"
    docs = documents(spark, [f"{long}\n{japanese}", f"{near}\n{thai}", f"{japanese}\n{thai}", "短い\n短い", "─" * 20, "─" * 20])
    got = {(r.doc_id, r.line_no, r.first_doc_id, r.first_line_no, r.occurrences) for r in lines.line_groups(docs).collect()}
    assert got == {(0, 0, 0, 0, 2), (1, 0, 0, 0, 2), (0, 1, 0, 1, 2), (2, 0, 0, 1, 2), (1, 1, 1, 1, 2), (2, 1, 1, 1, 2)}


def test_normal_text_agrees(spark):
    texts = ["  A,b 12!", "É x_y", "", "tab\tand\x00nul", "株 Ab9"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "s string").select(lines.normal_text(F.col("s")).alias("t")).collect()]
    assert got == [lines.normal_form(t) for t in texts]


def test_edit_distance():
    rng = random.Random(3)

    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    for _ in range(800):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in "ab")
        assert lines.edit_distance(a, b) == plain(a, b)


@pytest.mark.parametrize("count", [10, 5_000_000, 10**12])
def test_block_masks_catch_every_close_pair(count):
    rng = random.Random(5)
    masks = lines.block_masks(count)
    for _ in range(200):
        x, flips = rng.getrandbits(64), 0
        for bit in rng.sample(range(64), lines.DISTANCE):
            flips |= 1 << bit
        assert any((x & m) == ((x ^ flips) & m) for m in masks)


def test_partners():
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 1 << 62, 50).astype(np.uint64)
    sig = np.concatenate([sig, sig[:5] ^ np.uint64(5), np.full(100, 77, np.uint64)])
    key = sig >> np.uint64(40)
    want = [any(i != j and key[i] == key[j] and (int(sig[i]) ^ int(sig[j])).bit_count() <= 3 for j in range(len(sig))) for i in range(len(sig))]
    assert lines._has_partner(key, sig).tolist() == want


def test_jaccard_many_small_blocks(spark, monkeypatch):
    """A group of near copies in many blocks, of which no single one links to all."""
    from tidemark.llm import linking

    monkeypatch.setattr(linking, "TILE", 3)
    rng = random.Random(11)
    words = sentence(rng, 60).split()
    texts = []
    for _ in range(45):
        copy = list(words)
        for k in rng.sample(range(60), rng.randint(0, 4)):
            copy[k] = f"new{rng.randint(0, 9999)}"
        texts.append(" ".join(copy))
    docs = documents(spark, texts)
    check_jaccard(list(enumerate(texts)), Counter(tuple(r) for r in jaccard.jaccard_components(docs).collect()))


@pytest.mark.parametrize("block", [2, 50, 1 << 13])
def test_overlaps(monkeypatch, block):
    monkeypatch.setattr(jaccard, "COLUMN_BLOCK", block)
    rng = np.random.default_rng(block)
    x, y = ([np.unique(rng.integers(0, 120, rng.integers(1, 90))).astype(np.uint64) for _ in range(n)] for n in (7, 9))
    least = rng.integers(0, 40, (7, 9))
    want = np.array([[len(np.intersect1d(a, b)) for b in y] for a in x])
    assert np.array_equal(jaccard.overlaps(x, y, least), np.where(want >= least, want, 0))
    assert not jaccard.overlaps(x, y, np.full((7, 9), 1000)).any()
