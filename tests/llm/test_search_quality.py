import math
import random

import numpy as np
import pytest
from cases import awkward, documents, empty, sentence
from pyspark.sql import functions as F

from tidemark.llm import innerproduct, quality

VECTORS = "vec_id long, embedding array<double>, label int, block long, ids string, score string, row string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", "y", "z") for i, v in rows], VECTORS)


def brute(rows, k=10):
    fit = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(fit):
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for m, (j, w) in enumerate(fit) if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def search(spark, rows, k=10):
    table = vectors(spark, rows)
    return sorted(tuple(r) for r in innerproduct.top_inner_products(table, table.where(F.col("vec_id") % 100 == 0), k).collect())


@pytest.mark.parametrize("kind", ["spread", "ties", "long tail"])
def test_search_is_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(innerproduct, "VECTOR_BLOCK", 200)
    monkeypatch.setattr(innerproduct, "QUERY_BLOCK", 4)
    monkeypatch.setattr(innerproduct, "RUN", 37)
    rng = np.random.default_rng(2)
    m = rng.normal(size=(900, 40)) * (np.linspace(1, 0.02, 40) if kind != "ties" else 1)
    if kind == "ties":
        m = np.round(m[:, :3])
        m[200:600] = m[5]
    if kind == "long tail":
        m *= rng.pareto(2, size=(900, 1)) + 0.1
    rows = list(enumerate(m.tolist()))
    assert search(spark, rows) == brute(rows)


def test_search_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, -2.0]), (100, [0.5]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [1.0, inf]), (5, []), (6, [3.0, 1.0, 7.0]), (7, [-0.0001, 0.0]),
        (200, None), (None, [1.0, 1.0]), (8, [0.5]), (8, [0.5]), (300, []), (-100, [1.0]),
    ]
    # shorter vectors count as filled with zeros, as zip() does in the brute-force version
    assert search(spark, rows) == brute(rows)
    assert search(spark, [(0, [1.0])]) == [] and search(spark, []) == []
    assert len(search(spark, rows, 2)) == 8


def test_search_keeps_large_components(spark, monkeypatch):
    """Components of 2**20 and more, scores beyond 2**53 with ties, and a refusal beyond a long."""
    monkeypatch.setattr(innerproduct, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(innerproduct, "RUN", 7)
    rng = np.random.default_rng(9)
    m = rng.normal(size=(300, 6))
    m[::3] *= 3e5
    m[5:200:7] = rng.normal(size=m[5:200:7].shape) * 1e6
    m[210:260] = m[0]
    rows = [(i, v) for i, v in enumerate(m.tolist())]
    assert max(abs(x) for _, v in rows for x in v) > 2**20
    want = brute(rows)
    assert max(s for *_, s in want) > 2**53
    assert search(spark, rows) == want
    with pytest.raises(ValueError, match="beyond a long"):
        search(spark, [(0, [1e8]), (1, [1e8])])
    with pytest.raises(ValueError, match="beyond a long"):
        search(spark, [(0, [1.0]), (1, [1e300])])


def test_far_vectors_prune():
    """The bounds leave most pairs unscored on vectors of very different lengths."""
    rng = np.random.default_rng(0)
    m = (rng.normal(size=(3000, 32)) * (rng.pareto(1.5, size=(3000, 1)) + 0.1) * 500).astype(np.int64)
    m = m[np.argsort(-np.linalg.norm(m, axis=1))]
    turned = m.astype(float)
    side = innerproduct.Side(np.arange(3000).astype("<i8").tobytes(), m.astype("<i8").tobytes(), turned.astype("<f8").tobytes(), 32)
    q = innerproduct.Side(np.arange(9000, 9010).astype("<i8").tobytes(), m[::300].astype("<i8").tobytes(), turned[::300].astype("<f8").tobytes(), 32)
    scored = []
    real = np.einsum
    innerproduct.np.einsum = lambda spec, a, b: scored.append(len(a)) or real(spec, a, b)
    try:
        ids, scores = innerproduct.best_of(q, side, 10, np.full(10, -np.inf))
    finally:
        innerproduct.np.einsum = real
    assert sum(scored) < 0.5 * 10 * 3000
    exact = m[::300] @ m.T
    assert np.array_equal(scores, -np.sort(-exact, axis=1)[:, :10])


# --------------------------------------------------------------------------- quality


def graded(spark, n=600, seed=1):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        good = rng.random() < 0.7
        t = sentence(rng, rng.randint(10, 60))
        if not good:
            t = rng.choice([t.upper() + "!!", " ".join([t.split()[0]] * 40), t.replace(" ", " | ")])
        texts.append(t)
        labels.append(int(good))
    return documents(spark, texts), labels


def test_held_out_accuracy(spark):
    docs, truth = graded(spark)
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(truth) if i < 250], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert model.exchanged and model.exchanged[0][0] > 0  # the text view taught the other
    rows = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    right = [rows[i].keep == bool(y) for i, y in enumerate(truth) if i >= 250]
    assert len(rows) == len(truth) and np.mean(right) > 0.97
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.keep}


def test_quality_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, 0), (999, 0, 0), (15, 1, 0), (15, 1, 1), (21, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.quality <= 1 for r in rows)
    same = {}
    for r in rows:
        same.setdefault(r.doc_id, set()).add(r.text_score)
    assert all(len(v) == 1 for v in same.values())
    none = labels.limit(0)
    assert all(r.keep for r in quality.quality(docs, none).collect())
    assert not any(r.keep for r in quality.quality(docs, labels.where("quality = 0 and doc_id = 21")).collect())
    assert quality.quality(empty(spark), labels).count() == 0
    bare = docs.select("doc_id", "text")
    assert quality.quality(bare, labels).count() == quality.accepted(bare, none).count() == docs.count()


def pool_of(texts, sources, langs, chars):
    """Sums over documents in memory."""

    def sums(model, bars):
        at = np.cumsum([0, *(len(t.encode()) for t in texts)])
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        return quality.pool_sums(quality.text_features(at, raw), quality.meta_features(sources, langs, chars), model, bars)

    return sums


def sparse_of(texts, sources, langs, chars):
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    shape, words, bound = quality.text_features(at, np.frombuffer("".join(texts).encode(), np.uint8))
    row, index, value = [], [], []
    for k in range(len(texts)):
        row += [k] * (shape.shape[1] + bound[k + 1] - bound[k])
        index += [*shape[k], *(quality.SHAPE_SIZE + words[bound[k] : bound[k + 1]])]
        value += [1.0] * shape.shape[1] + [quality.WORD_SCALE / max(1, bound[k + 1] - bound[k])] * (bound[k + 1] - bound[k])
    meta = quality.meta_features(sources, langs, chars)
    n = meta.shape[1]
    return quality.Sparse(np.array(row), np.array(index), np.array(value), len(texts)), quality.Sparse(np.repeat(np.arange(len(texts)), n), meta.ravel(), np.ones(meta.size), len(texts))


def two_views(n=1200, seed=0):
    """Good and bad documents with words of their own; the source tells them apart for nine in ten."""
    rng = random.Random(seed)
    y = [rng.random() < 0.6 for _ in range(n)]
    texts = [" ".join(rng.choice(["good", "fine", "well"] if g else ["bad", "poor", "ill"]) + str(rng.randint(0, 9)) * (rng.random() < 0.2) for _ in range(rng.randint(5, 30))) for g in y]
    sources = [("a" if g else "b") if rng.random() < 0.9 else "c" for g in y]
    return texts, sources, [rng.choice(["en", None]) for _ in y], [len(t) for t in texts], np.array(y, float)


def test_co_training_goes_both_ways():
    texts, sources, langs, chars, y = two_views()
    known = 120
    text, meta = sparse_of(texts[:known], sources[:known], langs[:known], chars[:known])
    pool = pool_of(texts[known:], sources[known:], langs[known:], chars[known:])
    model = quality.co_train(text, meta, y[:known], pool)
    assert len(model.exchanged) == quality.ROUNDS and all(a > 50 and b > 50 for a, b in model.exchanged)
    rest = sparse_of(texts[known:], sources[known:], langs[known:], chars[known:])
    z = [x.times(w[:-1]) + w[-1] for x, w in zip(rest, (model.text, model.meta), strict=True)]
    assert np.mean((model.combine(*z)[2] > 0.5) == (y[known:] > 0.5)) > 0.97


def test_pool_sums_are_plain_sums():
    """Gradients and curvature bounds against loops over documents."""
    texts, sources, langs, chars, y = two_views(80, 3)
    model = quality.co_train(*sparse_of(texts[:40], sources[:40], langs[:40], chars[:40]), y[:40], None, rounds=0)
    text, meta = sparse_of(texts[40:], sources[40:], langs[40:], chars[40:])
    zt, zm = text.times(model.text[:-1]) + model.text[-1], meta.times(model.meta[:-1]) + model.meta[-1]
    lt, lm = model.logits(zt, zm)
    bars = ((float(np.quantile(lt, 0.3)), float(np.quantile(lt, 0.8))), (float(np.quantile(lm, 0.2)), float(np.quantile(lm, 0.9))))
    got = pool_of(texts[40:], sources[40:], langs[40:], chars[40:])(model, bars)
    for x, z, given, logit, (low, high), found, length in ((text, zt, lm, lm, bars[1], got.to_text, 12 + quality.WORD_SCALE), (meta, zm, lt, lt, bars[0], got.to_meta, 6)):
        size = (len(found) - 3) // 2
        gradient, curvature, rows = np.zeros(size + 1), np.zeros(size + 1), 0
        for k in range(x.rows):
            if low < logit[k] < high:
                continue
            rows += 1
            error = 1 / (1 + np.exp(-z[k])) - 1 / (1 + np.exp(-given[k]))
            for i, v in [*((i, v) for r, i, v in zip(x.row, x.index, x.value, strict=True) if r == k), (size, 1.0)]:
                gradient[i] += error * v
                curvature[i] += v * length / 4
        assert found[-1] == rows > 5
        assert np.allclose(found[: size + 1] / quality.EXACT, gradient, atol=1e-5) and np.allclose(found[size + 1 : -1] / quality.EXACT, curvature, atol=1e-4)


def test_pool_on_spark_is_the_pool_in_memory(spark):
    texts, sources, langs, chars, y = two_views(300, 5)
    rows = list(zip(range(300), texts, sources, langs, chars, strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(7)
    docs = docs.unionByName(spark.createDataFrame([(None, texts[0], sources[0], langs[0], chars[0])], docs.schema))
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(80)], "doc_id long, quality int")
    text, meta, target, ids = quality._examples(docs, labels, 1000)
    assert ids.tolist() == list(range(80)) and target.sum() == y[:80].sum()
    pool = pool_of([*texts[80:], texts[0]], [*sources[80:], sources[0]], [*langs[80:], langs[0]], [*chars[80:], chars[0]])
    model = quality.co_train(text, meta, target, pool)
    again = quality.train(docs, labels)
    assert again.exchanged == model.exchanged and min(map(min, model.exchanged)) > 0
    assert np.allclose(again.text, model.text, atol=1e-9) and np.allclose(again.meta, model.meta, atol=1e-9)


@pytest.mark.parametrize("value", [0.038, -0.455, 0.0, 1e6])
def test_constant_views_say_nothing(value):
    y = np.array([1.0] * 10 + [0.0] * 5)
    z = np.full(15, value) + np.random.default_rng(0).normal(size=15) * 1e-17
    assert quality._platt(z, y) == (0.0, np.log(11 / 6))
    assert quality._platt(-y, y) == (0.0, np.log(11 / 6))  # the wrong way round
    assert quality._platt(y * 1e-3, y)[0] > 100


def test_surest_takes_a_share_of_each_class():
    bins = np.zeros(quality.BINS, np.int64)
    bins[[10, 20, 400, 500]] = [5, 5, 100, 20]
    low, high = quality.surest(bins, 0.2, 0.0)
    logit = (np.repeat(np.arange(quality.BINS), bins) + 0.5) * (2 * quality.BIN_RANGE / quality.BINS) - quality.BIN_RANGE
    assert (logit <= low).sum() == 10 and (logit >= high).sum() == 20  # 13 each, in whole bins, one at least
    assert quality.surest(np.zeros(quality.BINS, np.int64), 0.2, 0.0) == (-np.inf, np.inf)
    one = np.zeros(quality.BINS, np.int64)
    one[quality._bin_of(np.array([0.5]))] = 9
    assert quality.surest(one, 0.2, 0.51) == (-np.inf, np.inf)


def test_accepted_keeps_the_columns_of_any_table(spark):
    docs, truth = graded(spark, 200)
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(truth)], "doc_id long, quality int")
    odd = docs.select(*docs.columns, F.lit(1).alias("meta"), F.array(F.lit(2.5)).alias("p"), F.col("n_chars").cast("int").alias("quality")).drop("n_chars", "lang")
    kept = quality.accepted(odd, labels)
    assert kept.schema == odd.schema and {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.quality(odd, labels).where("keep").collect()}
    assert quality.accepted(odd.limit(0), labels).count() == 0
