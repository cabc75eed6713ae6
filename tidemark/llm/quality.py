"""Quality classifier by co-training of two views: the text itself, and the page's metadata.

Both views are logistic regressions, fitted on a bounded sample of labelled documents. In each round both score every
other document; each hands the documents that it is surest of, a share of each class, with its calibrated
probabilities to the other view as further examples. What a view learns from them are sums over all of them, of the
gradient and of a bound on the curvature for each feature, so that a round is two passes and brings a few thousand
numbers to the driver. At the end both views are calibrated on labelled documents kept apart, a last regression weighs
the calibrated views, and every document is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import arrow_rows
from tidemark.llm.wordhash import blocks, hash_ranges, word_ranges

#: Documented bound on the labelled rows that are fitted, chosen by hash order. All other rows take part in the exchange.
LABELLED_ROWS = 6000
HELD_OUT = 4  # one labelled document in so many is kept for calibration
ROUNDS = 2
SURE_SHARE = 0.1  # of the documents without labels, times a class's share and the round, what a view may hand on
SURE_MARGIN = 0.01  # log-odds by which that must differ from the classes' shares
PSEUDO_WEIGHT = 0.5  # what all handed on weighs together, against the labelled rows
BINS, BIN_RANGE = 512, 8.0  # of the log-odds by which the surest are found
RIDGE = {"text": 1e-4, "meta": 3e-3}
MIX_RIDGE = 0.3
EXACT = float(1 << 24)  # sums are of whole parts of this, so that no order of adding matters
WORD_BITS = 12
WORD_SCALE = 10.0
KEEP = 0.3  # rejecting asks for more than a doubt

#: Steps of the shape features; a value's place among its steps is one feature.
SHAPES = {
    "upper": (0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.4),
    "digit": (0.001, 0.005, 0.02, 0.05, 0.1, 0.2),
    "punctuation": (0.002, 0.01, 0.015, 0.02, 0.03, 0.04, 0.06, 0.1, 0.15, 0.25),
    "symbol": (0.0005, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1),
    "newline": (0.0005, 0.002, 0.005, 0.01, 0.03, 0.1),
    "word_length": (3.0, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5, 7.0, 8.0, 10.0),
    "repeated_words": (0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.8, 0.9),
    "repeated_lines": (0.01, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "word_runs": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "short_words": (0.05, 0.1, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5),
    "words": (1.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0),
}
_FIRST = dict(zip(SHAPES, np.cumsum([0, *(len(s) + 1 for s in SHAPES.values())]).tolist(), strict=False))
SHAPE_SIZE = sum(len(s) + 1 for s in SHAPES.values())
TEXT_SIZE = SHAPE_SIZE + (1 << WORD_BITS)
META_PLACES = {"source": 256, "lang": 64, "length": 32, "source and lang": 1024, "source and length": 4096}
META_SIZE = sum(META_PLACES.values())

_BYTES = np.arange(256)
_KINDS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "punctuation": (_BYTES > 32) & (_BYTES < 127) & ~np.isin(_BYTES, [*range(48, 58), *range(65, 91), *range(97, 123)]),
    "symbol": np.isin(_BYTES, [ord(c) for c in "|*#@^~`_=<>{}[]\\+$%&"]),
    "newline": _BYTES == 10,
}

SCORES = "text_score double, meta_score double, quality double"


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the values from each offset to the next."""
    total = np.zeros(len(at) - 1)
    on = np.diff(at) > 0
    if on.any():
        total[on] = np.add.reduceat(values, at[:-1][on], dtype=np.float64)
    return total


def _distinct_share(hashes: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Share of each text's values that repeat another one of it."""
    out = np.zeros(len(bound) - 1)
    for k in range(len(out)):
        h = np.sort(hashes[bound[k] : bound[k + 1]])
        out[k] = np.count_nonzero(h[1:] == h[:-1]) / max(1, len(h))
    return out


def _follows(hashes: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Whether each value is the same as the one before it in its text."""
    out = np.zeros(len(hashes), bool)
    out[1:] = hashes[1:] == hashes[:-1]
    out[bound[:-1][np.diff(bound) > 0]] = False
    return out


def text_features(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of each text's shape features, its words' hash features, and where each text's words end."""
    size = np.maximum(1, np.diff(at))
    start, end = word_ranges(at, raw)
    hashes = hash_ranges(raw, start, end, lower=True)
    bound = np.searchsorted(start, at)
    words = np.diff(bound)
    many = np.maximum(1, words)
    newline = np.flatnonzero(raw == 10)
    head = np.union1d(at[:-1][np.diff(at) > 0], newline[~np.isin(newline + 1, at)] + 1) if len(raw) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(raw))[: len(head)]
    line_bound = np.searchsorted(head, at)
    length = end - start
    value = {name: _sums(kind[raw], at) / size for name, kind in _KINDS.items()}
    value |= {
        "word_length": _sums(length, bound) / many,
        "short_words": _sums(length <= 3, bound) / many,
        "repeated_words": _distinct_share(hashes, bound),
        "word_runs": _sums(_follows(hashes, bound), bound) / many,
        "repeated_lines": _distinct_share(hash_ranges(raw, head, tail), line_bound),
        "words": words.astype(np.float64),
    }
    shape = np.stack([_FIRST[name] + np.searchsorted(steps, value[name], "right") for name, steps in SHAPES.items()], axis=1)
    return shape, (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), bound


def meta_features(source: list, lang: list, chars: list) -> np.ndarray:
    """Indices of each row's metadata features: source, language, length and pairs of them; nulls have places of their own."""

    def place(value: str | None, size: int) -> int:
        return 0 if value is None else 1 + zlib.crc32(value.encode()) % (size - 1)

    sizes = list(META_PLACES.values())
    first = np.cumsum([0, *sizes[:-1]])
    rows = []
    for s, x, n in zip(source, lang, chars, strict=True):
        size = 0 if n is None or n < 0 else min(sizes[2] - 1, 1 + int(n).bit_length())
        rows.append((place(s, sizes[0]), place(x, sizes[1]), size, place(f"{s!r} {x!r}", sizes[3]), place(f"{s!r} {size}", sizes[4])))
    return np.array(rows, np.int64).reshape(-1, len(sizes)) + first


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Sparse:
    """Rows of feature indices and values."""

    row: np.ndarray
    index: np.ndarray
    value: np.ndarray
    rows: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.index], minlength=self.rows)

    def take(self, rows: np.ndarray) -> Sparse:
        place = np.full(self.rows, -1)
        place[rows] = np.arange(len(rows))
        on = place[self.row] >= 0
        return Sparse(place[self.row[on]], self.index[on], self.value[on], len(rows))


@dataclass
class Pull:
    """What handed-on documents say about weights near `at`: sums of gradients and bounds of curvatures, and their number."""

    at: np.ndarray
    gradient: np.ndarray
    curvature: np.ndarray
    rows: int

    def slope(self, w: np.ndarray) -> np.ndarray:
        return PSEUDO_WEIGHT / self.rows * (self.gradient + self.curvature * (w - self.at)) if self.rows else np.zeros(len(w))


def fit_logistic(x: Sparse, y: np.ndarray, size: int, pull: Pull | None = None, ridge: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights, the last one constant, by full gradients with per-feature step sizes."""
    w, seen = (np.zeros(size + 1) if pull is None else pull.at.copy()), np.full(size + 1, 1e-8)
    for _ in range(steps):
        error = (_sigmoid(x.times(w[:-1]) + w[-1]) - y) / max(len(y), 1)
        grad = np.append(np.bincount(x.index, weights=x.value * error[x.row], minlength=size), error.sum())
        grad[:-1] += ridge * w[:-1]
        if pull is not None:
            grad += pull.slope(w)
        seen += grad**2
        w -= 0.5 * grad / np.sqrt(seen)
    return w


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn scores into log-odds, with the usual smoothing of the targets.

    Scores that are all the same but for rounding, or that rank the classes the wrong way round, have slope 0.
    """
    yes, no = y.sum(), len(y) - y.sum()
    prior = float(np.log((yes + 1) / (no + 1)))
    spread = float(z.std()) if len(z) else 0.0
    if not yes or not no or spread <= 1e-9 * max(1.0, float(np.abs(z).max())):
        return 0.0, prior
    target = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    centre = float(z.mean())
    a, b = _newton(np.stack([(z - centre) / spread, np.ones(len(z))], axis=1), target)
    return (float(a / spread), float(b - a * centre / spread)) if a > 0 else (0.0, prior)


def _newton(x: np.ndarray, target: np.ndarray, near: np.ndarray | None = None, ridge: float = 1e-3) -> np.ndarray:
    """Logistic weights, drawn to `near`."""
    near = np.zeros(x.shape[1]) if near is None else near
    w = near.copy()
    for _ in range(50):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - target) + ridge * (w - near))
    return w


@dataclass
class QualityModel:
    """Weights and calibration of both views and how they are weighed."""

    text: np.ndarray = field(default_factory=lambda: np.zeros(TEXT_SIZE + 1))
    meta: np.ndarray = field(default_factory=lambda: np.zeros(META_SIZE + 1))
    text_scale: tuple[float, float] = (0.0, 0.0)
    meta_scale: tuple[float, float] = (0.0, 0.0)
    mix: tuple[float, float, float] = (0.0, 0.0, 0.0)
    exchanged: list[tuple[int, int]] = field(default_factory=list)

    def logits(self, zt: np.ndarray, zm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds of both views."""
        return self.text_scale[0] * zt + self.text_scale[1], self.meta_scale[0] * zm + self.meta_scale[1]

    def combine(self, zt: np.ndarray, zm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lt, lm = self.logits(zt, zm)
        return _sigmoid(lt), _sigmoid(lm), _sigmoid(self.mix[0] * lt + self.mix[1] * lm + self.mix[2])


Bars = tuple[float, float]  # log-odds up to which, and from which, a view hands documents on


@dataclass
class Sums:
    """What a pass over the documents without labels brings back."""

    text_bins: np.ndarray = field(default_factory=lambda: np.zeros(BINS, np.int64))
    meta_bins: np.ndarray = field(default_factory=lambda: np.zeros(BINS, np.int64))
    to_text: np.ndarray = field(default_factory=lambda: np.zeros(2 * TEXT_SIZE + 3, np.int64))
    to_meta: np.ndarray = field(default_factory=lambda: np.zeros(2 * META_SIZE + 3, np.int64))

    def parts(self) -> list[np.ndarray]:
        return [self.text_bins, self.meta_bins, self.to_text, self.to_meta]

    def add(self, other: Sums) -> None:
        for mine, more in zip(self.parts(), other.parts(), strict=True):
            mine += more


SUMS_SIZE = sum(map(len, Sums().parts()))


def _bin_of(logit: np.ndarray) -> np.ndarray:
    return np.clip((logit + BIN_RANGE) * (BINS / (2 * BIN_RANGE)), 0, BINS - 1).astype(np.int64)


def surest(bins: np.ndarray, share: float, prior: float) -> Bars:
    """Log-odds beyond which lies the surest share of each class, a whole bin at least, as far as they differ from the prior."""
    edge = np.arange(BINS + 1) * (2 * BIN_RANGE / BINS) - BIN_RANGE
    rate, total = 1 / (1 + np.exp(-prior)), bins.sum()

    def last(full: np.ndarray, most: float) -> int | None:
        """The bin, of those with rows in the order given, up to which lie `most` rows."""
        return int(full[max(0, int(np.searchsorted(np.cumsum(bins[full]), most, "right")) - 1)]) if len(full) else None

    full = np.flatnonzero(bins)
    low = last(full[edge[full + 1] < prior - SURE_MARGIN], share * (1 - rate) * total)
    high = last(full[edge[full] > prior + SURE_MARGIN][::-1], share * rate * total)
    return -np.inf if low is None else float(edge[low + 1]), np.inf if high is None else float(edge[high])


def _teach(index: list[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int, length: float, z: np.ndarray, given: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Sums of gradients and curvature bounds by feature, and the number of rows, for the rows that are `on`.

    `index` has triples of row, feature and value; `length` bounds a row's sum of values, the constant included.
    """
    error = _sigmoid(z) - given
    out = np.zeros(2 * size + 3)
    for row, feature, value in index:
        pick = on[row]
        row, feature, value = row[pick], feature[pick], value[pick]
        out[:size] += np.bincount(feature, np.rint(EXACT * error[row] * value), size)
        out[size + 1 : 2 * size + 1] += np.bincount(feature, np.rint(EXACT * value * length / 4), size)
    out[size] = np.rint(EXACT * error[on]).sum()
    out[2 * size + 1] = np.rint(EXACT * length / 4) * on.sum()
    out[2 * size + 2] = on.sum()
    return out.astype(np.int64)


def pool_sums(features: tuple[np.ndarray, np.ndarray, np.ndarray], meta: np.ndarray, model: QualityModel, bars: tuple[Bars, Bars] | None) -> Sums:
    """Bins of both views' log-odds, or, with bars for both, what each view teaches the other."""
    shape, words, bound = features
    n, many = len(meta), np.maximum(1, np.diff(bound))
    zt, zm = text_scores(features, model), meta_scores(meta, model)
    lt, lm = model.logits(zt, zm)
    sums = Sums()
    if bars is None:
        sums.text_bins += np.bincount(_bin_of(lt), minlength=BINS)
        sums.meta_bins += np.bincount(_bin_of(lm), minlength=BINS)
        return sums
    (low_t, high_t), (low_m, high_m) = bars
    row = np.arange(n)
    of_word = np.repeat(row, np.diff(bound))
    parts = [(np.repeat(row, shape.shape[1]), shape.ravel(), np.ones(shape.size)), (of_word, SHAPE_SIZE + words, WORD_SCALE / many[of_word])]
    sums.to_text += _teach(parts, TEXT_SIZE, shape.shape[1] + WORD_SCALE + 1, zt, _sigmoid(lm), (lm <= low_m) | (lm >= high_m))
    parts = [(np.repeat(row, meta.shape[1]), meta.ravel(), np.ones(meta.size))]
    sums.to_meta += _teach(parts, META_SIZE, meta.shape[1] + 1, zm, _sigmoid(lt), (lt <= low_t) | (lt >= high_t))
    return sums


def _pull(at: np.ndarray, sums: np.ndarray) -> Pull:
    size = len(at)
    return Pull(at, sums[:size] / EXACT, sums[size : 2 * size] / EXACT, int(sums[-1]))


def co_train(text: Sparse, meta: Sparse, y: np.ndarray, pool: Callable[[QualityModel, tuple[Bars, Bars] | None], Sums], rounds: int = ROUNDS) -> QualityModel:
    """Model from labelled rows of both views, y 1 or 0, and `pool`, which sums over the documents without labels.

    Without both classes nothing is fitted, and everything is kept unless all labels are bad.
    """
    model = QualityModel()
    if len(np.unique(y)) < 2:
        model.mix = (0.0, 0.0, 1.0 if not len(y) or y[0] > 0 else -1.0)
        return model
    every = np.arange(len(y))
    held, train = every[::HELD_OUT], np.delete(every, np.s_[::HELD_OUT])
    if len(np.unique(y[train])) < 2 or len(np.unique(y[held])) < 2:
        held = train = every
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))

    def fit(pulls: tuple[Pull | None, Pull | None]) -> None:
        model.text = fit_logistic(text.take(train), y[train], TEXT_SIZE, pulls[0], RIDGE["text"])
        model.meta = fit_logistic(meta.take(train), y[train], META_SIZE, pulls[1], RIDGE["meta"])
        zt, zm = text.times(model.text[:-1]) + model.text[-1], meta.times(model.meta[:-1]) + model.meta[-1]
        model.text_scale, model.meta_scale = _platt(zt[held], y[held]), _platt(zm[held], y[held])
        lt, lm = model.logits(zt[held], zm[held])
        # views that know nothing of each other add up, less what both know beforehand
        near = np.array([1.0, 1.0, -prior])
        model.mix = tuple(_newton(np.stack([lt, lm, np.ones(len(held))], axis=1), y[held], near, MIX_RIDGE).tolist())

    fit((None, None))
    for r in range(1, rounds + 1):
        seen = pool(model, None)
        bars = tuple(surest(bins, SURE_SHARE * r, prior) for bins in (seen.text_bins, seen.meta_bins))
        if not np.isfinite(bars).any():
            break
        taught = pool(model, bars)
        model.exchanged.append((int(taught.to_meta[-1]), int(taught.to_text[-1])))
        fit((_pull(model.text, taught.to_text), _pull(model.meta, taught.to_meta)))
    return model


def _inputs(docs: DataFrame) -> DataFrame:
    """doc_id, text and the metadata columns, null where the table lacks one."""
    have = set(docs.columns)
    pick = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return docs.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in pick.items()))


def _examples(docs: DataFrame, labels: DataFrame, labelled_rows: int) -> tuple[Sparse, Sparse, np.ndarray, np.ndarray]:
    """Features of the labelled sample in both views, labels, and sorted ids."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.avg(F.col("quality").cast("double")).alias("q")).where("q <> 0.5").select("doc_id", F.when(F.col("q") > 0.5, 1.0).otherwise(0.0).alias("y"))
    ids = docs.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    sample = ids.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)  # so it can be broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            meta = meta_features(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
            for row, at, raw in blocks(batch.column(1)):
                shape, words, bound = text_features(at, raw)
                for k in range(len(at) - 1):
                    count = np.bincount(words[bound[k] : bound[k + 1]], minlength=1 << WORD_BITS)
                    index = np.flatnonzero(count)
                    value = WORD_SCALE * count[index] / max(1, count.sum())
                    index = np.concatenate([shape[k], SHAPE_SIZE + index]).astype("<i4")
                    value = np.concatenate([np.ones(shape.shape[1]), value]).astype("<f8")
                    rows.append((index.tobytes(), value.tobytes(), meta[row + k].astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], ["doc_id", "y", "i", "v", "m"])

    found = _inputs(docs).join(F.broadcast(sample), "doc_id").mapInArrow(run, "doc_id long, y double, i binary, v binary, m binary")
    # of rows that repeat an id with other contents, the least by its features
    found = found.groupBy("doc_id").agg(F.min(F.struct("y", "i", "v", "m")).alias("x")).select("doc_id", "x.*")
    rows = sorted(found.collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    index = [np.frombuffer(r.i, "<i4").astype(np.int64) for r in rows]
    meta = [np.frombuffer(r.m, "<i4").astype(np.int64) for r in rows]
    none = np.zeros(0, np.int64)

    def place(parts: list[np.ndarray]) -> np.ndarray:
        return np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else none

    value = np.concatenate([np.frombuffer(r.v, "<f8") for r in rows]) if rows else np.zeros(0)
    text = Sparse(place(index), np.concatenate(index) if rows else none, value, len(rows))
    flat = np.concatenate(meta) if rows else none
    ids = np.sort(np.array([r.doc_id for r in rows], np.int64))
    return text, Sparse(place(meta), flat, np.ones(len(flat)), len(rows)), np.array([r.y for r in rows]), ids


def _pool(docs: DataFrame, known: np.ndarray) -> Callable[[QualityModel, tuple[Bars, Bars] | None], Sums]:
    """Sums over every row of `docs` whose id isn't in `known`, added up on Spark by feature."""
    given = _inputs(docs)

    def sums(model: QualityModel, bars: tuple[Bars, Bars] | None) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Sums()
            for batch in arrow_rows(batches):
                free = pa.array(~np.isin(batch.column(0).fill_null(0).to_numpy(), known) | batch.column(0).is_null().to_numpy(zero_copy_only=False))
                batch = batch.filter(free)
                meta = meta_features(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
                for row, at, raw in blocks(batch.column(1)):
                    found.add(pool_sums(text_features(at, raw), meta[row : row + len(at) - 1], model, bars))
            flat = np.concatenate(found.parts())
            on = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(flat[on])], ["place", "total"])

        flat = np.zeros(SUMS_SIZE, np.int64)
        for r in given.mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect():
            flat[r.place] = r.total
        out = Sums()
        at = 0
        for part in out.parts():
            part += flat[at : at + len(part)]
            at += len(part)
        return out

    return sums


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> QualityModel:
    """Model for documents with some labels. `labels` has doc_id and quality, 1 good and 0 bad; null, unknown and
    contradicting labels count for nothing. Rows that repeat a labelled id count once."""
    text, meta, y, ids = _examples(docs, labels, labelled_rows)
    return co_train(text, meta, y, _pool(docs, ids))


def text_scores(features: tuple[np.ndarray, np.ndarray, np.ndarray], model: QualityModel) -> np.ndarray:
    shape, words, bound = features
    z = model.text[shape].sum(axis=1) + model.text[-1]
    return z + WORD_SCALE * _sums(model.text[SHAPE_SIZE + words], bound) / np.maximum(1, np.diff(bound))


def meta_scores(meta: np.ndarray, model: QualityModel) -> np.ndarray:
    return model.meta[meta].sum(axis=1) + model.meta[-1]


def text_quality(text: pa.Array, meta: np.ndarray, model: QualityModel) -> list[np.ndarray]:
    """Calibrated probabilities of each text by itself, by its metadata features, and by both."""
    zt = np.zeros(len(meta))
    for row, at, raw in blocks(text):
        zt[row : row + len(at) - 1] = text_scores(text_features(at, raw), model)
    return [np.round(p, 6) for p in model.combine(zt, meta_scores(meta, model))]


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id with the calibrated probability of good quality by text, by metadata, and by both.

    One row per input row; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            meta = meta_features(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
            out = text_quality(batch.column(1), meta, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p) for p in out)], ["doc_id", "text_score", "meta_score", "quality"])

    return _inputs(docs).mapInArrow(run, f"doc_id long, {SCORES}")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every document and whether it is kept: quality of at least KEEP.

    `docs` has doc_id and text and may have source, lang and n_chars; other columns are ignored. Nulls in any of them
    are values of their own, a null text counts as empty. Repeated rows are scored alike. Without labels of both
    classes all get one score: kept, unless all labels are bad. An empty table gives no rows.
    """
    return score(docs, train(docs, labels)).withColumn("keep", F.col("quality") >= KEEP)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose quality is at least KEEP. Scores stay in the task that reads the text.

    See `quality` for nulls, missing columns and labels. Rows that are equal in text, source, lang and n_chars are kept
    or rejected together; an empty table stays empty. Other columns pass through, whatever their names.
    """
    model = train(docs, labels)
    place = {c: docs.columns.index(c) for c in ("text", "source", "lang", "n_chars") if c in docs.columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):

            def column(name: str, kind: pa.DataType) -> pa.Array:
                return batch.column(place[name]).cast(kind, safe=False) if name in place else pa.nulls(batch.num_rows, kind)

            meta = meta_features(column("source", pa.string()).to_pylist(), column("lang", pa.string()).to_pylist(), column("n_chars", pa.int64()).to_pylist())
            keep = text_quality(column("text", pa.string()), meta, model)[2] >= KEEP
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
