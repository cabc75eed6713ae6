import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, empty
from pyspark.sql import functions as F

from tidemark.llm import audio, urls, warc

# --------------------------------------------------------------------------- audio


def test_media(spark):
    docs = awkward(spark)
    want = Counter()
    for r in docs.collect():
        data = (r.text or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        want[r.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    rows = audio.media_features(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    by_payload = {}
    for r in rows:
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert hashlib.sha256(audio.from_wav(bytes(r.media))).hexdigest() == r.payload_sha256
        by_payload.setdefault(r.payload_sha256, set()).add((r.feature, r.media_sha256, bytes(r.tensors)))
    assert all(len(v) == 1 for v in by_payload.values())
    assert audio.media_features(empty(spark)).count() == 0


@pytest.mark.parametrize("size", [0, 576, 40_000, 200_000])
def test_features_come_from_the_tensors(monkeypatch, size):
    """Whether or not they are kept: what is written decides the digest."""
    data = random.Random(size).randbytes(size)
    kept, dropped = (audio.media_row(data, keep) for keep in (True, False))
    assert kept[:-2] == dropped[:-2] and dropped[-2:] == (None, None)
    found = audio.describe(audio.from_wav(kept[-2]))
    assert kept[6] == audio.feature_text(found) and np.array_equal(audio.read_tensors(kept[-1]), found["mels"])
    real = audio.tensor_table
    monkeypatch.setattr(audio, "tensor_table", lambda mels: real(mels + np.float32(1)))
    assert audio.media_row(data, False)[6] != kept[6]


def test_tensors_have_one_shape_and_spans():
    payload = bytes(range(256)) * 200
    found = audio.describe(payload)
    t = pa.ipc.open_stream(audio.write_ipc(audio.tensor_table(found["mels"]))).read_all()
    assert t["tensor"].type == pa.fixed_shape_tensor(pa.float32(), (64, 32))
    values = t["tensor"].combine_chunks().to_numpy_ndarray().reshape(-1, 32)
    assert np.array_equal(values[: len(found["mels"])], found["mels"]) and (values[len(found["mels"]) :] == audio.FLOOR_DB).all()
    assert t["start_s"].to_pylist() == [k * 64 * 128 / 10_000 for k in range(len(t))]
    assert all(a < b for a, b in zip(t["start_s"].to_pylist(), t["end_s"].to_pylist(), strict=True))


def test_resampling_keeps_a_tone_and_stops_an_alias():
    t = np.arange(16_000) / 16_000
    tone = audio.resample(np.sin(2 * np.pi * 1000 * t).astype(np.float32))
    spectrum = np.abs(np.fft.rfft(tone * np.hanning(len(tone))))
    assert len(tone) == 10_000 and spectrum.argmax() == 1000
    alias = audio.resample(np.sin(2 * np.pi * 7500 * t).astype(np.float32))
    assert np.abs(alias[500:-500]).max() < 0.05 * np.abs(tone[500:-500]).max()
    # the phases give what filtering the stuffed signal gives
    x = np.random.default_rng(0).normal(size=400).astype(np.float32)
    taps = audio._phases()[:, ::-1].T.ravel()
    stuffed = np.zeros(400 * audio.UP)
    stuffed[:: audio.UP] = x
    assert np.allclose(audio.resample(x), np.convolve(stuffed, taps)[: len(stuffed)][:: audio.DOWN], atol=1e-5)


def test_segments_have_hysteresis():
    energy = np.array([0, 0, 5, 1.0, 1.0, 0, 0, 5, 0, 0, 1.0, 0], np.float32)  # mean 1.08: opens at 1.19, lasts to 0.98
    assert audio.segments(energy).tolist() == [[2, 5], [7, 8]]
    assert audio.segments(np.zeros(4, np.float32)).tolist() == []


def test_mel_of_a_tone():
    y = np.sin(2 * np.pi * 2000 * np.arange(10_000) / 10_000).astype(np.float32)
    mels, _ = audio.log_mel(y)
    peak = 2595 * np.log10(1 + 2000 / 700) / (2595 * np.log10(1 + 5000 / 700)) * 33 - 1
    assert abs(mels[5:-5].mean(axis=0).argmax() - peak) <= 1


# --------------------------------------------------------------------------- urls

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET/en/1?x", "https://example.net/fr/2", "http://b.example.com/de/3#t", "http://example.org/fr/", "ftp://x.org/frost",
    "http://example.com/de", "http://notexample.net/en/", "http://net/", "http://x.net", "http://x.net?/en/", "HTTP://É.Org/fr/x", "http://u:p@h.example.com:80/de/?q#f", "a://b://c/d", "http://x.com/" + "y" * 5000,
]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
    best = None
    for h, p, v in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, v
    return host, path, best


def pages_of(spark, found):
    rows = [(i, u, "<p>", "h", "p", 1.0, 2) for i, u in enumerate(found)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string, score double, gram int")


def test_url_rules(spark):
    pages = pages_of(spark, URLS)
    rows = {r.page_id: r for r in urls.url_filter(pages.unionByName(pages.limit(3)).unionByName(pages.where("page_id = 4").withColumn("page_id", F.lit(None).cast("long")))).collect()}
    for i, u in enumerate(URLS):
        host, path, best = judge(u)
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, best and best[0]), u
        assert r.verdict == best[1] if best else r.verdict in ("allow", "block")
    assert urls.url_filter(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.url_filter(pages_of(spark, ["http://x.com/a", "http://y.com/b"])).collect()} == {"allow"}


def test_url_model_against_brute_force(spark):
    rng = random.Random(3)
    good = ["http://" + "".join(rng.choice("aei") for _ in range(8)) + ".org/fr/" + str(rng.randint(0, 99)) for _ in range(60)]
    bad = ["http://" + "".join(rng.choice("xyz") for _ in range(8)) + ".net/q" for _ in range(60)]
    free = ["http://" + "".join(rng.choice(a) for _ in range(8)) + ".com/" + b for a, b in (("aei", "fr/1"), ("xyz", "q")) for _ in range(20)]
    rows = urls.url_filter(pages_of(spark, good + bad + free)).orderBy("page_id").collect()
    assert [r.verdict for r in rows[120:]] == ["allow"] * 20 + ["block"] * 20

    def codes(u):
        s = urls.BEGIN * 2 + re.sub("[0-9]", "0", u.lower()) + urls.END
        return [urls.ALPHABET.find(c) + 1 for c in s]

    def model(texts):
        seen = [Counter() for _ in range(3)]
        for u in texts:
            c = codes(u)
            for i in range(2, len(c)):
                for k in range(3):
                    seen[k][tuple(c[i - k : i + 1])] += 1

        def p(gram):
            if not gram:
                return 1 / urls.SYMBOLS
            same = {g: n for g, n in seen[len(gram) - 1].items() if g[:-1] == gram[:-1]}
            total = sum(same.values())
            return p(gram[1:]) if total < urls.LEAST_CONTEXT else (same.get(gram, 0) + len(same) * p(gram[1:])) / (total + len(same))

        return p

    yes, no = model(good), model(bad)
    for r, u in list(zip(rows, good + bad + free, strict=True))[::13]:
        c = codes(u)
        grams = [tuple(c[i - 2 : i + 1]) for i in range(2, len(c))]
        assert r.score == pytest.approx(sum(np.log(yes(g) / no(g)) for g in grams) / len(grams), abs=1e-5)


def test_url_filter_is_native(spark):
    plan = urls.url_filter(pages_of(spark, URLS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --------------------------------------------------------------------------- warc


def replica(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "file long, offset long, length long, digest string, number long, above string")


def test_audit_finds_all_differences(spark):
    rng = random.Random(1)
    a, b = [], []
    for file in (1, 2, 3):
        at = 0
        for _ in range(400 if file == 1 else 40):
            n = rng.choice([50, 900, 200_000])
            a.append((file, at, n, hashlib.sha256(bytes([rng.randint(0, 255)] * 8)).hexdigest()))
            at += n
    b = list(a)
    b[7] = (*b[7][:3], "0")
    b[300] = (*b[300][:2], 1, b[300][3])
    gone = b.pop(100)
    more = (9, 123, 5, "new")
    b += [more, (1, 10**9, 4, "far")]
    got = {(r.file, r.offset): (r.status, r.first_digest, r.second_digest) for r in warc.audit(replica(spark, a), replica(spark, b)).collect()}
    assert got == {
        a[7][:2]: ("changed", a[7][3], "0"), gone[:2]: ("missing", gone[3], None), more[:2]: ("extra", None, "new"), (1, 10**9): ("extra", None, "far"),
    } | ({} if a[300][2] == 1 else {})
    assert warc.audit(replica(spark, a), replica(spark, a[::-1])).count() == 0


def test_audit_awkward(spark):
    rows = [(1, 0, 3, "a"), (1, 0, 3, "a"), (None, 0, 3, "a"), (1, None, 3, "a"), (1, 3, None, None)]
    assert warc.audit(replica(spark, rows), replica(spark, rows)).count() == 0
    assert [(r.status, r.first_digest, r.second_digest) for r in warc.audit(replica(spark, rows), replica(spark, rows[1:])).collect()] == [("changed", "a,a", "a")]
    none = replica(spark, rows).limit(0)
    assert warc.audit(none, none).count() == 0
    assert [r.status for r in warc.audit(none, replica(spark, rows[:1])).collect()] == ["extra"]


def test_tree_is_built_from_ordered_ranges(spark):
    rows = [(1, k * 30_000, 30_000, str(k)) for k in range(80)]
    levels = warc.tree(replica(spark, rows).orderBy(F.rand(1)), 2)
    leaves = {}
    for r in rows:
        leaves.setdefault(r[1] // 65536, []).append(f"{r[1]}:{r[2]}:{r[3]}")
    leaves = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in leaves.items()}
    assert {r.number: r.digest for r in levels[0].collect()} == leaves
    above = {}
    for k in sorted(leaves):
        above.setdefault(k // 16, []).append(f"{k}:{leaves[k]}")
    above = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in above.items()}
    assert {r.number: r.digest for r in levels[1].collect()} == above
    root = hashlib.sha256("\n".join(f"{k}:{above[k]}" for k in sorted(above)).encode()).hexdigest()
    assert [(r.number, r.digest, r.records) for r in levels[2].collect()] == [(0, root, 80)]


def test_files_round_trip(spark, tmp_path):
    pages = pages_of(spark, [*URLS[:6], "http://é.org/ü"]).withColumn("html", F.when(F.col("page_id") != 3, F.concat(F.lit("<p>line\nline é</p>"), "page_id")))
    found = warc.records(pages, file_records=3)
    warc.write_warc(found, str(tmp_path / "w"), file_records=3)
    back = warc.read_warc(spark, str(tmp_path / "w"))
    placed = warc.with_offsets(warc.digests(found))
    assert back.count() == 7 and warc.audit(placed, back).count() == 0
    nameless = warc.records(pages.withColumn("page_id", F.lit(None).cast("long")))
    assert nameless.where("file < 0").count() == 7
