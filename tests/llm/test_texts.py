"""Personal data, middles and periodic runs against plain restatements of their rules."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from cases import awkward, documents, empty
from compare import SF_DIR
from pyspark.sql import functions as F

from tidemark.llm import middle, pii, runs
from tidemark.llm.queries import QUERIES
from tidemark.llm.tables import table

# --------------------------------------------------------------------------- personal data

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        doubled = [x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(digits[::-1])]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def base_spans(text):
    forms = [(k, kind, form) for k, (kind, form) in enumerate(FORMS.items()) if kind != "email" or "@" in text]
    found = [(m.start(), k, m.end()) for k, kind, form in forms for m in re.finditer(form, text) if valid(kind, m[0])]
    return sorted(found)


def noise(rng, size):
    parts = ["@", ".", "+", "-", " ", "(", ")", "a", "é", "7", "25", "255", "256", "4785380592391139", "a.b@c.d", "1.2.3.4", "+1 (743) 555-3824", "tel:", "iban", "\n", "%", '"', "[", "]"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, size)))


def test_base_spans_are_those_of_the_forms():
    rng = random.Random(0)
    for _ in range(20_000):
        text = noise(rng, 14)
        base, added = pii.find_spans(text)
        assert base == base_spans(text), text
        assert all(a < b <= len(text) for a, _, b in added)
        taken = [x for a, _, b in added for x in range(a, b)]
        assert len(taken) == len(set(taken)) and not set(taken) & {x for a, _, b in base for x in range(a, b)}, text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to jürgen@müller.example now", ["email", "jürgen@müller.example"]),
        ('to "jane doe"@example.com.', ["email", '"jane doe"@example.com']),
        ("<a href=tel:555-123-4567>", ["phone", "555-123-4567"]),
        ("IBAN: DE89 3704 0044 0532 0130 00, please", ["account", "DE89 3704 0044 0532 0130 00"]),
        ("iban GB82WEST12345698765432.", ["account", "GB82WEST12345698765432"]),
        ("Account no. 12345678 is closed", ["account", "12345678"]),
        ("my account number: 1234-5678", ["account", "1234-5678"]),
    ],
)
def test_added_spans(text, want):
    base, added = pii.find_spans(text)
    assert [[pii.KINDS[k], text[a:b]] for a, k, b in added if pii.KINDS[k] == want[0]] == [want]
    assert base == base_spans(text)


@pytest.mark.parametrize("text", ["accounts of 1234567", "an account of 3 people", "hotel: 5551234567", "iban DE88 3704 0044 0532 0130 00 x", "me @ home", "a@b", "root@[10.0.0.1]", "account 1234567x", "tel: none"])
def test_no_added_spans(text):
    assert not [s for s in pii.find_spans(text)[1] if pii.KINDS[s[1]] != "account" or "DE88" not in text]


def test_personal_data(spark):
    docs = awkward(spark).unionByName(documents(spark, ["Ünï a@b.co +1 (743) 555-3824 😀 1.2.3.4, 4785380592391139", "tel:555-123-4567 " * 3, "7" * 50_000, "1." * 50_000, "@" * 50_000, "a@" * 30_000], range(900, 906)))
    want = Counter()
    for r in docs.collect():
        text = r.text or ""
        base = base_spans(text)
        listed = ",".join(f"{list(FORMS)[k]}:{a}:{b}" for a, k, b in base)
        want[r.doc_id, *(sum(k == j for _, k, _ in base) for j in range(4)), hashlib.sha256(listed.encode()).hexdigest()] += 1
    rows = pii.personal_data(docs).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want
    by_id = {r.doc_id: r for r in rows}
    assert by_id[900].spans == "email:4:10,phone:11:28,ip:31:38,card:40:56"
    assert by_id[901].spans == "phone:4:16,phone:21:33,phone:38:50"
    assert by_id[0].spans == "" and by_id[1].spans == ""
    assert pii.personal_data(empty(spark)).count() == 0


def test_personal_data_of_the_documents(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF_DIR, "documents").collect()}
    rows = QUERIES["op11_personal_data"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.spans == ",".join(f"{list(FORMS)[k]}:{a}:{b}" for a, k, b in base_spans(texts[r.doc_id]))


# --------------------------------------------------------------------------- middles


def cut(doc_id, text):
    """The contract, said with slices."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if n == 0 or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_in_middle(spark):
    docs = awkward(spark).unionByName(documents(spark, ["<P", "a<S>b", "<<S", "S><M", "́e‍😀\r\n\x00", "<|M>", "x"] * 20, range(900, 1040)))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for r in docs.collect():
        n, form, a, b, out = cut(r.doc_id, r.text or "")
        want[r.doc_id, n, form, a, b, sha(out), sha(r.text or ""), out] += 1
    found = middle.fill_in_middle(docs)
    assert Counter(tuple(r) for r in found.collect()) == want
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(docs, keep=False).where("output IS NOT NULL").count() == 0
    assert middle.fill_in_middle(empty(spark)).count() == 0


def test_restore_of_parts_that_resemble_marks():
    rng = random.Random(0)
    units = middle.regex.compile(f"({middle.CODE_POINT})*+")
    for _ in range(5000):
        text = "".join(rng.choice("<>PSMa") for _ in range(rng.randint(0, 12)))
        numbers = [rng.getrandbits(32) for _ in range(4)]
        _, form, _, _, out = middle.transform(text, numbers, units)
        assert middle.restore(out, form) == text


def test_other_units(spark):
    """Cuts between words: no word is cut, and the text comes back."""
    docs = documents(spark, ["one two  three four", "a", " lead and trail "] * 30, range(90))
    for r in middle.fill_in_middle(docs, unit=r"\s*\S+\s*|\s+").collect():
        if r.form != "plain":
            parts = re.split("<[PSM]>", r.output)
            assert not any(a[-1:].isalpha() and b[:1].isalpha() for a, b in [(parts[1 + (r.form == "spm")], parts[3])])
            assert r.n <= 4
    with pytest.raises(Exception, match="cover any text"):
        middle.fill_in_middle(docs, unit="[a-z]").collect()


# --------------------------------------------------------------------------- periodic runs


def all_runs(words):
    """Every lag, every stretch; of one stretch the smallest period."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(24, 3 * q):
                found.setdefault((start, i + q - start), q)
            i += i == start
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_are_all_runs():
    rng = random.Random(0)
    seen = 0
    for _ in range(3000):
        kinds, words = rng.choice([1, 2, 3, 5, 50]), []
        for _ in range(rng.randint(0, 6)):
            unit = [rng.randrange(kinds) for _ in range(rng.randint(1, rng.choice([3, 10, 40, 90])))]
            if words and rng.random() < 0.3:
                a = rng.randrange(len(words))
                unit = words[a : a + rng.randint(1, 60)]
            words += (unit * rng.randint(1, rng.choice([1, 3, 8, 30])))[: rng.randint(1, 400)]
        want = all_runs(words)
        seen += len(want)
        assert runs.find_runs(words) == want, words
    assert seen > 2000


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("words", [[0] * 3000, fibonacci(2000), [*range(700)] * 4, [*range(700), *range(700), *range(699)], [0, 1] * 900 + [1, 0] * 900, [0] * 23, [0] * 24, []])
def test_runs_of_repetitive_texts(words):
    assert runs.find_runs(words) == all_runs(words)


def test_long_repetitive_texts_take_little_time():
    """A table of all lags would have some billions of cells here."""
    assert runs.find_runs([0] * 100_000) == [(0, 100_000, 1)]
    assert runs.find_runs([*range(25_000)] * 4) == [(0, 100_000, 25_000)]


def run_row(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(str(doc_id if doc_id is not None else "").encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(x for i, x in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_periodic_runs(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))) + " \x1c " + "u v w\t" * rng.randint(0, 20) + "q x " * rng.randint(0, 30) for _ in range(150)]
    docs = awkward(spark).where("length(text) < 50000 OR text IS NULL").unionByName(documents(spark, texts, range(900, 1050)))
    want = Counter(run_row(r.doc_id, r.text) for r in docs.collect())
    found = runs.periodic_runs(docs, change=runs.repeat_tail)
    assert Counter(tuple(r)[:8] for r in found.collect()) == want
    assert sum(r.n_runs > 1 for r in found.collect()) > 3
    plain = runs.periodic_runs(documents(spark, ["x " + "a b " * 20 + "c"])).first()
    assert [tuple(r) for r in plain.runs] == [(1, 40, 2)] and plain.collapsed == "x a b c"
    assert runs.periodic_runs(docs, keep=False).where("runs IS NOT NULL OR collapsed IS NOT NULL").count() == 0
    assert runs.periodic_runs(empty(spark)).count() == 0


def test_runs_of_the_documents(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF_DIR, "documents").where(F.length("text") < 6000).collect()}
    rows = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF_DIR).collect()}
    assert len(rows) == table(spark, SF_DIR, "documents").count()
    assert all(rows[d] == run_row(d, t) for d, t in texts.items())
