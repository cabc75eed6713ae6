"""Personal data, found from anchors that one Aho-Corasick automaton reports and grown by local parsers.

Anchors are at-signs, digits that touch a dot, a plus or another digit, schemes, and cue words for numbers. Each kind
has a parser that grows an anchor to the left and right over the characters its form allows, validates what it got, and
says where to go on. Anchors that lie in what their kind's parser already read are skipped, so a text is read
a bounded number of times.

Base kinds follow fixed forms, leftmost and without overlap inside a kind: `email`, `ip`, `card` and `phone`. Beyond
them the anchors give spans of text that the base forms can't hold:

* `email`: addresses with letters outside ASCII or a quoted local part;
* `phone`: the number after `tel:`, `callto:` or `sms:`, 7 to 15 digits;
* `account`: after a cue word, an IBAN with its check sum, or a number of 6 to 18 digits with at most eight
  characters of punctuation or `no`, `number` in between.

An added span never overlaps a base span or another added one; of two, the one that starts first stays.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import arrow_rows

KINDS = ("email", "ip", "card", "phone", "account")
BASE_KINDS = KINDS[:4]
DIGITS = frozenset(string.digits)
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
LABEL = frozenset(string.ascii_letters + string.digits + "-")
DIALLED = frozenset(string.digits + " ().-")
TEL_SCHEMES = ("tel:", "callto:", "sms:")
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")
BETWEEN_WORDS = ("number", "no", "nr", "num")
#: Characters of an IBAN, and of the punctuation that may stand between a cue and its number.
IBAN_SIZE = (15, 34)
GAP = frozenset(" \t:#.=-")
MOST_GAP = 8
COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
Span = tuple[int, int, int]  # start, number of the kind, end

_automata: list[ahocorasick.Automaton] = []


def automaton() -> ahocorasick.Automaton:
    """Anchors with their kind and length; made once a process."""
    if not _automata:
        made = ahocorasick.Automaton()
        keys = {"@": "email"}
        for a in string.digits:
            keys[f"+{a}"] = "phone"
            for b in string.digits:
                keys[f"{a}.{b}"] = "ip"
                keys |= {f"{a}{gap}{b}": "card" for gap in ("", " ", "-")}
        for word in TEL_SCHEMES:
            keys |= {x: "tel" for x in (word, word.upper(), word.capitalize())}
        for word in CUES:
            keys |= {x: "cue" for x in (word, word.upper(), word.capitalize())}
        for key, kind in keys.items():
            made.add_word(key, (kind, len(key)))
        made.make_automaton()
        _automata.append(made)
    return _automata[0]


# ------------------------------------------------------------------ parsers: (text, anchor, first free character)
# Each returns where the kind's reading goes on, and the valid span or None.


def _right(text: str, at: int, allowed: frozenset) -> int:
    """End of the characters of `allowed` from `at` on."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _left(text: str, at: int, floor: int, allowed: frozenset) -> int:
    """Start of the characters of `allowed` that end before `at`."""
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def parse_email(text: str, at: int, free: int) -> tuple[int, tuple[int, int] | None]:
    """Grow an at-sign: local part back to the last match, then labels joined by dots, two at least."""
    start = _left(text, at, free, LOCAL)
    if start == at:
        return free, None
    end = _right(text, at + 1, LABEL)
    labels = int(end > at + 1)
    while labels and end < len(text) and text[end] == ".":
        nxt = _right(text, end + 1, LABEL)
        if nxt == end + 1:
            break
        end, labels = nxt, labels + 1
    return (end, (start, end)) if labels >= 2 else (free, None)


def parse_ip(text: str, at: int, free: int) -> tuple[int, tuple[int, int] | None]:
    """Grow a dot between digits to four numbers from the first that is free; fewer than four leave nothing to read in them."""
    start = _left(text, at, free, DIGITS)
    end = _right(text, start, DIGITS)
    parts = [text[start:end]]
    while len(parts) < 4 and end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
        nxt = _right(text, end + 1, DIGITS)
        parts.append(text[end + 1 : nxt])
        end = nxt
    valid = len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)
    return end, (start, end) if valid else None


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def parse_card(text: str, at: int, free: int) -> tuple[int, tuple[int, int] | None]:
    """Grow two neighbouring digits to the right over digits with at most one blank or hyphen between two."""
    n, end = len(text), at + 1
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    digits = text[at:end].replace(" ", "").replace("-", "")
    return end, (at, end) if 14 <= len(digits) <= 19 and luhn(digits) else None


def parse_phone(text: str, at: int, free: int) -> tuple[int, tuple[int, int] | None]:
    """Grow a plus and a digit to the last digit among the characters of numbers."""
    end = _right(text, at + 2, DIALLED)
    stop = end
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return stop, None
    return end, (at, end) if 10 <= sum(c in DIGITS for c in text[at:end]) <= 15 else None


def wide_email(text: str, at: int) -> tuple[int, int] | None:
    """Addresses that the base form can't hold: letters of any script, a quoted local part."""
    start = at
    if at and text[at - 1] == '"':
        quote = text.rfind('"', max(0, at - 66), at - 1)
        if quote < 0 or quote == at - 2 or "\n" in text[quote:at]:
            return None
        start = quote
    else:
        while start and (text[start - 1] in LOCAL or text[start - 1].isalnum()):
            start -= 1
    if start == at:
        return None
    end, labels = at + 1, 0
    while True:
        nxt = end
        while nxt < len(text) and (text[nxt] in LABEL or text[nxt].isalnum()):
            nxt += 1
        if nxt == end:
            break
        labels, last = labels + 1, nxt
        if not text.startswith(".", nxt):
            break
        end = nxt + 1
    return (start, last) if labels >= 2 else None


def dialled(text: str, at: int) -> tuple[int, int] | None:
    """The number after a scheme."""
    end = _right(text, at + text.startswith("+", at), DIALLED)
    while end > at and text[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if 7 <= sum(c in DIGITS for c in text[at:end]) <= 15 else None


def iban(text: str, at: int) -> int | None:
    """End of the IBAN at `at`, blanks between its groups allowed, if the check sum holds."""
    kept, end = [], at
    while end < len(text) and len(kept) < IBAN_SIZE[1]:
        c = text[end]
        if c.isascii() and c.isalnum():
            kept.append(c.upper())
        elif c != " " or not kept or text[end - 1] == " ":
            break
        end += 1
        if len(kept) >= IBAN_SIZE[0] and not (end < len(text) and text[end].isascii() and text[end].isalnum()):
            code = "".join(kept)
            if code[:2].isalpha() and code[2:4].isdigit() and int("".join(str(int(x, 36)) for x in code[4:] + code[:4])) % 97 == 1:
                return end
    return None


def _gap(text: str, at: int) -> int:
    """Where the punctuation from `at` on ends, MOST_GAP characters at most."""
    limit = min(len(text), at + MOST_GAP)
    while at < limit and text[at] in GAP:
        at += 1
    return at


def account(text: str, at: int) -> tuple[int, int] | None:
    """The IBAN or number that a cue word ending at `at` announces."""
    start = _gap(text, at)
    for word in BETWEEN_WORDS:
        after = start + len(word)
        if start > at and text[start:after].lower() == word and not text[after : after + 1].isalpha():
            start = _gap(text, after)
            break
    if start == at:
        return None  # the cue goes on as another word
    end = iban(text, start)
    if end is not None:
        return start, end
    end, found = start, 0
    while end < len(text) and (text[end] in DIGITS or (found and text[end] in " -" and text[end + 1 : end + 2] in DIGITS)):
        found += text[end] in DIGITS
        end += 1
    whole = not (end < len(text) and (text[end].isalnum() or text[end] in "@_"))
    return (start, end) if 6 <= found <= 18 and whole else None


PARSERS = {"email": parse_email, "ip": parse_ip, "card": parse_card, "phone": parse_phone}


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a text, each by start, then kind."""
    base: list[Span] = []
    rest: list[tuple[str, int, int]] = []  # anchors for added spans
    free = dict.fromkeys(BASE_KINDS, 0)
    for last, (kind, size) in automaton().iter(text):
        at = last - size + 1
        if kind in ("tel", "cue"):
            rest.append((kind, at, last + 1))
            continue
        if at < free[kind]:
            continue
        free[kind], span = PARSERS[kind](text, at, free[kind])
        if span:
            base.append((span[0], KINDS.index(kind), span[1]))
        elif kind == "email":
            rest.append((kind, at, last + 1))
    base.sort()
    return base, _added(text, base, rest) if rest else []


def _added(text: str, base: list[Span], anchors: list[tuple[str, int, int]]) -> list[Span]:
    """Spans grown from the anchors that no base form took."""
    found = []
    for kind, at, after in anchors:
        if kind == "email":
            span, number = wide_email(text, at), KINDS.index("email")
        elif at and text[at - 1].isalnum():
            continue  # the end of another word
        elif kind == "tel":
            span, number = dialled(text, after), KINDS.index("phone")
        else:
            span, number = account(text, after), KINDS.index("account")
        if span:
            found.append((span[0], number, span[1]))
    kept, end, b, reach = [], 0, 0, 0
    for start, number, stop in sorted(found):
        while b < len(base) and base[b][0] < stop:
            reach = max(reach, base[b][2])
            b += 1
        if start >= end and start >= reach:
            kept.append((start, number, stop))
            end = stop
    return kept


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and places of personal data in each text.

    `docs` has doc_id and text; other columns are ignored, whatever their names. Counts and `base_sha256` are those of
    the base kinds; `spans` lists base and added spans as kind:start:end in code points, end exclusive, by start,
    then kind in the order of KINDS. A null or empty text has none. One row per input row, repeated rows and null ids
    included; none for an empty table. Whole texts of any length are read; rows never meet, so no key can be hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = [*[pa.int64()] * 5, pa.string(), pa.string()]
        for batch in arrow_rows(batches, 256):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, added = find_spans(text) if text else ([], [])
                counts = [sum(k == number for _, k, _ in base) for number in range(len(BASE_KINDS))]
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                rows.append((doc_id, *counts, digest, listed(sorted([*base, *added]))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COLUMNS)
