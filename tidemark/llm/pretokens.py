"""Byte-level BPE ids of whole texts: pretokens are cut with NumPy, each distinct one is encoded once a worker."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidemark.llm.idtable import IdTable
from tidemark.llm.wordhash import blocks, hash_ranges

OTHER, LETTER, NUMBER, WHITE, UNSURE = range(5)

#: White space of the split pattern, and control characters on which regex libraries differ.
WHITE_SPACE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CONTROLS = "\x1c\x1d\x1e\x1f\x85\u180e\u200b\u2060\ufeff"

_state: dict = {}


def _classes() -> np.ndarray:
    """Class of each code point; UNSURE where Unicode versions may differ."""
    if "classes" not in _state:
        old = unicodedata.ucd_3_2_0.category
        out = np.full(0x110000, UNSURE, np.uint8)
        for c in range(0x20000):
            kind = unicodedata.category(chr(c))
            if kind == old(chr(c)) and kind != "Cn":
                out[c] = {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
        out[[ord(c) for c in WHITE_SPACE]] = WHITE
        out[[ord(c) for c in CONTROLS]] = UNSURE
        _state["classes"] = out
    return _state["classes"]


def split_points(points: np.ndarray, first: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pretokens begin: code points of joined texts, index of each text's first, class of each point."""
    n = len(points)
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins[n] = True
    white = kind == WHITE
    before_white = np.zeros(n, bool)
    before_white[1:] = white[:-1] & ~begins[1:n]
    after_plain = np.zeros(n, bool)
    after_plain[:-1] = ~white[1:] & ~begins[1:n]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (points[:-1] == 32) & ~begins[1:n]
    changed = np.ones(n, bool)
    changed[1:] = kind[1:] != kind[:-1]
    cut = np.where(white, ~before_white | after_plain, np.where(before_white, ~after_blank, changed)) | begins[:n]
    # contractions stand alone: an apostrophe that begins a pretoken, and one or two letters
    quote = np.flatnonzero((points == 39) & cut)
    if len(quote):
        pad = np.concatenate([points, np.zeros(3, points.dtype)])
        ends = np.concatenate([begins, np.ones(3, bool)])
        one, two = pad[quote + 1], pad[quote + 2]
        inside = ~ends[quote + 1]
        short = inside & np.isin(one, [ord(c) for c in "stmd"])
        pair = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        long = inside & ~short & ~ends[quote + 2] & pair
        for which, size in ((short, 2), (long, 3)):
            at = quote[which]
            cut[at + 1] = False
            after = at + size
            cut[after[after < n]] = True
    return cut


def load(path: str) -> dict:
    """Tokenizer of this worker, loaded once."""
    if path not in _state:
        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        model = json.loads(whole.to_str())["model"]
        # byte-level vocabularies write each byte as one printable character
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        of_char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(of_char[c] for c in piece): i for piece, i in model["vocab"].items() if set(piece) <= of_char.keys()}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        encode = None
        if all(a < b for a, b in zip(merged, merged[1:], strict=False)) and len(set(ranks.values())) == len(ranks):
            # merges are in the order of their ids, so ids can serve as ranks
            single = {b: i for b, i in ranks.items() if len(b) == 1}
            known = set(merged) | set(single.values())
            piece = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks={b: i for b, i in ranks.items() if i in known}, special_tokens={})
            encode = lambda b: piece.encode_ordinary(b.decode())
        else:
            encode = lambda b: whole.encode(b.decode(), add_special_tokens=False).ids
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        _state[path] = {"whole": whole, "special": [s.encode() for s in special], "table": IdTable(encode)}
    return _state[path]


def text_ids(column: pa.Array | pa.ChunkedArray, path: str) -> Iterator[np.ndarray]:
    """Token ids of each text as the tokenizer gives them without added special tokens; null counts as empty.

    Texts that hold a special token's string, or characters on which Unicode versions differ, go to the tokenizer whole.
    """
    tok, classes = load(path), _classes()
    for _, at, raw in blocks(column):
        n = len(at) - 1
        data = raw.tobytes()
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        first = np.searchsorted(lead, at)
        kind = classes[points]
        odd = np.zeros(n, bool)
        strange = np.flatnonzero(kind == UNSURE)
        if len(strange):
            odd[np.searchsorted(first, strange, "right") - 1] = True
        for s in tok["special"]:
            if s in data:
                odd |= [s in data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        cut = np.flatnonzero(split_points(points, first[:-1][first[:-1] < len(points)], kind)) if len(points) else np.zeros(0, np.int64)
        start = lead[cut]
        end = np.append(start[1:], len(raw))[: len(start)]
        ids, before = tok["table"].gather(tok["table"].entries(hash_ranges(raw, start, end), raw, start, end))
        bound = before[np.searchsorted(start, at)]
        for k in range(n):
            if odd[k]:
                whole = tok["whole"].encode(data[at[k] : at[k + 1]].decode(), add_special_tokens=False).ids
                yield np.array(whole, np.uint32)
            else:
                yield ids[bound[k] : bound[k + 1]]
