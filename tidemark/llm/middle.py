"""Fill-in-the-middle documents, cut with the repeated captures of one regular expression.

`(unit)*` is matched against the whole text once. The regex library keeps every repetition of the group, so
`match.ends(1)` lists where each unit ends: its length is the number of units, and its entries are the offsets
of both cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import arrow_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are transformed, and percent of those with the suffix in front.
TRANSFORMED, SUFFIX_FIRST = 90, 20
CODE_POINT = "(?s:.)"
COLUMNS = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output string"
)


def draws(doc_id: int | None, seed: str = "1:") -> list[int]:
    """Four unsigned numbers of 32 bits from the id; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(text: str, numbers: list[int], units: regex.Pattern) -> tuple[int, str, str, str, str]:
    """Units, form, prefix, middle and output of a text; plain texts have no parts."""
    match = units.fullmatch(text)
    if match is None:
        raise ValueError("repeated units must be able to cover any text")
    ends = match.ends(1)
    n = len(ends)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or numbers[2] % 100 >= TRANSFORMED:
        return n, "plain", "", "", text
    first, second = sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if numbers[3] % 100 < SUFFIX_FIRST:
        return n, "spm", prefix, middle, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", prefix, middle, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text an output was made of. Its parts hold no mark, so the first of each kind is the one put in."""
    if form == "plain":
        return output
    lead, inner = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output[len(lead) :].partition(inner)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, keep: bool = True) -> DataFrame:
    """Each document with its middle moved to the end, the digest of the output and of the text rebuilt from it.

    `docs` has doc_id and text; other columns are ignored, whatever their names. `unit` is the expression of one unit
    (without groups of its own); the cuts lie between units, and the units must be able to cover any text. A null text
    counts as empty; an empty text, and one that holds a mark, stays plain. Cuts depend on doc_id alone, so repeated
    rows give equal rows and rows without an id count as one with an empty id. `output` is null unless kept. One row
    per input row, none for an empty table. A text of any length is matched whole, with about 50 bytes of memory
    for each of its units while it is cut; rows never meet, so no key can be hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(f"({unit})*+")
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3]
        for batch in arrow_rows(batches, 256):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                n, form, prefix, middle, output = transform(text, draws(doc_id), units)
                sizes = (None, None) if form == "plain" else (len(prefix), len(middle))
                rows.append((doc_id, n, form, *sizes, _digest(output), _digest(restore(output, form)), output if keep else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COLUMNS)
