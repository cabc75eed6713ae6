"""The queries against their SQL, and the pipeline's stages against brute force over the small tables."""

import re

import corpus_pipeline
import pytest
from compare import SF_DIR, diff, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.llm import jaccard, lines, quality
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.llm.tables import table


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, con, name):
    msg, exact = diff(QUERIES[name](spark, SF_DIR), ORACLES[name], con)
    assert msg is None and exact, msg


def test_all_are_registered():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_stages(spark, tmp_path):
    """Each stage takes what the one before kept, and its decisions take effect."""
    docs = table(spark, SF_DIR, "documents")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        if i < 3:
            assert out.schema == docs.schema
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append({r.doc_id: r for r in docs.collect()} if i < 3 else docs.collect())
    first = {r.doc_id: r for r in table(spark, SF_DIR, "documents").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SF_DIR, "labels").collect()}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept[0] for d in good) >= 0.98 * len(good)
    assert sum(d in kept[0] for d in bad) <= 0.1 * len(bad)
    assert all(kept[0][d] == first[d] for d in kept[0])

    before, after = set(), {}
    for d in sorted(kept[0]):
        left = []
        for line in kept[0][d].text.split("\n"):
            normal = lines.normal_form(line)
            counts = len(normal.split()) >= lines.MIN_WORDS and len(normal.encode()) >= lines.MIN_BYTES
            if counts and normal in before:
                continue
            before |= {normal} if counts else set()
            left.append(line)
        after[d] = left
    for d, r in kept[1].items():
        got = r.text.split("\n")
        assert r.n_chars == len(r.text)
        assert got == [x for x in after[d] if x in set(got)]  # nothing but repeats goes, in order
        gone = [x for x in after[d] if x not in set(got)]
        assert all(any(lines.similar(lines.normal_form(x), y, lines.SIMILARITY) for y in before if y != lines.normal_form(x)) for x in gone)
    for d in after:
        if d not in kept[1]:  # nothing was left, or nothing but lines that nearly repeat others
            assert all(not x.strip() or any(lines.similar(lines.normal_form(x), y, lines.SIMILARITY) for y in before if y != lines.normal_form(x)) for x in after[d])

    sets = {d: set(re.findall(r"\S+", r.text)) for d, r in kept[1].items()}
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.read.parquet(str(tmp_path / "1"))).collect()}
    assert set(kept[2]) == {d for d, c in found.items() if d == c} and len(sets) == len(found)

    per_doc = {}
    for r in kept[3]:
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + r.length
    assert {r.doc_id: r.doc_tokens for r in kept[3]} == per_doc and set(per_doc) == set(kept[2])
    padding = sum({r.sequence_id: r.padded_length - r.sequence_length for r in kept[3]}.values())
    assert padding < 0.03 * sum(per_doc.values())


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert out.select(F.sum("length")).first()[0] > 0


def test_held_out_labels(spark):
    """On the next larger tables, as these have too few labels to hold half of them out."""
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    fitted = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    rows = quality.quality(docs, fitted).withColumnRenamed("quality", "p").join(labels.join(fitted, "doc_id", "left_anti"), "doc_id").collect()
    assert len(rows) > 20 and sum(r.keep == (r.quality == 1) for r in rows) >= 0.93 * len(rows)
