"""Fixity of WARC replicas: Merkle trees over records and offset ranges, compared from the roots down.

A leaf range of a file covers RANGE_BYTES of offsets and hashes the records that begin in it, in order; FANOUT
neighbouring ranges make one of the next level, up to one root for each file. Two replicas' roots are compared, and
below them only the ranges that differ, down to single records. Ranges go by offset alone, so that a file of any size
is hashed in pieces and no task sees all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import groups_for, rows_of
from tidemark.session import materialise

RANGE_BYTES, FANOUT = 1 << 16, 16
FILE_RECORDS = 500
RECORD = "file long, offset long, length long, digest string"


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC 1.1 resource record as bytes; nulls count as empty."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def records(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """page_id, file and record of each page: files hold neighbouring page ids; pages without one are dealt by content."""
    spread = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(groups_for(rows_of(pages), file_records)))
    file = F.coalesce(F.floor(F.col("page_id") / file_records), spread).cast("long")
    return pages.select(F.col("page_id").cast("long"), file.alias("file"), warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def digests(found: DataFrame, record: Column | None = None) -> DataFrame:
    """SHA-256 and length of each record; `record` gives the bytes to hash, the stored ones by default."""
    return found.select("page_id", "file", F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record") if record is None else record, 256).alias("digest"))


def with_offsets(found: DataFrame) -> DataFrame:
    """Offset of each record in its file, in order of page_id; files have a bounded number of records."""
    before = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_last(), "digest", "length").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def _range(offset: Column, level: int) -> Column:
    return F.floor(offset / (RANGE_BYTES * FANOUT**level)).cast("long")


def tree(found: DataFrame, levels: int) -> list[DataFrame]:
    """Ranges of each level, leaf ranges first: file, number, digest, records. The last level has the roots.

    A leaf range's digest covers its records' offsets, lengths and digests in order, a higher one's its ranges' numbers
    and digests, so that a record or range that is missing or moved changes all above it.
    """
    item = F.struct("offset", "length", "digest")
    text = F.transform(F.array_sort("items"), lambda r: F.concat_ws(":", r["offset"], r["length"], r["digest"]))
    leaf = found.groupBy("file", _range(F.col("offset"), 0).alias("number")).agg(F.collect_list(item).alias("items"))
    out = [materialise(leaf.select("file", "number", F.sha2(F.array_join(text, "\n"), 256).alias("digest"), F.size("items").cast("long").alias("records")))]
    for _ in range(levels):
        below = out[-1].groupBy("file", F.floor(F.col("number") / FANOUT).cast("long").alias("above"))
        below = below.agg(F.collect_list(F.struct("number", "digest")).alias("items"), F.sum("records").alias("records"))
        text = F.transform(F.array_sort("items"), lambda r: F.concat_ws(":", r["number"], r["digest"]))
        out.append(materialise(below.select("file", F.col("above").alias("number"), F.sha2(F.array_join(text, "\n"), 256).alias("digest"), "records")))
    return out


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ranges that are in one tree only or differ: file, number."""
    b = b.select("file", "number", F.col("digest").alias("other"))
    return a.select("file", "number", "digest").join(b, ["file", "number"], "full").where(~F.col("digest").eqNullSafe(F.col("other"))).select("file", "number")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records in which two replicas differ: file, offset, lengths and digests on both sides, and a status.

    Both have file, offset, length and digest of each record; other columns are ignored. The status is changed, or
    missing or extra where the second replica lacks a record or has one more at the offset. Records without file or
    offset can't be placed and are left out; records that repeat at one offset are compared as one list. Empty tables
    have empty trees; equal replicas give no rows. Below a range that agrees nothing is compared.
    """
    first, second = (materialise(r.select("file", "offset", "length", "digest").where("file is not null and offset is not null")) for r in (first, second))
    top = first.unionByName(second).agg(F.max("offset")).first()[0] or 0
    levels = 0
    while top >= RANGE_BYTES * FANOUT**levels:
        levels += 1
    a, b = tree(first, levels), tree(second, levels)
    bad = materialise(_differing(a[-1], b[-1]))
    for x, y in zip(a[-2::-1], b[-2::-1], strict=True):
        inside = bad.select("file", F.col("number").alias("above"))
        x, y = (t.withColumn("above", F.floor(F.col("number") / FANOUT).cast("long")).join(inside, ["file", "above"], "left_semi") for t in (x, y))
        bad = materialise(_differing(x, y))

    def located(r: DataFrame, name: str) -> DataFrame:
        inside = r.withColumn("number", _range(F.col("offset"), 0)).join(bad, ["file", "number"], "left_semi")
        at = inside.groupBy("file", "offset").agg(F.sort_array(F.collect_list(F.struct("length", "digest"))).alias("found"))
        return at.select("file", "offset", F.element_at("found", 1)["length"].alias(f"{name}_length"), F.array_join("found.digest", ",").alias(f"{name}_digest"))

    both = located(first, "first").join(located(second, "second"), ["file", "offset"], "full")
    status = F.when(F.col("second_digest").isNull(), "missing").when(F.col("first_digest").isNull(), "extra").otherwise("changed")
    return both.where(~F.col("first_digest").eqNullSafe(F.col("second_digest"))).withColumn("status", status)


def write_warc(found: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Write `records` as WARC files, one folder for each file number; text of other encodings than UTF-8 isn't kept."""
    ordered = found.repartition(groups_for(rows_of(found), file_records), "file").sortWithinPartitions("file", F.col("page_id").asc_nulls_last())
    line = F.expr("substring(record, 1, length(record) - 2)").cast("string").alias("value")  # the writer ends each with CR LF
    ordered.select(line, "file").write.partitionBy("file").option("lineSep", "\r\n").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of written WARC files: file, offset, length, digest. Files are cut by the lengths that records state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, at = [], 0
                while at < len(data):
                    body = data.find(b"\r\n\r\n", at) + 4
                    head = data[at:body].lower()
                    length = int(head.split(b"content-length:")[1].split(b"\r\n")[0]) if body > 3 and b"content-length:" in head else len(data) - body
                    end = body + length + 4
                    rows.append((file, at, end - at, hashlib.sha256(data[at:end]).hexdigest()))
                    at = end
                yield pa.RecordBatch.from_pylist([dict(zip(("file", "offset", "length", "digest"), r, strict=True)) for r in rows])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    number = F.regexp_extract("path", r"/file=(-?\d+)/", 1).cast("long")
    return files.select(number.alias("file"), "content").mapInArrow(run, RECORD)


def aged_copy(found: DataFrame) -> tuple[DataFrame, Column]:
    """A second replica for trials, from the same records: some are gone, and of some the last body byte has changed."""
    kept = found.where(F.coalesce(F.col("page_id") % 211 != 7, F.lit(True)))
    n = F.octet_length("record")
    worn = F.concat(F.expr("substring(record, 1, length(record) - 5)"), F.lit("?\r\n\r\n").cast("binary"))
    return kept, F.when((F.col("page_id") % 101 == 5) & (n > 5), worn).otherwise(F.col("record"))
