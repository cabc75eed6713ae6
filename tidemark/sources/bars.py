"""Reading, normalising and building bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.layout import DAY, running_carry

OHLCV = ("open", "high", "low", "close", "volume")
CANONICAL = ("time", *OHLCV)
CSV_SCHEMA = T.StructType(
    [T.StructField("time", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "Volume")]
)
# Fixed value: how exports are named.
FILE_PATTERN = r"^(.+)_([^_,]+), (\d+|1D)_([0-9a-f]+)\.csv$"
# Exports known to repeat another file of a corpus; none unless the caller names them.
KNOWN_DUPLICATES: tuple[str, ...] = ()


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def read_bars(
    spark: SparkSession, path: str, since: int | None = None, lookback: int = 0, bar_seconds: int = DAY
) -> DataFrame:
    """Bars from a folder of CSV files, with file name and a line order for keep-last.

    Bars are not inferred. With `since`, rows older than `lookback` bars before it are not read. `line_no` orders the
    lines of a file however it is split: by where the split begins, then by place in the split.
    """
    df = spark.read.schema(CSV_SCHEMA).option("header", True).csv(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))
    df = df.withColumns({"file_name": F.url_decode(F.col("_metadata.file_name")), "line_no": place})
    return df if since is None else df.filter(F.col("time") >= since - lookback * bar_seconds)


def provenance(file_name: Column) -> dict[str, Column]:
    """exchange, ticker, tf, file_hash from a file name; null where it does not match."""

    def part(i: int) -> Column:
        return F.when(file_name.rlike(FILE_PATTERN), F.regexp_extract(file_name, FILE_PATTERN, i))

    return {"exchange": part(1), "ticker": part(2), "tf": part(3), "file_hash": part(4)}


def with_provenance(df: DataFrame, strict: bool = False) -> DataFrame:
    """Add provenance columns; `strict` fails on a name that does not match."""
    out = df.withColumns(provenance(F.col("file_name")))
    if strict:
        # a filter runs whichever columns are read afterwards
        bad = F.raise_error(F.concat(F.lit("unparsable file name: "), F.col("file_name"))).cast("boolean")
        out = out.filter(F.when(F.col("ticker").isNull(), bad).otherwise(F.lit(True)))
    return out


def quarantine(df: DataFrame) -> DataFrame:
    """File names that carry no provenance."""
    return df.filter(F.col("ticker").isNull()).select("file_name").distinct()


def drop_known_duplicates(df: DataFrame, names: Sequence[str] = KNOWN_DUPLICATES) -> DataFrame:
    """Skip files on a fixed list."""
    return df.filter(~F.col("file_name").isin(list(names))) if names else df


def collisions(df: DataFrame) -> DataFrame:
    """(ticker, tf) pairs that come from more than one file; partial aggregation per file first."""
    files = df.groupBy("ticker", "tf", "file_name").agg(F.count(F.lit(1)).alias("rows"))
    per = files.groupBy("ticker", "tf").agg(
        F.count(F.lit(1)).alias("n_files"), F.min("file_name").alias("first_file"), F.sum("rows").alias("rows")
    )
    return per.filter("n_files > 1")


def resolve_collisions(df: DataFrame, policy: str = "raise") -> DataFrame:
    """`first`: the first file by name wins; `raise`: a collision fails the job.

    Rows without provenance collide with nothing and stay.
    """
    files = df.select("ticker", "tf", "file_name").distinct()
    firsts = files.groupBy("ticker", "tf").agg(F.min("file_name").alias("_first"), F.count(F.lit(1)).alias("_n"))
    if policy == "first":
        keep = firsts.select("ticker", "tf", F.col("_first").alias("file_name"))
        known = df.join(keep, ["ticker", "tf", "file_name"], "left_semi")
        return known.unionByName(df.filter(F.col("ticker").isNull() | F.col("tf").isNull()))
    if policy != "raise":
        raise ValueError(f"unknown policy {policy!r}")
    msg = F.concat(F.lit("several files for "), F.col("ticker"), F.lit(" "), F.col("tf"))
    checked = firsts.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(msg).cast("boolean")).otherwise(F.lit(True)))
    return df.join(checked.select("ticker", "tf", "_ok"), ["ticker", "tf"], "left").filter(F.coalesce("_ok", F.lit(True))).drop("_ok")


def normalize_bars(df: DataFrame, key: Sequence[str] = ("symbol",), ingest: Sequence[str] = ("file_name", "line_no")) -> DataFrame:
    """Canonical columns and types, one bar per (key, time): the last ingested wins.

    The aggregation is partial, so repeated keys shrink before the shuffle. Packed bars and ingest keys make it sort
    each map task's rows, as hash aggregation needs values of fixed size.
    """
    if "Volume" in df.columns:
        df = df.withColumnRenamed("Volume", "volume")
    require_columns(df, [*key, *CANONICAL, *ingest])
    packed = F.struct(*[F.col(c).cast("double").alias(c) for c in OHLCV])
    last = df.groupBy(*key, F.col("time").cast("long").alias("time")).agg(
        F.max_by(packed, F.struct(*ingest)).alias("_b")
    )
    return last.select(*key, "time", *[F.col(f"_b.{c}").alias(c) for c in OHLCV])


def monotonic_violations(df: DataFrame, seq: str, slice_rows: int = 100_000) -> DataFrame:
    """Rows whose time does not exceed the time of the row before by the numeric column `seq`, per symbol.

    Slices of `seq` are checked on their own; the last time of the earlier slices is carried in.
    """
    seen = running_carry(
        df, lasts={"prev_time": F.col("time")}, chunk_by=F.floor(F.col(seq) / F.lit(slice_rows)), order=(seq,), strict=True
    )
    return seen.filter(F.col("time") <= F.col("prev_time"))


def duplicate_times(df: DataFrame) -> DataFrame:
    """(symbol, time) that occur more than once: what breaks strict order after sorting by time."""
    return df.groupBy("symbol", "time").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


# --------------------------------------------------------------------------- ticks and resampling


def epoch_seconds(df: DataFrame, col: str) -> Column:
    """Whole seconds since 1970 of a timestamp column, with or without time zone; floors negatives."""
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
        return F.floor(micros / F.lit(1_000_000))
    return F.unix_seconds(F.col(col))


def instant(df: DataFrame, col: str) -> Column:
    """The column as a timestamp with time zone, reading values without one as UTC."""
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)"))
    return F.col(col)


def bucket(time: Column, seconds: int, origin: int = 0) -> Column:
    """Left edge of the bucket; floors, so negative times work."""
    return (F.floor((time - F.lit(origin)) / F.lit(seconds)) * F.lit(seconds) + F.lit(origin)).cast("long")


def ticks_to_bars(
    df: DataFrame, key: Column, ts: Column, price: Column, qty: Column, seconds: int, order: Sequence[Column]
) -> DataFrame:
    """First, highest, lowest, last price and total quantity per (symbol, bucket).

    `order` must be unique inside a bucket. All five aggregates are partial, so a hot symbol shrinks before the
    shuffle, and the result is keyed by (symbol, bucket), not by symbol.
    """
    t = df.select(
        key.alias("_k"),
        bucket(ts, seconds).alias("time"),
        price.cast("double").alias("_p"),
        qty.cast("double").alias("_q"),
        # a single key goes in bare: then the aggregation hashes rows instead of sorting them
        (order[0] if len(order) == 1 else F.struct(*order)).alias("_o"),
    )
    bars = t.groupBy("_k", "time").agg(
        F.min_by("_p", "_o").alias("open"),
        F.max("_p").alias("high"),
        F.min("_p").alias("low"),
        F.max_by("_p", "_o").alias("close"),
        F.sum("_q").alias("volume"),
    )
    return bars.select(F.col("_k").cast("string").alias("symbol"), "time", *OHLCV)


def resample_bars(df: DataFrame, seconds: int, origin: int = 0) -> DataFrame:
    """Coarser bars; empty buckets do not appear, nulls are skipped by first and last."""
    t = df.withColumn("_b", bucket(F.col("time"), seconds, origin))

    def edge(fn, col: str) -> Column:
        return fn(col, F.when(F.col(col).isNotNull(), F.col("time")))

    return t.groupBy("symbol", F.col("_b").alias("bucket_time")).agg(
        edge(F.min_by, "open").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        edge(F.max_by, "close").alias("close"),
        F.sum("volume").alias("volume"),
    ).withColumnRenamed("bucket_time", "time")


def with_bar_date(df: DataFrame, strict: bool = False) -> DataFrame:
    """Calendar date of the bar; `strict` leaves negative times null."""
    d = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("time") / F.lit(DAY)).cast("int"))
    return df.withColumn("bar_date", F.when(F.col("time") >= 0, d) if strict else d)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Persist a result (`parquet`, or `json` for rule tables)."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)
