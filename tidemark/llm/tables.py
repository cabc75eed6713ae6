"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its DuckDB twin."""

    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups_for(rows: int, each: int, least: int = 1) -> int:
    """Number of groups that hold about `each` rows, so that groups stay alike as tables grow."""
    return max(least, -(-rows // each))


def rows_of(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1)).alias("n")).first()["n"]


def arrow_rows(batches: Iterator[pa.RecordBatch], at_most: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded length."""
    for batch in batches:
        for start in range(0, batch.num_rows, at_most):
            yield batch.slice(start, at_most)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as `df` needs to have no such column."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out
