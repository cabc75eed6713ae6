"""Session helpers: checkpoint folder and materialised intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "tidemark") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own.

    The JVM does not compile methods above 8000 bytes, and whole-stage code over wide rows makes such methods: plans
    of more than 40 columns go through separate projections, whose code is split. Other plans keep whole-stage code.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus != "*" else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.codegen.maxFields", "40")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as `spark.checkpoint.dir` names it.

    A session on one machine may leave it unset and gets a folder of its own; on a cluster that is an error, as
    executors don't see the driver's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_folder()
    return root.rstrip("/")


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def scratch_folder(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables. They stay, as lazy results read them, until `clear_scratch`."""
    return f"{checkpoint_root(spark)}/tidemark-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that were built on them can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Write `df` once below the scratch folder, with `options` of the writer, and read it back.

    Cuts lineage with a table that outlives any executor, and pins values that must not
    differ between two uses (row numbers taken from a physical order).
    """
    path = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that `materialise` wrote and nothing reads any more."""
    spark, scratch = df.sparkSession, scratch_folder(df.sparkSession)
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/{scratch.rpartition('/')[2]}/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt out by `keys` over all shuffle partitions, however few bytes it has.

    Adaptive execution sizes partitions by bytes, and a small written table comes back as one; rows that each stand for
    much work then share a task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *keys)
