"""Session settings and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators rely on; everything else is the cluster's choice.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def case_sensitive(spark: SparkSession):
    """Plans made inside tell ``Id`` from ``id``."""
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="logloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    return f"{shared_folder(spark)}/logloom/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    Cuts lineage, survives executor loss, and later reads prune columns.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SPREAD_BYTES = 4 << 30


def planned_bytes(df: DataFrame) -> int:
    """The size that Spark plans with; nothing runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Give costly per-row work all cores when a small input arrives in a few
    unsplittable pieces (one row group per file).  Decided on the planned size,
    so nothing runs; large inputs have many splits and pass through."""
    if df.isStreaming:
        return df
    spark = df.sparkSession
    size = planned_bytes(df)
    split = 128 << 20
    cores = spark.sparkContext.defaultParallelism
    if size > SPREAD_BYTES or size >= cores * split:
        return df
    return df.repartition(cores)


BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` holds at most
    ``max_rows`` rows; a larger side is left to a shuffle join.  Pass a written
    table: the count is an action."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


BROADCAST_BYTES = 64 << 20


def broadcast_if_light(df: DataFrame, size: Column) -> DataFrame:
    """``broadcast_if_small`` for rows of any width: ``size`` is a row's bytes, and
    their sum counts as well.  A larger side is joined by shuffle even where its
    files, which are compressed, look small.  Pass a written table."""
    held = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("bigint") + 64).alias("bytes")).head()
    small = held["n"] <= BROADCAST_ROWS and (held["bytes"] or 0) <= BROADCAST_BYTES
    return F.broadcast(df) if small else df.hint("merge")
