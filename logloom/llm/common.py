"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, materialise, scratch_path

__all__ = [
    "ORACLES", "QUERIES", "WORD", "broadcast_below", "finite_vector", "materialise", "materialise_blocks", "query",
    "scratch_path", "table", "text_or_empty",
]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"

# Arrow batches are bounded by bytes as well as rows, since one text may be long.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its oracle."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def broadcast_below(df: DataFrame, size: Column, limit: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only after summing that the written table ``df`` holds
    less than ``limit`` bytes; beyond that the join shuffles, also where the
    files, which are compressed, look small to Spark."""
    total = df.agg(F.sum(size.cast("bigint") + 64).alias("n")).first()["n"] or 0
    return F.broadcast(df) if total < limit else df.hint("merge")


def materialise_blocks(df: DataFrame, label: str) -> DataFrame:
    """Like ``materialise`` for rows of a megabyte or so: row groups are small,
    so that a scan holds few such rows at a time."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("parquet.block.size", 8 << 20).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finite_vector(vector: Column) -> Column:
    """Not null, and without null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))
