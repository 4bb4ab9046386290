"""Opt-in conversion of microseconds-since-1601 columns at import."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_text, base_columns, ref
from ..functions.moments import webkit_epoch

NAME_HINTS = ("time", "utc", "date")
SHARE = 0.8


def webkit_iso(c: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.mmmZ``, NULL outside the plausible years."""
    text = webkit_epoch(F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), c))
    return F.concat(F.replace(F.substring(text, 1, 23), F.lit(" "), F.lit("T")), F.lit("Z"))


def convert_webkit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Convert the named columns; a value that is no such time stays as it is."""
    chosen = {c.lower() for c in columns}
    return df.select(*[
        F.coalesce(webkit_iso(as_text(df, c)), as_text(df, c)).alias(c) if c.lower() in chosen else ref(c)
        for c in df.columns
    ])


def detect_webkit(df: DataFrame, sample: int | None = None) -> DataFrame:
    """``(column)`` of the columns whose name hints at a time and whose
    filled values (with ``sample``, those of the smallest keys) mostly convert."""
    hinted = [c for c in base_columns(df) if any(word in c.lower() for word in NAME_HINTS)]
    if not hinted:
        return df.sparkSession.createDataFrame([], "column string")

    def cells(name: str) -> DataFrame:
        text = as_text(df, name)
        filled = df.where(F.coalesce(text, F.lit("")) != "")
        if sample is not None:
            filled = filled.orderBy(*[c for c in ("source_id", "rid") if c in df.columns] or [text]).limit(sample)
        return filled.select(F.lit(name).alias("column"), text.alias("v"))

    counted = reduce(DataFrame.unionByName, [cells(c) for c in hinted]).groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count(webkit_iso(F.col("v"))).alias("read")
    )
    return counted.where(F.col("read") >= F.greatest(F.lit(1), F.floor(F.col("n") * SHARE))).select("column")
