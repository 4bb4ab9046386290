"""Edge lists and node degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_text, data_fields
from .grouping import top_with_flag

ABSENT = ("", "-")  # how exports spell a missing host


def edges(df: DataFrame, src: str, dst: str, label: str | None = None, limit: int | None = 500) -> DataFrame:
    """``(src, dst, n[, labels], truncated)`` of the ``limit`` heaviest edges;
    ``limit=None`` gives all edges, without the flag.

    Blank ends and self-loops are dropped.  The
    distinct labels are counted after a shuffle on (pair, label), so a pair with
    a third of the rows is spread out."""
    names = {f.name for f in data_fields(df)}
    for column in [src, dst] + ([label] if label else []):
        if column not in names:
            raise ValueError(f"No column {column!r}")
    if src == dst:
        raise ValueError("Source and destination must differ")
    a, b = as_text(df, src), as_text(df, dst)
    kept = df.where(~a.isin(*ABSENT) & ~b.isin(*ABSENT) & (a != b))
    keys = [a.alias("src"), b.alias("dst")]
    if label:
        # Two additive steps instead of a distinct count over whole pairs.
        pairs = kept.groupBy(*keys, as_text(df, label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
        grouped = pairs.groupBy("src", "dst").agg(F.sum("_n").alias("n"), F.count("_label").alias("labels"))
    else:
        grouped = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if limit is None:
        return grouped
    order = [F.col("n").desc(), F.col("src").asc(), F.col("dst").asc()]
    return top_with_flag(grouped, order, limit)


def node_degrees(edge_list: DataFrame) -> DataFrame:
    """``(node, degree, out_degree)``, weighted by edge counts."""
    ends = edge_list.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.col("n").alias("n"), F.col("n").alias("out")),
        F.struct(F.col("dst").alias("node"), F.col("n").alias("n"), F.lit(0).cast("bigint").alias("out")),
    )).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("n").alias("degree"), F.sum("out").alias("out_degree"))
