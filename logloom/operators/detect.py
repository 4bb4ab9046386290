"""Type inference, timestamp-format detection, document sniffing, field discovery.

Detection reads the whole column; with ``sample`` it looks at the rows with
the smallest keys that hold a value, which are the same rows every time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import documents
from ..functions.columns import (
    DATETIME, NUMBER, TEXT, as_text, base_columns, logical_types,
)
from ..functions.registry import OPERATIONS, detection_params
from ..functions.scalars import DATE_PATTERN, NUMBER_PATTERN, stripped
from ..session import materialise, spread
from .derived import definitions

def infer_types(df: DataFrame, sample: int | None = None) -> DataFrame:
    """``(column, type)``: number if all filled values are, datetime if at
    least four in five are, else text."""
    rows = df
    if sample is not None:
        rows = df.where(F.col("rid") <= sample) if "rid" in df.columns else df.orderBy(*df.columns).limit(sample)
    names = base_columns(df)
    measures = []
    for i, name in enumerate(names):
        text = as_text(df, name)
        filled = F.coalesce(text, F.lit("")) != ""
        measures += [
            F.count_if(filled).alias(f"n{i}"),
            F.count_if(filled & text.rlike(NUMBER_PATTERN)).alias(f"num{i}"),
            F.count_if(filled & text.rlike(DATE_PATTERN)).alias(f"dt{i}"),
        ]
    counted = rows.agg(*measures)

    def verdict(i: int):
        n, numbers, dates = F.col(f"n{i}"), F.col(f"num{i}"), F.col(f"dt{i}")
        enough = F.greatest(F.lit(1), F.floor(n * 0.8))
        return F.when(n == 0, TEXT).when(numbers == n, NUMBER).when(dates >= enough, DATETIME).otherwise(TEXT)

    rows_out = F.array(*[F.struct(F.lit(n).alias("column"), verdict(i).alias("type")) for i, n in enumerate(names)])
    return counted.select(F.inline(rows_out))


def _visible_ops():
    return [op for op in OPERATIONS.values() if not op.hidden]


def _cells(df: DataFrame, column: str, sample: int | None) -> DataFrame:
    """The filled values of one column as ``v``."""
    keys = [c for c in ("source_id", "rid") if c in df.columns]
    cells = df.select(*keys, as_text(df, column).alias("v")).where(stripped(F.col("v")) != "")
    if sample is None:
        return spread(cells.select("v"))
    return cells.orderBy(*keys or ["v"]).limit(sample).select("v")


def _shares(ops) -> list:
    """One aggregate per operation: the share of values ``v`` it reads."""
    return [
        F.avg(F.when(op.build(F.col("v"), **detection_params(op)).isNotNull(), 1.0).otherwise(0.0)).alias(f"c{i}")
        for i, op in enumerate(ops)
    ]


def detect_format(df: DataFrame, column: str, sample: int | None = None) -> DataFrame:
    """``(op_id, confidence)`` of every operation that reads some value, best
    first; the registry's order breaks ties."""
    ops = _visible_ops()
    rows = F.array(*[
        F.struct(F.lit(op.id).alias("op_id"), F.lit(i).alias("rank"), F.col(f"c{i}").alias("confidence"))
        for i, op in enumerate(ops)
    ])
    shares = _cells(df, column, sample).agg(*_shares(ops)).select(F.inline(rows)).where(F.col("confidence") > 0)
    return shares.orderBy(F.col("confidence").desc(), "rank").select("op_id", "confidence")


def suggest_timestamp_columns(
    df: DataFrame, min_confidence: float = 0.9, sample: int | None = None
) -> DataFrame:
    """``(column, op_id, confidence)``: columns that look like timestamps but
    are neither datetime columns nor converted already."""
    types = logical_types(df)
    converted = {d["input_column"].lower() for d in definitions(df)}
    names = [c for c in base_columns(df) if types[c] != DATETIME and c.lower() not in converted]
    empty = df.sparkSession.createDataFrame([], "column string, op_id string, confidence double")
    if not names:
        return empty
    ops = _visible_ops()
    if sample is None:
        cells = spread(df).select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("column"), as_text(df, n).alias("v")) for n in names
        ])).alias("c")).select("c.*").where(stripped(F.col("v")) != "")
    else:
        cells = reduce(
            DataFrame.unionByName,
            [_cells(df, n, sample).select(F.lit(n).alias("column"), "v") for n in names],
        )
    # The largest share wins; among equal shares the earlier operation.
    best = F.array_max(F.array(*[
        F.struct(F.col(f"c{i}").alias("confidence"), F.lit(-i).alias("rank"), F.lit(op.id).alias("op_id"))
        for i, op in enumerate(ops)
    ]))
    found = cells.groupBy("column").agg(*_shares(ops)).select("column", best.alias("b"))
    return (
        found.select("column", "b.op_id", "b.confidence")
        .where(F.col("confidence") >= min_confidence)
        .orderBy("column")
    )


def sniff_document_kind(df: DataFrame, column: str, sample: int | None = None) -> DataFrame:
    """One row ``(kind, sampled)``: json or xml when most filled values parse."""
    cells = _cells(df, column, sample)
    value = F.col("v")
    counted = cells.agg(
        F.count(F.lit(1)).alias("sampled"),
        F.count_if(documents.as_variant(value).isNotNull()).alias("json"),
        F.count_if(documents.wrapped_xml(value).isNotNull()).alias("xml"),
    )
    kind = F.when(F.col("json") * 2 > F.col("sampled"), "json").when(F.col("xml") * 2 > F.col("sampled"), "xml")
    return counted.select(kind.alias("kind"), "sampled")


def discover_fields(
    df: DataFrame, column: str, kind: str | None = None, sample: int | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """``(path, count, coverage, nonempty, sample)`` of the leaves in a document
    column: fields with content first, then by coverage, then by path."""
    # Everything below reads the same cells, found once.
    cells = materialise(_cells(df, column, sample), "cells")
    if kind is None:
        kind = sniff_document_kind(cells, "v").head()["kind"]
    if kind is None:
        return df.sparkSession.createDataFrame(
            [], "path string, count bigint, coverage double, nonempty bigint, sample string"
        )
    if kind == "json":
        parsed, leaves = documents.as_variant(F.col("v")), documents.json_leaf_rows(cells, "v", max_depth)
    else:
        parsed, leaves = documents.wrapped_xml(F.col("v")), documents.xml_leaf_rows(cells, "v")
    filled = F.when(F.col("value") != "", F.substring("value", 1, 200))
    docs = cells.agg(F.count(parsed)).scalar()
    found = leaves.select("path", "value").groupBy("path").agg(
        F.count(F.lit(1)).alias("count"),
        F.count(filled).alias("nonempty"),
        F.coalesce(F.min(filled), F.lit("")).alias("sample"),
    )
    return (
        found.select("path", "count", (F.col("count") / docs).alias("coverage"), "nonempty", "sample")
        .orderBy(F.col("nonempty").desc(), F.col("count").desc(), "path")
    )


def suggested_names(fields: DataFrame, kind: str) -> list[tuple[str, str]]:
    """``(path, column name)`` for a list of discovered fields, one row per path."""
    return [(r["path"], documents.suggest_name(r["path"], kind)) for r in fields.select("path").collect()]

