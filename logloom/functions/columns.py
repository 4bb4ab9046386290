"""Column references, logical types and the text view of typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT, NUMBER, DATETIME, DURATION = "text", "number", "datetime", "duration"
KEYS = ["source_id", "rid"]
# Bookkeeping columns that are never part of a source's own data.
SYSTEM_COLUMNS = {"source_id", "rid", "pos"}


def ref(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def logical_type(field: T.StructField) -> str:
    declared = (field.metadata or {}).get("logical_type")
    if declared:
        return declared
    if isinstance(field.dataType, T.NumericType):
        return NUMBER
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    return TEXT


def is_derived(field: T.StructField) -> bool:
    return bool((field.metadata or {}).get("derived"))


def data_fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name not in SYSTEM_COLUMNS]


def base_columns(df: DataFrame) -> list[str]:
    """The source's own columns: no keys, no derived columns."""
    return [f.name for f in data_fields(df) if not is_derived(f)]


def logical_types(df: DataFrame) -> dict[str, str]:
    return {f.name: logical_type(f) for f in data_fields(df)}


def datetime_columns(df: DataFrame) -> list[str]:
    return [n for n, t in logical_types(df).items() if t == DATETIME]


def annotate(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Record logical types as column metadata; values are untouched."""
    out = []
    for field in df.schema.fields:
        meta = dict(field.metadata or {})
        if field.name in types:
            meta["logical_type"] = types[field.name]
        out.append(ref(field.name).alias(field.name, metadata=meta))
    return df.select(*out)


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def is_timestamp(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def as_text(df: DataFrame, name: str) -> Column:
    """The text form of a column; nested values become JSON text."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return ref(name)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(ref(name))
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("<"), F.length(ref(name)), F.lit(" bytes>"))
    return ref(name).cast("string")


