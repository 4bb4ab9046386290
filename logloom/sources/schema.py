"""Column names and row shapes shared by all readers."""

from __future__ import annotations

from itertools import chain, count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ref

# Names a source may not use for its own columns.
RESERVED_NAMES = {"rid", "rank", "rowid", "__tag__"}
OWN_KEYS = {"source_id", "pos"}


def _candidates(name: str | None, place: int):
    """The names a column may get, in order of preference."""
    wanted = (name or "").strip().lstrip("\ufeff") or f"col_{place}"
    if wanted.lower() in RESERVED_NAMES | OWN_KEYS:
        wanted += "_1"
    return chain([wanted], (f"{wanted}_{n}" for n in count(1)))


def clean_names(raw: list[str | None]) -> list[str]:
    """Unique, non-blank, non-reserved names; comparison ignores case."""
    chosen: dict[str, str] = {}
    for place, name in enumerate(raw, start=1):
        free = next(c for c in _candidates(name, place) if c.lower() not in chosen)
        chosen[free.lower()] = free
    return list(chosen.values())


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def normalise_rows(df: DataFrame, cells: str, columns: list[str]) -> DataFrame:
    """An array column of cells as one text column each: short rows padded,
    long rows cut, NULL as empty; ``_ragged`` marks rows of another width."""
    names = clean_names(columns)
    texts = F.transform(ref(cells), lambda c: F.coalesce(c.cast("string"), F.lit("")))
    kept = [ref(c) for c in df.columns if c != cells]
    wide = df.select(*kept, texts.alias("_cells"), (F.size(ref(cells)) != len(names)).alias("_ragged"))
    values = [F.coalesce(F.get("_cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    return wide.select(*kept, *values, "_ragged")


def ragged_count(df: DataFrame, flag: str = "_ragged") -> int:
    return df.where(ref(flag)).count()


def source_fingerprint(df: DataFrame) -> DataFrame:
    """One row ``(row_count, content_xor, content_sum)``: the identity of a
    source by content; row order and partitioning do not matter."""
    names = [f.name for f in df.schema.fields if f.name not in ("source_id", "rid", "pos")]
    # Variants cannot be hashed; every other type can.
    hashed = F.xxhash64(*[
        F.to_json(ref(n)) if isinstance(df.schema[n].dataType, T.VariantType) else ref(n) for n in names
    ])
    return df.select(hashed.alias("h")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor("h").alias("content_xor"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("content_sum"),
    )


def fingerprint_text(df: DataFrame) -> str:
    row = source_fingerprint(df).head()
    return f"{row['row_count']}:{row['content_xor']}:{row['content_sum']}"
