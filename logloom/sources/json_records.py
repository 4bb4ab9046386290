"""JSON records as text columns.

Nested objects unfold to dotted names as far as asked; arrays, and objects
below the cut, stay JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ref
from ..operators.ids import file_blocks, file_row_ids
from ..session import case_sensitive, materialise, scratch_path
from .delimited import typed_source
from .json_array import BLANK, array_items, split_arrays
from .schema import clean_names

CORRUPT = "_corrupt_record"
LINE_EXTENSIONS = (".jsonl", ".ndjson")


def _depth(flatten: str, depth: int) -> int | None:
    if flatten == "none":
        return 0
    if flatten == "full":
        return None
    if flatten == "depth":
        return max(0, int(depth))
    raise ValueError("flatten must be none, full or depth")


def cut_schema(schema: T.StructType, max_depth: int | None, level: int = 0) -> T.StructType:
    """The schema with everything that stays JSON text replaced by string, so
    that the reader hands over the raw text."""
    fields = []
    for f in schema.fields:
        unfold = isinstance(f.dataType, T.StructType) and (max_depth is None or level < max_depth)
        kind = cut_schema(f.dataType, max_depth, level + 1) if unfold and f.dataType.fields else T.StringType()
        fields.append(T.StructField(f.name, kind))
    return T.StructType(fields)


def _leaves(kind: T.StructType, value: Column, prefix: str = "") -> list[tuple[str, Column]]:
    out = []
    for f in kind.fields:
        name, inner = f"{prefix}{f.name}", value.getField(f.name)
        out += _leaves(f.dataType, inner, name + ".") if isinstance(f.dataType, T.StructType) else [(name, inner)]
    return out


def flatten_objects(df: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Struct columns unfolded to dotted names; arrays, maps and structs below
    ``max_depth`` become JSON text; NULL becomes empty, booleans words."""
    out: list[Column] = []

    def walk(kind: T.DataType, value: Column, name: str, level: int) -> None:
        if isinstance(kind, T.StructType) and (max_depth is None or level < max_depth):
            if not kind.fields:
                out.append(F.lit("{}").alias(name))
            for f in kind.fields:
                walk(f.dataType, value.getField(f.name), f"{name}.{f.name}", level + 1)
            return
        nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType))
        text = F.to_json(value, {"ignoreNullFields": "false"}) if nested else value.cast("string")
        out.append(F.coalesce(text, F.lit("")).alias(name))

    for f in df.schema.fields:
        if f.name in ("source_id", "rid"):
            out.append(ref(f.name))
        else:
            walk(f.dataType, ref(f.name), f.name, 0)
    return df.select(*out)


def _lines_or_documents(spark: SparkSession, path: str | list[str], by_line: bool) -> DataFrame:
    """``(text, _file, _block, _seq)``: a line each, or a file each."""
    return spark.read.text(path, wholetext=not by_line).select(
        F.btrim("value", F.lit(BLANK)).alias("text"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ).where(F.col("text") != "").withColumn("_seq", F.monotonically_increasing_id())


def _record_table(spark: SparkSession, paths: list[str], max_depth: int | None) -> tuple[DataFrame, list[str], bool]:
    """``(written records, column names, is "value" a key of its own)``; the
    paths are all of lines, or none is."""
    path, by_line = paths, paths[0].lower().endswith(LINE_EXTENSIONS)
    arrays, others = (None, []) if by_line else split_arrays(spark, paths)
    reader = spark.read.option("primitivesAsString", True).option("columnNameOfCorruptRecord", CORRUPT)
    if arrays is None:
        located = _lines_or_documents(spark, path, by_line)
        inferred = reader.option("multiLine", not by_line).json(path).schema
    else:
        located = array_items(arrays)
        if others:
            located = located.unionByName(_lines_or_documents(spark, path, False).where(F.col("_file").isin(others)))
        # Items are read three times: for the keys, for the cells, and to be counted.
        located = materialise(located, "json-items")
        lines = scratch_path(spark, "json-lines")
        # Line breaks of a JSON text stand between its tokens only.
        located.where(F.startswith("text", F.lit("{"))).select(F.translate("text", "\r\n", "  ")).write.text(lines)
        inferred = reader.json(lines).schema
    objects = T.StructType([f for f in inferred.fields if f.name != CORRUPT])
    schema = cut_schema(objects, max_depth)

    is_object = F.startswith("text", F.lit("{"))
    # A broken record stops the import instead of turning into empty cells.
    read = F.from_json("text", schema, {"mode": "FAILFAST"})
    parsed = located.withColumn("_o", F.when(is_object, read) if schema.fields else F.lit(None))
    leaves = _leaves(schema, F.col("_o")) if schema.fields else []
    # A scalar or array record has a single cell called "value".
    own = dict(leaves).get("value")
    value = F.when(is_object, own if own is not None else F.lit(None)).otherwise(scalar_text(F.col("text")))
    columns = {name: leaf for name, leaf in leaves if name != "value"} | {"value": value}
    names = clean_names(list(columns))
    table = materialise(
        parsed.select(
            "_file", "_block", "_seq", F.lit(False).alias("_ragged"), (~is_object).alias("_plain"),
            *[F.coalesce(c, F.lit("")).alias(n) for n, c in zip(names, columns.values())],
        ),
        "records",
    )
    return table, names, own is not None


def line_shapes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(_file, shape)``: the keys and kinds of values of every file of JSON
    lines, by one scan over all of them."""
    lines = _lines_or_documents(spark, paths, True)
    return lines.groupBy("_file").agg(F.schema_of_variant_agg(F.try_parse_json("text")).alias("shape"))


def read_line_files(spark: SparkSession, paths: list[str], flatten: str = "none", depth: int = 0) -> DataFrame:
    """Files of JSON lines that have the same keys, read by one scan: ``_file``,
    ``rid`` dense in each file, and the cells."""
    with case_sensitive(spark):
        table, names, own = _record_table(spark, paths, _depth(flatten, depth))
    if not own and table.where("_plain").isEmpty():
        names.pop()
    if not names or table.isEmpty():
        raise ValueError("The files hold no records")
    return file_row_ids(table, file_blocks(table)).select("_file", "rid", *[ref(n) for n in names])


def read_json_records(
    spark: SparkSession, path: str, flatten: str = "none", depth: int = 0, source_id: int = 1,
    column_types: dict[str, str] | None = None,
) -> DataFrame:
    """One source from ``.jsonl``/``.ndjson`` lines or a ``.json`` document
    (array, object or scalar).  Columns are the union of all keys; values that
    are no objects land in ``value``.

    An array is read by many tasks (see ``json_array``); a document that is no
    array is one record and so one task."""
    with case_sensitive(spark):
        table, names, own = _record_table(spark, [path], _depth(flatten, depth))
    # Only the flag column is read to see whether any record was no object.
    if not own and table.where("_plain").isEmpty():
        names.pop()
    if not names or table.isEmpty():
        raise ValueError(f"{path} holds no records")
    blocks = file_blocks(table, per_file=False)
    numbered = file_row_ids(table, blocks).select("rid", *[ref(n) for n in names])
    return typed_source(numbered, source_id, numbered, column_types)


def scalar_text(text: Column) -> Column:
    """A bare JSON value as cell text: strings unquoted, null empty."""
    quoted = F.startswith(text, F.lit('"'))
    return F.when(quoted, F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(0))).when(
        text == "null", F.lit("")
    ).otherwise(text)

