"""Derived columns: definitions are data, values are column expressions.

A derived column carries its definition in the column metadata, so a written
frame still knows how each of its columns came to be.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents, moments
from ..functions.columns import KEYS, as_text, base_columns, data_fields, is_derived, ref
from ..functions.registry import get_op, validate_params
from .ids import count_drops
from .predicates import unparsed_rows

RESERVED_NAMES = {"rid", "rank", "rowid", "source_id", "pos", "__tag__"}
MAX_NAME = 200


def definitions(df: DataFrame) -> list[dict]:
    """``{name, input_column, op_id, params}`` of every derived column."""
    return [json.loads(f.metadata["definition"]) for f in df.schema.fields if "definition" in (f.metadata or {})]


def _find(df: DataFrame, name: str):
    return next((f for f in data_fields(df) if f.name.lower() == str(name).lower()), None)


def _checked(df: DataFrame, spec: dict, taken: set[str]) -> dict:
    """One definition with every rule applied; ValueError names the problem."""
    name = (spec.get("name") or "").strip()
    op = get_op(spec.get("op_id"))
    params = validate_params(op.id, spec.get("params"))
    if not name:
        raise ValueError("A derived column needs a name")
    if len(name) > MAX_NAME:
        raise ValueError(f"Column name is longer than {MAX_NAME} characters")
    if name.lower() in RESERVED_NAMES:
        raise ValueError(f"{name!r} is reserved")
    if name.lower() in taken:
        raise ValueError(f"The table has a column {name!r} already")
    inputs = [spec.get("input_column")] + ([params["other_column"]] if op.two_input else [])
    for column in inputs:
        field = _find(df, column)
        if field is None:
            raise ValueError(f"No input column {column!r}")
        if is_derived(field) and not op.two_input:
            raise ValueError(f"{column!r} is derived; read the original column")
    taken.add(name.lower())
    return {"name": name, "input_column": _find(df, spec["input_column"]).name, "op_id": op.id, "params": params}


# What the fields of one document column have in common, and a field of that.
SHARED = {
    "json_field": (documents.as_variant, documents.variant_field),
    "xml_field": (documents.wrapped_xml, documents.wrapped_field),
}


def _parsed_once(df: DataFrame, checked: list[dict]) -> tuple[DataFrame, dict[tuple[str, str], str]]:
    """``df`` with a parsed column (JSON) or a checked one (XML) for every
    document column that gives more than one field, and the names of those
    columns by operation and input."""
    inputs = [(d["op_id"], d["input_column"]) for d in checked if d["op_id"] in SHARED]
    shared = {key: f"_document_{i}" for i, key in enumerate(sorted(set(inputs))) if inputs.count(key) > 1}
    parsed = {alias: SHARED[op][0](as_text(df, name)) for (op, name), alias in shared.items()}
    if not parsed:
        return df, shared
    # An array's only item, so that the fields do not repeat the parse.
    held = df.select("*", F.explode(F.array(F.struct(*[c.alias(a) for a, c in parsed.items()]))).alias("_documents"))
    return held.select("*", "_documents.*").drop("_documents"), shared


def _value(df: DataFrame, definition: dict, shared: dict[tuple[str, str], str] | None = None) -> Column:
    key = definition["op_id"], definition["input_column"]
    if key in (shared or {}):
        return SHARED[key[0]][1](F.col(shared[key]), definition["params"]["path"])
    op, params = get_op(definition["op_id"]), dict(definition["params"])
    text = as_text(df, definition["input_column"])
    if op.two_input:
        return op.build(text, as_text(df, _find(df, params.pop("other_column")).name), **params)
    return op.build(text, **params)


def _metadata(definition: dict) -> dict:
    kind = get_op(definition["op_id"]).kind
    logical = {"duration": "number"}.get(kind, kind)
    return {"logical_type": logical, "derived": True, "derived_kind": kind, "definition": json.dumps(definition)}


def rollover_year(df: DataFrame, column: str, base_year: int, name: str = "year") -> DataFrame:
    """The year of each BSD syslog line: one more whenever the month falls
    below that of the line before, in rid order per source."""
    marked = df.withColumn("_month", moments.syslog_month(as_text(df, column)))
    counted = count_drops(marked, "_month", "_drops")
    year = F.when(F.col("_month").isNotNull(), F.lit(int(base_year)) + F.col("_drops")).cast("int")
    return counted.withColumn(name, year).drop("_month", "_drops")


def _with_ordered(df: DataFrame, definition: dict) -> DataFrame:
    params = definition["params"]
    dated = rollover_year(df, definition["input_column"], params["base_year"], "_year")
    text = as_text(df, definition["input_column"])
    value = moments.syslog_in_year(text, F.col("_year"), params.get("utc_offset"))
    return dated.select(
        *[ref(c) for c in df.columns], value.alias(definition["name"], metadata=_metadata(definition))
    )


def add_derived_columns(df: DataFrame, specs: list[dict]) -> DataFrame:
    """Several derived columns in one projection, all or nothing."""
    if not specs:
        raise ValueError("No definitions given")
    taken = {f.name.lower() for f in data_fields(df)}
    checked = [_checked(df, spec, taken) for spec in specs]
    plain = [d for d in checked if not get_op(d["op_id"]).ordered]
    out = df
    if plain:
        out, shared = _parsed_once(out, plain)
        out = out.select(
            *[ref(c) for c in df.columns],
            *[_value(df, d, shared).alias(d["name"], metadata=_metadata(d)) for d in plain],
        )
    for definition in checked:
        if get_op(definition["op_id"]).ordered:
            out = _with_ordered(out, definition)
    return out


def add_derived(df: DataFrame, name: str, input_column: str, op_id: str, params: dict | None = None) -> DataFrame:
    return add_derived_columns(
        df, [{"name": name, "input_column": input_column, "op_id": op_id, "params": params}]
    )


def flatten_column(df: DataFrame, column: str, fields: dict[str, str], kind: str = "json") -> DataFrame:
    """Several fields of one document column: ``{new name: path}``."""
    return add_derived_columns(df, [
        {"name": name, "input_column": column, "op_id": f"{kind}_field", "params": {"path": path}}
        for name, path in fields.items()
    ])


def rederive(df: DataFrame, name: str, params: dict) -> DataFrame:
    """Compute one derived column again with other parameters, in place."""
    old = next((d for d in definitions(df) if d["name"].lower() == name.lower()), None)
    if old is None:
        raise KeyError(name)
    order = df.columns
    again = add_derived(df.drop(old["name"]), old["name"], old["input_column"], old["op_id"], params)
    return again.select(*[ref(c) for c in order])


def remove_derived(df: DataFrame, name: str) -> DataFrame:
    """Drop a derived column nothing else is computed from."""
    for other in definitions(df):
        used = {other["input_column"].lower(), str(other["params"].get("other_column", "")).lower()}
        if other["name"].lower() != name.lower() and name.lower() in used:
            raise ValueError(f"{other['name']!r} is computed from this column")
    return df.drop(name)


def replay_definitions(df: DataFrame, recorded: list[dict]) -> tuple[DataFrame, list[str]]:
    """Recreate derived columns of a session; one that cannot be made is a
    warning, never a failure."""
    warnings = []
    for definition in recorded:
        try:
            df = add_derived(
                df, definition["name"], definition["input_column"], definition["op_id"], definition.get("params")
            )
        except (ValueError, KeyError) as e:
            warnings.append(f"{definition.get('name')!r} was not recreated: {e}")
    return df, warnings


def attach_derived(df: DataFrame, values: DataFrame) -> DataFrame:
    """A source with separately stored derived values, at most one row each."""
    return df.join(values, KEYS, "left")


def stored_values(df: DataFrame) -> DataFrame:
    """Only the keys and the derived columns, for storing on their own."""
    return df.select(*KEYS, *[ref(f.name) for f in data_fields(df) if is_derived(f)])


def parse_failures(df: DataFrame, derived: str, source: str) -> DataFrame:
    """One row ``(failures)``: inputs that hold something but gave nothing."""
    return unparsed_rows(df, derived, source).agg(F.count(F.lit(1)).alias("failures"))


def preview_derived(
    df: DataFrame, column: str, op_id: str, params: dict | None = None, limit: int = 10
) -> DataFrame:
    """A few ``(rid, input, output)`` rows of what a definition would give."""
    op = get_op(op_id)
    checked = validate_params(op_id, params)
    if _find(df, column) is None:
        raise KeyError(column)
    definition = {"name": "output", "input_column": column, "op_id": op_id, "params": checked}
    text = as_text(df, column)
    rows = df if op.two_input else df.where(F.coalesce(text, F.lit("")) != "")
    few = rows.orderBy(*KEYS).limit(limit)
    shown = _with_ordered(few, definition) if op.ordered else few.withColumn("output", _value(few, definition))
    return shown.select("rid", text.alias("input"), "output")


def base_frame(df: DataFrame) -> DataFrame:
    """A source without its derived columns."""
    return df.select(*KEYS, *[ref(c) for c in base_columns(df)])
