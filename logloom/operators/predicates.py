"""Filter vocabulary: one condition, condition trees, raw expressions, time range.

A condition compiles to a boolean Column, or to None ("no predicate") for an
unknown column, an unknown op or an empty value.
"""

from __future__ import annotations

import re
from datetime import date, datetime
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    NUMBER, as_text, data_fields, datetime_columns, is_timestamp, logical_types, ref,
)
from ..functions.scalars import number_of, ts_normalize, ts_normalize_text
from ..session import broadcast_if_small, materialise

COMPARISONS = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


def contains_text(haystack: Column, needle: str) -> Column:
    """Case-insensitive literal substring test."""
    return F.contains(F.lower(haystack), F.lower(F.lit(needle)))


def java_pattern(pattern: str) -> str | None:
    """The case-insensitive Java form of a regular expression, or None when
    Java cannot compile it (such a pattern matches nothing)."""
    text = "(?i)" + pattern.replace("(?P<", "(?<")
    try:
        SparkSession.active().range(1).select(F.lit("").rlike(text)).head()
    except Exception:
        return None
    return text


def matches_regex(haystack: Column, pattern: str) -> Column:
    text = java_pattern(pattern)
    return F.lit(False) if text is None else F.coalesce(haystack.rlike(text), F.lit(False))


def _moment(value: str) -> datetime | None:
    try:
        return datetime.fromisoformat(str(value).strip())
    except ValueError:
        return None


def _literal(df: DataFrame, column: str, value) -> Column | None:
    """``value`` in the column's own type, so equality reaches the scan; None
    when it has no such value."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.lit(str(value))
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        number = exact_number(value)
        if number is None or not fits(number, kind):
            return None
        return _whole(number, kind) if isinstance(kind, T.IntegralType) else F.lit(number).cast(kind)
    if isinstance(kind, T.NumericType):
        try:
            return F.lit(float(value)).cast(kind)
        except (TypeError, ValueError):
            return None
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        moment = value if isinstance(value, datetime) else _moment(value)
        return None if moment is None else F.lit(moment.isoformat(" ")).cast(kind)
    return F.lit(value)


def exact_number(value) -> Decimal | None:
    """A number without a detour through doubles; None for anything else."""
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation:
        return None
    return number if number.is_finite() else None


RANGES = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}


def fits(number: Decimal, kind: T.DataType) -> bool:
    """Can a column of this exact type hold the number?"""
    if isinstance(kind, T.DecimalType):
        return number == number.quantize(Decimal(1).scaleb(-kind.scale)) if abs(number) < Decimal(10) ** (kind.precision - kind.scale) else False
    reach = 1 << RANGES[kind.simpleString()]
    return number == number.to_integral_value() and -reach <= number < reach


def _whole(number: Decimal, kind: T.DataType) -> Column:
    return F.lit(int(number)).cast(kind)


def compare_exactly(column: Column, kind: T.DataType, op: str, number: Decimal) -> Column:
    """An ordered comparison of a whole-number column in its own type, so that
    it is exact and reaches the scan.  A bound between two whole numbers moves
    to the nearer one; a bound beyond the type is true or false for all."""
    reach = 1 << RANGES[kind.simpleString()]
    up, strict = op.startswith(">"), len(op) == 1
    bound = number.to_integral_value(rounding="ROUND_CEILING" if up else "ROUND_FLOOR")
    strict = strict and bound == number
    if bound >= reach or bound < -reach:
        return column.isNotNull() & F.lit((bound < 0) == up)
    return COMPARISONS[op[0] + ("" if strict else "=")](column, _whole(bound, kind))


def _as_list(value) -> list[str]:
    items = value if isinstance(value, (list, tuple, set)) else str(value).split("\n")
    return [v for v in items if str(v) != ""]


def condition(df: DataFrame, column: str, op: str, value="") -> Column | None:
    types = logical_types(df)
    if column not in types:
        return None
    if op == "empty":
        return F.coalesce(as_text(df, column), F.lit("")) == ""
    if op == "not_empty":
        return F.coalesce(as_text(df, column), F.lit("")) != ""
    if op == "in":
        wanted = [lit for lit in (_literal(df, column, v) for v in _as_list(value)) if lit is not None]
        if not _as_list(value):
            return None
        return ref(column).isin(wanted) if wanted else F.lit(False)
    if value is None or value == "":
        return None
    text = as_text(df, column)
    if op == "contains":
        return contains_text(text, str(value))
    if op == "not_contains":
        return ~contains_text(text, str(value)) | ref(column).isNull()
    if op == "equals":
        wanted = _literal(df, column, value)
        return F.lit(False) if wanted is None else ref(column) == wanted
    if op == "not_equals":
        wanted = _literal(df, column, value)
        return F.lit(True) if wanted is None else (ref(column) != wanted) | ref(column).isNull()
    if op == "starts":
        return F.startswith(F.lower(text), F.lower(F.lit(str(value))))
    if op == "regex":
        return matches_regex(text, str(value))
    if op in COMPARISONS:
        kind = df.schema[column].dataType
        if types[column] == NUMBER and isinstance(kind, T.IntegralType) and (number := exact_number(value)) is not None:
            return compare_exactly(ref(column), kind, op, number)
        if types[column] == NUMBER and isinstance(kind, T.DecimalType) and (number := exact_number(value)) is not None:
            return COMPARISONS[op](ref(column), F.lit(number))
        if types[column] == NUMBER and isinstance(kind, T.DoubleType):
            return COMPARISONS[op](ref(column), F.lit(float(value)))
        if types[column] == NUMBER:
            return COMPARISONS[op](number_of(df, column), F.lit(float(value)))
        wanted = _literal(df, column, value)
        if wanted is None:
            return COMPARISONS[op](text, F.lit(str(value)))
        return COMPARISONS[op](ref(column), wanted)
    return None


IN_LIST = 1_000  # values named in the plan; more become a table


def _typed_value(kind: T.DataType, value):
    """``value`` as a Python value of a column's type, None when it has none."""
    if isinstance(kind, T.StringType):
        return str(value)
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        number = exact_number(value)
        if number is None or not fits(number, kind):
            return None
        return int(number) if isinstance(kind, T.IntegralType) else number
    if isinstance(kind, T.FractionalType):
        try:
            return float(value)
        except (TypeError, ValueError):
            return None
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        moment = value if isinstance(value, datetime) else _moment(value)
        return moment.date() if moment is not None and isinstance(kind, T.DateType) else moment
    return value


def where_in(df: DataFrame, column: str, values) -> DataFrame:
    """The rows whose cell equals one of a long list, or of a one-column table,
    of values.

    The values become a written table of the column's type, so the plan does not
    grow with them: a semi-join that is broadcast only after a count.  Their
    smallest and largest value are filters of the scan itself."""
    kind = df.schema[column].dataType
    spark = df.sparkSession
    if isinstance(values, DataFrame):
        listed = values.select(ref(values.columns[0]).try_cast(kind).alias("_in"))
    else:
        typed = {v for v in (_typed_value(kind, v) for v in _as_list(values)) if v is not None}
        listed = spark.createDataFrame([(v,) for v in typed], T.StructType([T.StructField("_in", kind)]))
    wanted = materialise(listed.where(F.col("_in").isNotNull()).distinct(), "in-list")
    bounds = wanted.agg(F.min("_in").alias("low"), F.max("_in").alias("high")).first()
    if bounds["low"] is None:
        return df.where(F.lit(False))
    # Moments go as text, which no time zone shifts.
    low, high = (F.lit(v.isoformat() if isinstance(v, date) else v).cast(kind) for v in bounds)
    near = ref(column).between(low, high)
    return df.where(near).join(broadcast_if_small(wanted), ref(column) == F.col("_in"), "left_semi")


def long_list(df: DataFrame, item: dict) -> bool:
    """Is this filter of a spec a list that ``where_in`` should look up?"""
    return item.get("op") == "in" and item.get("column") in logical_types(df) and len(_as_list(item.get("value", ""))) > IN_LIST


def where_op(df: DataFrame, column: str, op: str, value="") -> DataFrame:
    if long_list(df, {"column": column, "op": op, "value": value}):
        return where_in(df, column, value)
    test = condition(df, column, op, value)
    return df if test is None else df.where(test)


# Words that could open a subquery inside an expression, and functions that
# would call into the engine's own classes.
SUBQUERY_WORDS = r"\b(select|table|values|with|from)\b"
ENGINE_CALLS = r"\b(try_reflect|reflect|java_method)`?\s*\("


def _structure(text: str) -> str:
    """The expression with quoted text blanked out."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`", "''", text)


def refuse_engine_calls(text: str) -> None:
    """A name counts with or without backticks; quoted text does not count."""
    unquoted = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|/\*.*?\*/|--[^\n]*", " ", text, flags=re.DOTALL)
    if re.search(ENGINE_CALLS, unquoted, re.IGNORECASE):
        raise ValueError("Calls into Java classes are refused")


def raw_condition(df: DataFrame, text: str) -> Column:
    """A boolean SQL expression over this frame's own columns, no subqueries."""
    text = (text or "").strip()
    if not text:
        raise ValueError("The expression is blank")
    structure = _structure(text)
    if ";" in structure or "--" in structure or "/*" in structure:
        raise ValueError("An expression holds no comments and no second statement")
    if re.search(SUBQUERY_WORDS, structure, re.IGNORECASE):
        raise ValueError("An expression reads its own row only; subqueries are refused")
    refuse_engine_calls(text)
    try:
        df.where(F.expr(text))
        return F.expr(text)
    except (AnalysisException, ParseException) as e:
        raise ValueError(f"Spark cannot evaluate {text!r}: {e}") from e


def where_expr(df: DataFrame, text: str) -> DataFrame:
    return df.where(raw_condition(df, text))


def tree_condition(df: DataFrame, node: dict | None) -> Column | None:
    """Nested AND/OR groups of conditions and raw expressions."""
    if not node:
        return None
    kind = node.get("type")
    if kind == "group":
        parts = [c for c in (tree_condition(df, child) for child in node.get("children", [])) if c is not None]
        if not parts:
            return None
        return reduce((lambda a, b: a | b) if node.get("op") == "OR" else (lambda a, b: a & b), parts)
    if kind == "cond":
        return condition(df, node.get("column"), node.get("op"), node.get("value", ""))
    if kind == "raw":
        return raw_condition(df, node.get("sql", ""))
    return None


def filter_tree(df: DataFrame, node: dict | None) -> DataFrame:
    test = tree_condition(df, node)
    return df if test is None else df.where(test)


def normalise_bound(value: str | datetime | None) -> str | None:
    """A range bound as ``YYYY-MM-DD HH:MM:SS``, read by the column rules."""
    if value is None or value == "":
        return None
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    one = SparkSession.active().range(1)
    return one.select(ts_normalize_text(F.lit(str(value))).alias("t")).head()["t"]


def _in_range(df: DataFrame, column: str, low: str | None, high: str | None) -> Column:
    if is_timestamp(df, column):
        # Values count by their second, so the upper bound reaches to its end.
        kind = df.schema[column].dataType
        tests = []
        if low is not None:
            tests.append(ref(column) >= F.lit(low).cast(kind))
        if high is not None:
            tests.append(ref(column) < F.expr(f"cast('{high}' as timestamp_ntz) + interval 1 second").cast(kind))
        return reduce(lambda a, b: a & b, tests)
    value = ts_normalize(df, column)
    if low is not None and high is not None:
        # The SQL function computes its input once; two comparisons would not.
        return F.call_function("between", value, F.lit(low), F.lit(high))
    return value >= low if low is not None else value <= high


def time_range_condition(df: DataFrame, start=None, end=None, column: str | None = None) -> Column | None:
    low, high = normalise_bound(start), normalise_bound(end)
    if low is None and high is None:
        return None
    every = datetime_columns(df)
    chosen = [column] if column in every else every
    if not chosen:
        return None
    return reduce(lambda a, b: a | b, [_in_range(df, c, low, high) for c in chosen])


def time_range(df: DataFrame, start=None, end=None, column: str | None = None) -> DataFrame:
    """Rows with any (or the named) datetime column inside the inclusive range."""
    test = time_range_condition(df, start, end, column)
    return df if test is None else df.where(test)


def unparsed_rows(df: DataFrame, derived: str, source: str) -> DataFrame:
    """Rows whose input holds something that gave no derived value."""
    return df.where(ref(derived).isNull() & (F.coalesce(as_text(df, source), F.lit("")) != ""))


def keys_in(rows: list) -> Column:
    """A condition on the row keys that the scan itself understands; for a
    list of rows whose size the caller has bounded."""
    by_source: dict[int, list[int]] = {}
    for row in rows:
        by_source.setdefault(row["source_id"], []).append(row["rid"])
    tests = [(F.col("source_id") == s) & F.col("rid").isin(sorted(set(rids))) for s, rids in by_source.items()]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def exclude_rows(df: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """All rows but an explicit list; the list comes from the caller, so its
    size is known before the broadcast."""
    if not pairs:
        return df
    listed = df.sparkSession.createDataFrame(
        [(int(s), int(r)) for s, r in pairs], "source_id int, rid bigint"
    ).dropDuplicates()
    side = F.broadcast(listed) if len(pairs) <= 200_000 else listed
    return df.join(side, ["source_id", "rid"], "left_anti")


def project(df: DataFrame, base_only: bool = False) -> DataFrame:
    """Keys and data columns; base columns first, then derived ones."""
    keys = [f.name for f in df.schema.fields if f.name in ("source_id", "rid", "pos")]
    base = [f.name for f in data_fields(df) if not (f.metadata or {}).get("derived")]
    derived = [] if base_only else [f.name for f in data_fields(df) if (f.metadata or {}).get("derived")]
    return df.select(*[ref(n) for n in keys + base + derived])
