"""SQL functions usable in ad-hoc queries; each is a SQL expression that the
optimizer inlines, so no Python runs per row."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .scalars import ISO_DATE, ISO_MINUTE, ISO_SECOND, US_DATE, US_TIME


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


_S = "btrim(x, ' \\t\\n\\r')"


def _us_hour() -> str:
    raw = f"coalesce(try_cast(regexp_extract({_S}, {_quoted(US_TIME)}, 1) AS INT), 0)"
    half = f"lower(regexp_extract({_S}, {_quoted(US_TIME)}, 4))"
    return f"CASE WHEN {half} = 'pm' AND {raw} < 12 THEN {raw} + 12 WHEN {half} = 'am' AND {raw} = 12 THEN 0 ELSE {raw} END"


def _us_date() -> str:
    part = lambda i: f"regexp_extract({_S}, {_quoted(US_DATE)}, {i})"
    return f"concat({part(3)}, '-', lpad({part(1)}, 2, '0'), '-', lpad({part(2)}, 2, '0'))"


def register_functions(spark: SparkSession) -> None:
    """``regexp_match(p, x)``, ``day_bucket(x)``, ``ts_normalize(x)``, ``numeric_or_null(x)``."""
    us_time = (
        f"concat(lpad({_us_hour()}, 2, '0'), ':', "
        f"lpad(regexp_extract({_S}, {_quoted(US_TIME)}, 2), 2, '0'), ':', "
        f"lpad(regexp_extract({_S}, {_quoted(US_TIME)}, 3), 2, '0'))"
    )
    definitions = {
        "regexp_match(p STRING, x STRING) RETURNS BOOLEAN": "coalesce(x RLIKE concat('(?i)', p), false)",
        "numeric_or_null(x STRING) RETURNS DOUBLE":
            r"CASE WHEN x RLIKE r'^-?\d+(\.\d+)?$' THEN try_cast(x AS DOUBLE) END",
        "day_bucket(x STRING) RETURNS STRING":
            f"CASE WHEN {_S} RLIKE {_quoted(ISO_DATE)} THEN substring({_S}, 1, 10) "
            f"WHEN {_S} RLIKE {_quoted(US_DATE)} THEN {_us_date()} END",
        "ts_normalize(x STRING) RETURNS STRING":
            f"CASE WHEN {_S} RLIKE {_quoted(ISO_SECOND)} THEN concat(substring({_S}, 1, 10), ' ', substring({_S}, 12, 8)) "
            f"WHEN {_S} RLIKE {_quoted(ISO_MINUTE)} THEN concat(substring({_S}, 1, 10), ' ', substring({_S}, 12, 5), ':00') "
            f"WHEN {_S} RLIKE {_quoted(ISO_DATE)} THEN concat(substring({_S}, 1, 10), ' 00:00:00') "
            f"WHEN {_S} RLIKE {_quoted(US_DATE)} THEN concat({_us_date()}, ' ', {us_time}) END",
    }
    for signature, body in definitions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
