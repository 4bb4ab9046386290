"""Derived-column operations: id, parameter schema and column builder.

``register_op`` is the extension point: a builder takes the input column and
the checked parameters and returns a Column (a pandas UDF works as well).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import documents, moments


def _whole_number(param: Param, value: Any) -> int:
    try:
        number = int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{param.name}: {value!r} is no integer") from None
    low, high = (number if end is None else end for end in (param.low, param.high))
    if not low <= number <= high:
        raise ValueError(f"{param.name}: {number} is outside {param.low}..{param.high}")
    return number


def _one_of(param: Param, value: Any) -> str:
    if str(value).strip() not in param.options:
        raise ValueError(f"{param.name}: {value!r} is none of {list(param.options)}")
    return str(value).strip()


def _utc_offset(param: Param, value: Any) -> str:
    moments.offset_seconds(value)
    return str(value).strip()


READERS = {"int": _whole_number, "select": _one_of, "offset": _utc_offset}


@dataclass(frozen=True)
class Param:
    name: str
    kind: str = "text"  # text, int, select, offset, column
    required: bool = False
    default: Any = None
    options: tuple[str, ...] = ()
    low: int | None = None
    high: int | None = None

    def read(self, value: Any) -> Any:
        """A given value in the parameter's type; ValueError if it has none."""
        reader = READERS.get(self.kind)
        return reader(self, value) if reader else str(value).strip()


@dataclass(frozen=True)
class Op:
    id: str
    label: str
    build: Callable[..., Column]
    params: tuple[Param, ...] = ()
    family: str = "datetime"  # or "extract"
    kind: str = "datetime"  # logical type of the result
    two_input: bool = False
    ordered: bool = False  # needs row order (see operators.derived)
    hidden: bool = False  # left out of format detection
    check: Callable[[dict], None] | None = field(default=None)


OPERATIONS: dict[str, Op] = {}


def register_op(op: Op) -> Op:
    """Registration order breaks ties in format detection."""
    OPERATIONS[op.id] = op
    return op


def get_op(op_id: str) -> Op:
    if op_id not in OPERATIONS:
        raise ValueError(f"There is no operation {op_id!r}")
    return OPERATIONS[op_id]


def validate_params(op_id: str, params: dict | None) -> dict:
    """Known parameters only, coerced; ValueError on a bad or missing one.

    A blank value counts as not given."""
    op = get_op(op_id)
    given = {name: value for name, value in (params or {}).items() if value is not None and str(value).strip()}
    missing = [p.name for p in op.params if p.required and p.name not in given]
    if missing:
        raise ValueError(f"{op.id} cannot run without {', '.join(map(repr, missing))}")
    read = defaults(op) | {p.name: p.read(given[p.name]) for p in op.params if p.name in given}
    if op.check:
        op.check(read)
    return read


def defaults(op: Op) -> dict:
    return {p.name: p.default for p in op.params if p.default is not None}


def detection_params(op: Op) -> dict:
    """Parameters to try an operation with before anyone has chosen any; what
    depends on the row order is tried in this year."""
    this_year = {"base_year": datetime.now(timezone.utc).year}
    return defaults(op) | (this_year if op.ordered else {})


OFFSET = Param("utc_offset", "offset")


def _with_offset(fn):
    return lambda c, utc_offset=None: fn(c, utc_offset)


def _syslog_probe(c: Column, base_year: int, utc_offset: str | None = None) -> Column:
    """Syslog text read in one year; the rollover is a frame operation."""
    return moments.syslog_in_year(c, F.lit(int(base_year)), utc_offset)


register_op(Op("unix_epoch", "Unix epoch", moments.unix_epoch,
               (Param("unit", "select", default="auto", options=("auto", "s", "ms", "us", "ns")),)))
register_op(Op("windows_filetime", "Windows FILETIME", moments.windows_filetime))
register_op(Op("webkit_epoch", "WebKit/Chrome epoch", moments.webkit_epoch))
register_op(Op("syslog_bsd", "BSD syslog (Mmm dd hh:mm:ss)", _syslog_probe,
               (Param("base_year", "int", required=True, low=1970, high=2100), OFFSET), ordered=True))
register_op(Op("iso8601", "ISO 8601", _with_offset(moments.iso8601), (OFFSET,)))
register_op(Op("dd_mmm_yyyy", "dd Mmm yyyy hh:mm:ss", _with_offset(moments.dd_mmm_yyyy), (OFFSET,)))
register_op(Op("compact_ymd", "Compact YYYYMMDDhhmmss", _with_offset(moments.compact_ymd), (OFFSET,)))
register_op(Op("mac_absolute", "Mac absolute (Cocoa) time", moments.mac_absolute))
register_op(Op("excel_serial", "Excel serial date", _with_offset(moments.excel_serial), (OFFSET,)))
register_op(Op("dotnet_ticks", ".NET ticks", moments.dotnet_ticks))
register_op(Op("apache_clf", "Apache access log", _with_offset(moments.apache_clf), (OFFSET,)))
register_op(Op("rfc2822", "RFC 2822 (email date)", _with_offset(moments.rfc2822), (OFFSET,)))
register_op(Op("us_datetime", "US MM/DD/YYYY hh:mm:ss", _with_offset(moments.us_datetime), (OFFSET,)))
register_op(Op("duration_delta", "Duration between two columns", moments.duration_seconds,
               (Param("other_column", "column", required=True),), kind="duration", two_input=True, hidden=True))
register_op(Op("json_field", "JSON field", documents.json_field, (Param("path", required=True),),
               family="extract", kind="text", hidden=True,
               check=lambda p: documents.parse_json_path(p["path"]) and None))
register_op(Op("xml_field", "XML field", documents.xml_field, (Param("path", required=True),),
               family="extract", kind="text", hidden=True,
               check=lambda p: documents.parse_xml_path(p["path"]) and None))
