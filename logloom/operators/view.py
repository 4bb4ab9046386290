"""Views: filter, sort, number, page.

A spec is a dict with any of ``filters``, ``filter_tree``, ``search``,
``search_mode``, ``search_terms``, ``tags``, ``time_range`` and ``sort``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KEYS, NUMBER, datetime_columns, is_string, logical_types, ref
from ..functions.scalars import number_of, ts_normalize
from . import annotations, search
from .ids import OrderedRows, number_sorted
from .grouping import top_with_flag
from .predicates import condition, keys_in, long_list, normalise_bound, time_range_condition, tree_condition, where_in

PUSHED_KEYS = 10_000  # a larger page joins its keys instead of naming them


def spec_condition(df: DataFrame, spec: dict) -> Column | None:
    """The row-local part of a spec, as one AND; lists of values that are long
    enough to be joined are left to ``apply_spec``."""
    parts = [
        condition(df, f.get("column"), f.get("op", "contains"), f.get("value", ""))
        for f in spec.get("filters") or [] if not long_list(df, f)
    ]
    parts.append(tree_condition(df, spec.get("filter_tree")))
    mode, query = spec.get("search_mode", "contains"), (spec.get("search") or "").strip()
    if mode == "advanced":
        parts.append(search.terms_condition(df, spec.get("search_terms") or []))
    elif query:
        parts.append(search.regex_condition(df, query) if mode == "regex" else search.contains_condition(df, query))
    window = spec.get("time_range") or {}
    if window.get("enabled", True):
        parts.append(time_range_condition(df, window.get("start"), window.get("end"), window.get("column")))
    parts = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, parts) if parts else None


def apply_spec(df: DataFrame, spec: dict, tags: DataFrame | None = None) -> DataFrame:
    """The rows a spec selects; row-local tests run before the semi-joins with
    long lists of values and with the tags."""
    test = spec_condition(df, spec)
    out = df if test is None else df.where(test)
    for f in spec.get("filters") or []:
        if long_list(df, f):
            out = where_in(out, f["column"], f["value"])
    if spec.get("tags"):
        if tags is None:
            raise ValueError("A spec that filters by tag needs the tags table")
        out = annotations.filter_tagged(out, tags, spec["tags"])
    return out


def sort_keys(df: DataFrame, sort: list[dict] | None) -> list[tuple[Column, bool]]:
    """``(key, descending)`` per known column: numbers by value, text without case."""
    types = logical_types(df)
    keys = []
    for item in sort or []:
        name = item.get("column")
        if name not in types:
            continue
        if types[name] == NUMBER:
            key = number_of(df, name)
        else:
            key = F.lower(ref(name)) if is_string(df, name) else ref(name)
        keys.append((key, str(item.get("dir", "asc")).lower() == "desc"))
    return keys


TIE_BREAK = ["rid", "source_id"]


def sort_columns(df: DataFrame, sort: list[dict] | None) -> list[Column]:
    """A fully determined order: the sort keys, then rid and source."""
    keys = [key.desc() if down else key.asc() for key, down in sort_keys(df, sort)]
    return keys + [F.col(c).asc() for c in TIE_BREAK]


def sort_rows(df: DataFrame, sort: list[dict] | None) -> DataFrame:
    return df.orderBy(*sort_columns(df, sort))


def build_view(df: DataFrame, spec: dict, tags: DataFrame | None = None) -> OrderedRows:
    """Filter, sort and number; only sort keys and row keys are shuffled, and
    only ``(pos, source_id, rid)`` is written."""
    keys = sort_keys(df, spec.get("sort"))
    names = [f"_k{i}" for i in range(len(keys))]
    slim = apply_spec(df, spec, tags).select(*KEYS, *[k.alias(n) for n, (k, _) in zip(names, keys)])
    order = [F.col(n).desc() if down else F.col(n).asc() for n, (_, down) in zip(names, keys)]
    return number_sorted(slim.orderBy(*order, *TIE_BREAK).select(*KEYS), "view")


def page(
    view: OrderedRows, source: DataFrame, start: int, count: int,
    tags: DataFrame | None = None, notes: DataFrame | None = None,
) -> DataFrame:
    """Rows ``start .. start+count-1`` of a view with cells, tags and note.

    The keys of an ordinary page go into the filters of the source, the tags and
    the notes, so their scans skip what holds none of them."""
    keys = view.window(start, count)
    if count > PUSHED_KEYS:
        rows = source.join(keys, KEYS)
        return (rows if tags is None else annotations.attach_annotations(rows, tags, notes)).orderBy("pos")
    held = keys.collect()
    wanted = keys_in(held)
    listed = source.sparkSession.createDataFrame(
        [(r["source_id"], r["rid"], r["pos"]) for r in held], "source_id int, rid bigint, pos bigint"
    )
    rows = source.where(wanted).join(F.broadcast(listed), KEYS)
    if tags is not None:
        rows = annotations.attach_annotations(rows, tags.where(wanted), None if notes is None else notes.where(wanted))
    return rows.orderBy("pos")


def page_unsorted(
    source: DataFrame, source_id: int, start: int, count: int,
    tags: DataFrame | None = None, notes: DataFrame | None = None,
) -> DataFrame:
    """A page of an unfiltered, unsorted source: positions are rids, so the
    window is a rid range that the scan can skip to."""
    wanted = (F.col("source_id") == source_id) & F.col("rid").between(start, start + count - 1)
    rows = source.where(wanted).withColumn("pos", F.col("rid"))
    if tags is not None:
        rows = annotations.attach_annotations(rows, tags.where(wanted), None if notes is None else notes.where(wanted))
    return rows.orderBy("pos")


def find_position(view: OrderedRows, source_id: int, rid: int) -> DataFrame:
    """The position of one row in a view; no row when it is not in there."""
    return view.frame.where((F.col("source_id") == source_id) & (F.col("rid") == rid)).select("pos")


def tag_positions(view: OrderedRows, tags: DataFrame, limit: int | None = None) -> DataFrame:
    """``(pos, tag_id)`` of tagged rows in view order; with a limit the first
    ones and ``truncated``."""
    found = view.frame.join(tags.select(*KEYS, "tag_id"), KEYS).select("pos", "tag_id")
    order = [F.col("pos"), F.col("tag_id")]
    return found.orderBy(*order) if limit is None else top_with_flag(found, order, limit)


def nearest_timestamp(df: DataFrame, moment: str, column: str | None = None) -> DataFrame:
    """The row closest in time over all (or the named) datetime columns, as
    ``(source_id, rid, ts, distance_seconds)``; ties go to the smallest key."""
    probe = normalise_bound(moment)
    if probe is None:
        raise ValueError(f"{moment!r} is no moment in time")
    every = datetime_columns(df)
    if column is not None and column not in every:
        raise ValueError(f"{column!r} holds no datetimes")
    chosen = [column] if column else every
    if not chosen:
        raise ValueError("No column holds datetimes")
    target = F.lit(probe).cast("timestamp_ntz")

    def candidate(name: str) -> Column:
        text = ts_normalize(df, name)
        gap = F.abs(F.timestamp_diff("SECOND", target, text.try_cast("timestamp_ntz")))
        return F.when(gap.isNotNull(), F.struct(gap.alias("distance_seconds"), text.alias("ts")))

    best = candidate(chosen[0]) if len(chosen) == 1 else F.least(*[candidate(c) for c in chosen])
    hits = df.select(*KEYS, best.alias("_best")).where(F.col("_best").isNotNull())
    flat = hits.select(*KEYS, "_best.ts", "_best.distance_seconds")
    return flat.orderBy("distance_seconds", *KEYS).limit(1)
