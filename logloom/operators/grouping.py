"""Group summaries, drill-down, whole group trees, distinct values, column widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    DATETIME, KEYS, NUMBER, as_text, data_fields, is_string, logical_types, ref,
)
from ..functions.scalars import day_bucket, numeric_or_null
from ..session import materialise
from .annotations import having_tags, without_tags

TAG_COLUMN = "__tag__"  # groups by the tags on the rows


def top_with_flag(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows in order plus ``truncated``.

    The window only ever sees the ``limit + 1`` rows of the top-k."""
    top = df.orderBy(*order).limit(limit + 1)
    all_of_it = Window.partitionBy(F.lit(0))
    ranked = top.withColumn("_n", F.row_number().over(all_of_it.orderBy(*order)))
    flagged = ranked.withColumn("truncated", F.count(F.lit(1)).over(all_of_it) > limit)
    return flagged.where(F.col("_n") <= limit).drop("_n")


def group_key(df: DataFrame, column: str, bucket_datetime: bool = True) -> Column:
    """What a column groups by: the calendar day of a datetime, else the value."""
    types = logical_types(df)
    if column not in types:
        raise KeyError(column)
    if types[column] == DATETIME and bucket_datetime:
        return day_bucket(df, column)
    return ref(column)


def group_day(df: DataFrame, column: str) -> DataFrame:
    """Rows per calendar day; unreadable values form a NULL group."""
    return df.groupBy(day_bucket(df, column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def narrow(df: DataFrame, path: list[dict] | None, tags: DataFrame | None = None) -> DataFrame:
    """The rows below a chain of chosen groups; NULL matches NULL."""
    for step in path or []:
        column, value = step["column"], step["value"]
        if column == TAG_COLUMN:
            if tags is None:
                raise ValueError("Grouping by tag needs the tags table")
            df = without_tags(df, tags) if value is None else having_tags(df, tags, [int(value)])
        else:
            df = df.where(group_key(df, column).eqNullSafe(F.lit(value)))
    return df


def group_by_tag(df: DataFrame, tags: DataFrame) -> DataFrame:
    """``(value, count)``: one group per tag id and a NULL group of untagged
    rows; a row with two tags counts in both."""
    marked = df.select(*KEYS).join(tags.select(*KEYS, "tag_id"), KEYS, "left")
    return marked.groupBy(F.col("tag_id").alias("value")).agg(F.count(F.lit(1)).alias("count"))


def group_summary(
    df: DataFrame, column: str, order: str = "count", direction: str | None = None, limit: int | None = None,
    path: list[dict] | None = None, bucket_datetime: bool = True,
    tags: DataFrame | None = None, tag_defs: DataFrame | None = None,
) -> DataFrame:
    """``(value, count, truncated)`` of all groups, or of the ``limit`` biggest
    (or first) ones.

    Counts sort descending by default, values ascending; ties go by value."""
    rows = narrow(df, path, tags)
    sort_key = F.col("value")
    if column == TAG_COLUMN:
        if tags is None:
            raise ValueError("Grouping by tag needs the tags table")
        groups = group_by_tag(rows, tags)
        if order == "value":
            if tag_defs is None:
                raise ValueError("Ordering tags by name needs the tag definitions")
            names = tag_defs.select(F.col("id").alias("value"), F.lower("name").alias("_name"))
            groups = groups.join(names, "value", "left")
            sort_key = F.col("_name")
    else:
        groups = rows.groupBy(group_key(rows, column, bucket_datetime).alias("value")).agg(
            F.count(F.lit(1)).alias("count")
        )
        if is_string(df, column):
            number = logical_types(df)[column] == NUMBER
            sort_key = numeric_or_null(F.col("value")) if number else F.lower(F.col("value"))
    key = F.col("count") if order == "count" else sort_key
    down = (direction or ("asc" if order == "value" else "desc")) == "desc"
    ranked = [key.desc() if down else key.asc(), F.col("value").asc()]
    if limit is None:
        return groups.orderBy(*ranked).select("value", "count", F.lit(False).alias("truncated"))
    return top_with_flag(groups, ranked, limit).select("value", "count", "truncated")


def expand_group(
    df: DataFrame, column: str, value, path: list[dict] | None = None, tags: DataFrame | None = None
) -> DataFrame:
    """The rows of one group; a ``pos`` column keeps the parent's order."""
    return narrow(df, [*(path or []), {"column": column, "value": value}], tags)


def _grouped_levels(df: DataFrame, keys: list[Column], names: list[str], first: int, last: int) -> DataFrame:
    """``(level, n0.., count)`` of the levels ``first`` to ``last``: rows are
    counted once by the finest key, and only those counts are rolled up."""
    fine = df.select(*[k.alias(n) for k, n in zip(keys[:last], names)]).groupBy(*names[:last]).agg(F.count(F.lit(1)).alias("count"))
    if first < last:
        sets = [[F.col(n) for n in names[:level]] for level in range(first, last + 1)]
        level = F.lit(last) - F.bit_count(F.grouping_id())
        fine = fine.groupingSets(sets, *[F.col(n) for n in names[:last]]).agg(F.sum("count").alias("count"), level.cast("int").alias("level"))
    else:
        fine = fine.withColumn("level", F.lit(last))
    return fine


def group_tree(
    df: DataFrame, columns: list[str], limit: int | None = None, order: str = "count", direction: str | None = None,
    tags: DataFrame | None = None, bucket_datetime: bool = True,
) -> DataFrame:
    """The whole drill-down over ``columns`` at once: ``(level, <columns>,
    count, position, truncated)``, one row per group of every level, deeper
    columns NULL.

    ``position`` orders the children of one parent like ``group_summary``; with
    a limit each parent keeps its first children, ``truncated`` says whether it
    has more, and what lies below a child that is left out is left out too.
    The source is scanned once, and once more above a level of tags, where a row
    with two tags counts in both groups but once in their parent."""
    if len(set(columns)) < len(columns) or not columns:
        raise ValueError("Group by at least one column, and by none twice")
    names = [f"_g{i}" for i in range(len(columns))]
    at_tags = columns.index(TAG_COLUMN) if TAG_COLUMN in columns else None
    if at_tags is not None:
        if tags is None:
            raise ValueError("Grouping by tag needs the tags table")
        # The tag's own name, since the rows may have a column of any other.
        tagged = df.join(tags.select(*KEYS, F.col("tag_id").alias(TAG_COLUMN)).distinct(), KEYS, "left")
    keys = [ref(c) if c == TAG_COLUMN else group_key(df, c, bucket_datetime) for c in columns]
    if at_tags is None:
        levels = _grouped_levels(df, keys, names, 1, len(columns))
    else:
        levels = _grouped_levels(tagged, keys, names, at_tags + 1, len(columns))
        if at_tags:
            levels = levels.unionByName(_grouped_levels(df, keys, names, 1, at_tags), allowMissingColumns=True)
    levels = levels.select("level", *names, "count")
    down = (direction or ("asc" if order == "value" else "desc")) == "desc"

    def of_level(level: int) -> DataFrame:
        own, column = F.col(names[level - 1]), columns[level - 1]
        key = F.col("count")
        if order != "count":
            key = own
            if column != TAG_COLUMN and is_string(df, column):
                key = numeric_or_null(own) if logical_types(df)[column] == NUMBER else F.lower(own)
        children = Window.partitionBy(*(names[: level - 1] or [F.lit(0)]))
        ranked = levels.where(F.col("level") == level).withColumn(
            "position", F.row_number().over(children.orderBy(key.desc() if down else key.asc(), own.asc()))
        )
        if limit is None:
            return ranked.withColumn("truncated", F.lit(False))
        # At most limit + 1 children of a parent reach the second window.
        first = ranked.where(F.col("position") <= limit + 1)
        flagged = first.withColumn("truncated", F.max("position").over(children) > limit)
        return flagged.where(F.col("position") <= limit)

    levels = materialise(levels, "group-levels")
    kept = [of_level(1)]
    for level in range(2, len(columns) + 1):
        below = of_level(level)
        if limit is not None:
            parents = kept[-1].select(*[F.col(n).alias(f"_p{n}") for n in names[: level - 1]])
            same = [F.col(n).eqNullSafe(F.col(f"_p{n}")) for n in names[: level - 1]]
            below = below.join(parents, same, "left_semi")
        kept.append(materialise(below, "group-level") if limit is not None and level < len(columns) else below)
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out.select("level", *[F.col(n).alias(c) for n, c in zip(names, columns)], "count", "position", "truncated")


TRACKED = 10_000  # values that a summary holds, in a task and merged


def _sketch_error(tracked: int) -> float:
    """The share of all rows by which a count of the summary may be off: 3.5
    through the slots of its table, a power of two filled to three quarters."""
    return 3.5 / (1 << (-(-tracked * 4 // 3) - 1).bit_length())


def top_values(df: DataFrame, column: str, limit: int, tracked: int = TRACKED) -> DataFrame:
    """``column_values`` with a limit, for columns of huge cardinality: the same
    rows, without a shuffle of all distinct values where a proof allows it.

    Every task keeps a frequent-items summary of at most ``tracked`` values; the
    merged one names every value that more than twice its error bound of the
    rows hold.  Those are counted exactly in a second scan.  When the last of the
    first ``limit`` is above twice the bound, no other value can be among them;
    otherwise all values are counted as usual."""
    if column not in {f.name for f in data_fields(df)}:
        raise KeyError(column)
    if isinstance(df.schema[column].dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType, T.BinaryType)):
        return column_values(df, column, limit)
    values = df.select(ref(column).alias("value"))
    summary = values.agg(F.expr(f"approx_top_k(value, {tracked}, {tracked})").alias("top"), F.count(F.lit(1)).alias("rows"))
    frequent = materialise(summary, "summary")
    held = materialise(frequent.select(F.explode("top").alias("t")).select(F.col("t.item").alias("item")), "frequent")
    # At most ``tracked`` rows.
    counted = materialise(
        values.join(F.broadcast(held), F.col("value").eqNullSafe(F.col("item"))).groupBy("value").agg(F.count(F.lit(1)).alias("count")),
        "recounted",
    )
    order = [F.col("count").desc(), F.col("value").asc()]
    rows = frequent.first()["rows"]
    first = [r["count"] for r in counted.orderBy(*order).limit(limit).select("count").collect()]
    all_of_it = sum(first) == rows  # there are no other values
    if not all_of_it and (len(first) < limit or first[-1] <= 2 * _sketch_error(tracked) * rows):
        return column_values(df, column, limit)
    return counted.orderBy(*order).limit(limit).select("value", "count", F.lit(sum(first) < rows).alias("truncated"))


def column_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Distinct stored values with counts, most frequent first; with a limit
    the first ones and ``truncated``."""
    if column not in {f.name for f in data_fields(df)}:
        raise KeyError(column)
    counts = df.groupBy(ref(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    order = [F.col("count").desc(), F.col("value").asc()]
    return counts.orderBy(*order) if limit is None else top_with_flag(counts, order, limit)


def column_max_lengths(df: DataFrame) -> DataFrame:
    """``(column, max_length)`` of every data column, one pass."""
    names = [f.name for f in data_fields(df)]
    widths = df.agg(
        *[F.coalesce(F.max(F.length(as_text(df, n))), F.lit(0)).alias(f"w{i}") for i, n in enumerate(names)]
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"w{i}").alias("max_length")) for i, n in enumerate(names)])
    return widths.select(F.inline(pairs))
