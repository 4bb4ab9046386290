"""The row nearest in time to each of many moments: a two-sided as-of join.

Rows become one entry per second, the smallest key of that second; probes one
per distinct second.  Both are range-partitioned by time into one order, each
range looks back and forth inside itself, and one line per range carries the
last entry before it and the first one behind it over its borders.  So neither
a cross join nor a window over everything is needed, and since seconds are
unique in that order, no moment is too frequent to be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, as_text, datetime_columns, is_timestamp, ref
from ..functions.scalars import ts_normalize, ts_normalize_text
from ..session import materialise
from .hierarchy import HOT_ROWS, join_hot_keys
from .ids import IN_TASK, TASK_BITS, OrderedRows

ENTRY = ("s", "source_id", "rid")


def _second(text: Column) -> Column:
    """Whole seconds of normalised timestamp text, NULL when it is no moment."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), text.try_cast("timestamp_ntz"))


def _entries(df: DataFrame, column: str | None) -> DataFrame:
    """``(s, source_id, rid)``: the smallest row key of every second."""
    every = datetime_columns(df)
    if column is not None and column not in every:
        raise ValueError(f"{column!r} holds no datetimes")
    chosen = [column] if column else every
    if not chosen:
        raise ValueError("No column holds datetimes")
    seconds = F.array(*[_second(ts_normalize(df, c)) for c in chosen])
    held = df.select(*KEYS, F.explode(F.array_distinct(F.array_compact(seconds))).alias("s"))
    first = held.groupBy("s").agg(F.min(F.struct(*KEYS)).alias("k"))
    return first.select("s", "k.source_id", "k.rid")


def _around(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """Every asked ``s`` with the entries at or before it and at or after it."""
    entry = F.struct(*ENTRY)
    rows = entries.select("s", entry.alias("here"), F.lit(False).alias("asks")).unionByName(
        asked.select("s", F.lit(None).cast(entries.select(entry.alias("e")).schema["e"].dataType).alias("here"), F.lit(True).alias("asks"))
    )
    # One line per second: an entry, a question, or both.
    merged = rows.groupBy("s").agg(F.min("here").alias("here"), F.max("asks").alias("asks"))
    ordered = materialise(merged.orderBy("s").withColumn("_seq", F.monotonically_increasing_id()), "moments")
    task = F.shiftright("_seq", TASK_BITS)
    place = F.col("_seq").bitwiseAND(F.lit(IN_TASK))
    # Both look back, in either order: a frame that ends where the range ends
    # would be gone through again for every row.
    upto = (Window.unboundedPreceding, 0)
    forth, back = Window.partitionBy(task).orderBy(place.asc()), Window.partitionBy(task).orderBy(place.desc())
    looked = ordered.withColumns({
        "_task": task,
        "_back": F.last("here", ignorenulls=True).over(forth.rowsBetween(*upto)),
        "_on": F.last("here", ignorenulls=True).over(back.rowsBetween(*upto)),
    }).where("asks")
    # One line per task of the sort: the window over them and the broadcast are
    # bounded by the number of tasks.
    ends = ordered.groupBy(task.alias("_task")).agg(F.max("here").alias("last"), F.min("here").alias("first"))
    before = (Window.unboundedPreceding, -1)
    tasks, tasks_back = (Window.partitionBy(F.lit(0)).orderBy(o) for o in (F.col("_task").asc(), F.col("_task").desc()))
    borders = ends.select(
        "_task",
        F.last("last", ignorenulls=True).over(tasks.rowsBetween(*before)).alias("_left"),
        F.last("first", ignorenulls=True).over(tasks_back.rowsBetween(*before)).alias("_right"),
    )
    return looked.join(F.broadcast(materialise(borders, "borders")), "_task").select(
        "s", F.coalesce("_back", "_left").alias("back"), F.coalesce("_on", "_right").alias("on")
    )


def nearest_timestamps(
    df: DataFrame, probes: DataFrame, moment: str = "moment", column: str | None = None,
    view: OrderedRows | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``probes`` with the row of ``df`` closest in time to each one's
    ``moment``: ``source_id``, ``rid``, ``ts`` and ``distance_seconds``, and
    with a view of these rows their ``pos`` in it.

    All datetime columns count, or the named one, by the second.  Ties go to the
    smallest key, and inside a row to the earlier moment.  A probe that is no
    moment, or has no row to find, gets NULLs; probes may repeat."""
    taken = {"source_id", "rid", "ts", "distance_seconds", "pos"} & set(probes.columns)
    if taken:
        raise ValueError(f"The probes already have {sorted(taken)}")
    rows = df if view is None else df.join(view.frame.select(*KEYS), KEYS, "left_semi")
    text = ts_normalize(probes, moment) if is_timestamp(probes, moment) else ts_normalize_text(as_text(probes, moment))
    asking = materialise(probes.withColumn("_s", _second(text)), "probes")
    asked = asking.where(F.col("_s").isNotNull()).select(F.col("_s").alias("s")).distinct()
    around = _around(_entries(rows, column), asked)

    def candidate(name: str) -> Column:
        side = F.col(name)
        gap = F.abs(side["s"] - F.col("s"))
        return F.when(side.isNotNull(), F.struct(gap.alias("gap"), side["source_id"].alias("source_id"), side["rid"].alias("rid"), side["s"].alias("at")))

    best = F.least(candidate("back"), candidate("on"))
    at = F.timestamp_add("SECOND", F.col("b.at"), F.lit("1970-01-01").cast("timestamp_ntz"))
    answers = around.select(F.col("s").alias("_s"), best.alias("b")).where("b IS NOT NULL").select(
        "_s", "b.source_id", "b.rid", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("b.gap").alias("distance_seconds")
    )
    if view is not None:
        answers = answers.join(view.frame.select(*KEYS, "pos"), KEYS)
    answers = materialise(answers, "nearest")
    found = join_hot_keys(asking, answers, ["_s"], hot_rows, asking.limit(hot_rows + 1).count())
    return found.select(*[ref(c) for c in probes.columns], *[c for c in answers.columns if c != "_s"])
