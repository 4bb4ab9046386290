"""Dense row numbers without a single-partition window.

``with_position`` sorts once, writes the sorted rows with a per-task sequence,
and shifts each task's sequence by the row counts of the tasks before it.  The
second pass reads the written table, so both passes see the same order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ref
from ..session import broadcast_if_small, materialise

TASK_BITS = 33  # monotonically_increasing_id keeps the task number above these bits
IN_TASK = (1 << TASK_BITS) - 1


@dataclass
class OrderedRows:
    """A written, sorted table and the first position of each of its tasks."""

    table: DataFrame  # sorted rows with the sequence column
    starts: list[tuple[int, int, int]]  # (task, rows before it, its rows), in order

    @property
    def count(self) -> int:
        return sum(rows for _, _, rows in self.starts)

    @property
    def frame(self) -> DataFrame:
        """All rows with their dense 1-based ``pos``."""
        return self._numbered(self.table)

    def _numbered(self, rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        # One row per sort task: the task count bounds this broadcast.
        before = spark.createDataFrame([(t, b) for t, b, _ in self.starts] or [(0, 0)], "_task bigint, _before bigint")
        task = F.shiftright(F.col("_seq"), TASK_BITS)
        pos = F.col("_before") + F.col("_seq").bitwiseAND(F.lit(IN_TASK)) + 1
        joined = rows.withColumn("_task", task).join(F.broadcast(before), "_task")
        return joined.select(pos.alias("pos"), *[ref(c) for c in self.table.columns if c != "_seq"])

    def window(self, start: int, count: int) -> DataFrame:
        """Rows at positions ``start .. start+count-1``.

        Positions and sequence grow together, so the window is one sequence
        range and the Parquet scan skips every other row group."""
        first, last = max(start, 1), start + count - 1
        inside = [(t, b, n) for t, b, n in self.starts if b < last and b + n >= first]
        if not inside:
            return self.frame.limit(0)
        (t0, b0, _), (t1, b1, n1) = inside[0], inside[-1]
        low = (t0 << TASK_BITS) + max(first - b0 - 1, 0)
        high = (t1 << TASK_BITS) + min(last - b1, n1) - 1
        return self._numbered(self.table.where(F.col("_seq").between(low, high)))


def number_sorted(rows: DataFrame, label: str) -> OrderedRows:
    """Write rows that are already in order, task by task, and index them."""
    table = materialise(rows.withColumn("_seq", F.monotonically_increasing_id()), label)
    # One row per task comes to the driver.
    counted = (
        table.groupBy(F.shiftright(F.col("_seq"), TASK_BITS).alias("task"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("task")
        .collect()
    )
    starts, before = [], 0
    for row in counted:
        starts.append((row["task"], before, row["n"]))
        before += row["n"]
    return OrderedRows(table, starts)


def order_rows(df: DataFrame, order: list[Column], label: str = "ordered") -> OrderedRows:
    """Range-sort ``df`` by a fully determining order and write it once.

    The order must end in a unique key: that also lets the range partitioner
    split a value that fills a third of the table."""
    return number_sorted(df.orderBy(*order), label)


def with_position(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Dense 1..N in the given order."""
    frame = order_rows(df, order).frame
    return frame if name == "pos" else frame.withColumnRenamed("pos", name)


def with_row_id(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Dense ``rid`` from 1: in the given order, or in the frame's own row
    order (task by task) when none is given."""
    if order:
        return with_position(df, order, "rid")
    return number_sorted(df, "rows").frame.withColumnRenamed("pos", "rid")


def file_blocks(parsed: DataFrame, per_file: bool = True) -> DataFrame:
    """One row per scan split (128 MB of input): its rows, its smallest
    sequence, the rows before it and how many rows were ragged.

    ``parsed`` rows carry ``_file``, ``_block`` (start byte of the split),
    ``_seq`` (task sequence) and ``_ragged``.  The prefix sum runs over splits,
    not rows."""
    blocks = parsed.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_first"), F.count_if("_ragged").alias("_bad")
    )
    scope = Window.partitionBy("_file") if per_file else Window.partitionBy(F.lit(0))
    earlier = scope.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    return materialise(
        blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))), "splits"
    )


def file_row_ids(parsed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Dense ``rid`` in file order.

    A split is read by one task in order, so a row's place in its split is the
    distance from the split's smallest sequence.  A split table too long to
    broadcast joins by shuffle on groups no larger than a split."""
    starts = broadcast_if_small(blocks.select("_file", "_block", "_first", "_before"))
    rid = F.col("_before") + F.col("_seq") - F.col("_first") + 1
    keep = [ref(c) for c in parsed.columns if c not in ("_block", "_seq")]
    return parsed.join(starts, ["_file", "_block"]).select(rid.alias("rid"), *keep)


def first_rows(parsed: DataFrame, blocks: DataFrame, count: int) -> DataFrame:
    """The first rows in file order, read from the splits that hold them."""
    # At most ``count`` splits, since none is empty.
    heads = blocks.where(F.col("_before") < count).orderBy("_file", "_block").limit(count).collect()
    wanted = F.lit(False)
    for split in heads:
        last = split["_first"] + count - split["_before"] - 1
        wanted = wanted | (
            (F.col("_file") == split["_file"]) & (F.col("_block") == split["_block"])
            & F.col("_seq").between(split["_first"], last)
        )
    return parsed.where(wanted)


BLOCK_ROWS = 1_000_000


def count_drops(df: DataFrame, mark: str, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """How often ``mark`` has dropped so far, in rid order within each source;
    rows without a mark are passed over.

    Two phases, so that no task holds a whole source: each source is cut into
    blocks of ``block_rows`` dense rids and drops are counted inside the blocks;
    only the block summaries (one row per million) are then put in order."""
    value = ref(mark)
    block = F.call_function("div", F.col("rid") - 1, F.lit(block_rows))
    inner = Window.partitionBy("source_id", "_block").orderBy("rid")
    earlier = inner.rowsBetween(Window.unboundedPreceding, -1)
    so_far = inner.rowsBetween(Window.unboundedPreceding, 0)
    drop = F.when(value < F.last(value, ignorenulls=True).over(earlier), 1).otherwise(0)
    counted = (
        df.withColumn("_block", block)
        .withColumn("_drop", drop)
        .withColumn("_inner", F.sum("_drop").over(so_far))
    )
    counted = materialise(counted, "drops")
    marked = F.when(value.isNotNull(), F.col("rid"))
    blocks = counted.groupBy("source_id", "_block").agg(
        F.min_by(value, marked).alias("_first"),
        F.max_by(value, marked).alias("_last"),
        F.sum("_drop").alias("_drops"),
    )
    across = Window.partitionBy("source_id").orderBy("_block")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    at_edge = F.when(F.col("_first") < F.last("_last", ignorenulls=True).over(before), 1).otherwise(0)
    carried = F.coalesce(F.lag("_drops").over(across), F.lit(0))
    bases = blocks.select("source_id", "_block", (at_edge + carried).alias("_step")).select(
        "source_id", "_block",
        F.sum("_step").over(across.rowsBetween(Window.unboundedPreceding, 0)).alias("_base"),
    )
    # A mark-less start of a block belongs to the drops counted before it, and
    # the edge drop counts from the block's first mark on.
    joined = counted.join(bases, ["source_id", "_block"])
    total = (F.col("_base") + F.col("_inner")).alias(name)
    return joined.select(*[ref(c) for c in df.columns], total)
