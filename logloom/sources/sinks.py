"""Exports: ordered CSV, tagged rows per source, annotation sessions."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import KEYS, as_text, data_fields, ref
from ..functions.scalars import csv_safe
from ..operators.annotations import Annotations, having_tags
from ..operators.ids import IN_TASK
from ..operators.timeline import Source
from ..session import broadcast_if_small


def tag_names(tags: DataFrame, tag_defs: DataFrame) -> DataFrame:
    """``(source_id, rid, Tags)``: names joined by ``; `` in tag-id order; an
    undefined tag shows its id."""
    # One tag may hold most assignments: broadcast the definitions if they are few.
    names = broadcast_if_small(tag_defs.select(F.col("id").alias("tag_id"), "name"))
    named = tags.join(names, "tag_id", "left").select(
        *KEYS, F.struct("tag_id", F.coalesce("name", F.col("tag_id").cast("string")).alias("name")).alias("t")
    )
    per_row = named.groupBy(*KEYS).agg(F.sort_array(F.collect_set("t")).alias("ts"))
    return per_row.select(*KEYS, F.array_join(F.transform("ts", lambda t: t["name"]), "; ").alias("Tags"))


def export_rows(
    df: DataFrame, tags: DataFrame, tag_defs: DataFrame, notes: DataFrame, tagged_only: bool = False
) -> DataFrame:
    """``Line, Tags, Note`` and the guarded cells; keys and ``pos`` stay for
    ordering."""
    data = [f.name for f in data_fields(df)]
    out = df.join(tag_names(tags, tag_defs), KEYS, "inner" if tagged_only else "left")
    out = out.join(notes.select(*KEYS, F.col("note").alias("Note")), KEYS, "left")
    order = ["pos"] if "pos" in df.columns else []
    return out.select(
        *order, *KEYS,
        F.col("rid").alias("Line"),
        F.coalesce("Tags", F.lit("")).alias("Tags"),
        csv_safe(F.coalesce("Note", F.lit(""))).alias("Note"),
        *[csv_safe(F.coalesce(as_text(df, c), F.lit(""))).alias(c) for c in data],
    )


def _write_csv(ordered: DataFrame, path: str) -> None:
    ordered.write.option("header", True).option("quote", '"').option("escape", '"').option(
        "emptyValue", ""
    ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def export_csv(
    df: DataFrame, path: str, tags: DataFrame, tag_defs: DataFrame, notes: DataFrame, tagged_only: bool = False
) -> None:
    """Ordered CSV part files: by ``pos`` when the view has one, else by row."""
    rows = export_rows(df, tags, tag_defs, notes, tagged_only)
    order = ["pos"] if "pos" in rows.columns else ["rid", "source_id"]
    _write_csv(rows.orderBy(*order).drop("pos", *KEYS), path)


CSV_OPTIONS = {
    "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}
ROWS_PER_FILE = 1_000_000
ROWS_PER_TASK = 50_000  # of short files a task writes several, one after another


def _csv_line(cells: list[Column]) -> Column:
    return F.to_csv(F.struct(*cells), CSV_OPTIONS)


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below the value.  They travel as one
    array, so many of them do not lengthen the plan."""
    at = np.array(bounds, np.int64)

    @F.arrow_udf("int")
    def place(values: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(at, values.to_numpy(zero_copy_only=False)).astype(np.int32))

    return place(value) if bounds else F.lit(0)


def export_tagged(
    sources: list[Source], path: str, tags: DataFrame, tag_defs: DataFrame, notes: DataFrame, rows_per_file: int = ROWS_PER_FILE
) -> list[int]:
    """A CSV folder ``source_id=<id>`` per source that has tagged rows; returns
    their ids.

    One job writes all of them: each source's rows become lines of its own
    layout, are cut into ranges by rid, a task's work each, and every task writes
    its rows in order to files of at most ``rows_per_file`` rows that begin with
    the source's header.  The ranges come from the tags alone: a line per source,
    with a bound per task."""
    marked = tags.select(*KEYS).distinct()
    listed = {s.id: s for s in sources}
    counts = {r["source_id"]: r["n"] for r in marked.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).collect() if r["source_id"] in listed}
    if not counts:
        return []
    bounds: dict[int, list[int]] = {sid: [] for sid in counts}
    rows_per_task = rows_per_file * max(1, ROWS_PER_TASK // rows_per_file)
    large = {sid: -(-n // rows_per_task) for sid, n in counts.items() if n > rows_per_task}
    for tasks in sorted(set(large.values())):
        share = F.percentile_approx("rid", [i / tasks for i in range(1, tasks)], 10_000).alias("at")
        chosen = marked.where(F.col("source_id").isin([s for s, n in large.items() if n == tasks]))
        bounds |= {r["source_id"]: sorted(set(r["at"])) for r in chosen.groupBy("source_id").agg(share).collect()}
    frames, base = [], 0
    for sid in sorted(counts):
        mine = tags.where(F.col("source_id") == sid)
        rows = export_rows(having_tags(listed[sid].keyed(), mine), mine, tag_defs, notes, tagged_only=True)
        cells = [c for c in rows.columns if c not in KEYS]
        place = F.lit(base) + _range_of(F.col("rid"), bounds[sid])
        head = _csv_line([F.lit(c).alias(f"c{i}") for i, c in enumerate(cells)])
        line = _csv_line([ref(c).alias(f"c{i}") for i, c in enumerate(cells)])
        frames.append(rows.select("source_id", "rid", place.alias("_task"), head.alias("_head"), line.alias("_line")))
        base += len(bounds[sid]) + 1
    # The writer's own order is by source: with it in front, no second sort moves the rows.
    ordered = reduce(DataFrame.unionByName, frames).repartitionById(base, F.col("_task")).sortWithinPartitions("source_id", "rid")
    # A task holds one source's rows, and the row that opens a file brings the header.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(IN_TASK)) % rows_per_file == 0
    line = F.when(first, F.concat("_head", F.lit("\n"), "_line")).otherwise(F.col("_line"))
    ordered.select("source_id", line.alias("value")).write.partitionBy("source_id").option("maxRecordsPerFile", rows_per_file).text(path)
    return sorted(counts)


def export_annotations(
    path: str, source: Source, annotations: Annotations, definitions: list[dict], fingerprint: str
) -> None:
    """A session folder: tag definitions, this source's tags and notes, its
    derived-column definitions and its identity."""
    spark = source.frame.sparkSession
    mine = F.col("source_id") == source.id
    annotations.tag_defs.write.json(f"{path}/tag_defs")
    annotations.tags.where(mine).write.parquet(f"{path}/tags")
    annotations.notes.where(mine).write.parquet(f"{path}/notes")
    identity = [(source.id, source.name, fingerprint, json.dumps(definitions))]
    spark.createDataFrame(
        identity, "source_id int, name string, fingerprint string, derived_columns string"
    ).write.json(f"{path}/source")


def read_annotations(spark: SparkSession, path: str) -> tuple[Annotations, dict]:
    """``(annotations, identity)`` of a session folder."""
    defs = spark.read.schema("id int, name string, color string, hotkey string").json(f"{path}/tag_defs")
    tables = Annotations(defs, spark.read.parquet(f"{path}/tags"), spark.read.parquet(f"{path}/notes"))
    row = spark.read.schema(
        "source_id int, name string, fingerprint string, derived_columns string"
    ).json(f"{path}/source").head()
    identity = row.asDict()
    identity["derived_columns"] = json.loads(identity["derived_columns"])
    return tables, identity


def export_case(
    path: str, sources: list[Source], annotations: Annotations,
    definitions: dict[int, list[dict]], fingerprints: dict[int, str],
) -> None:
    """One session folder per source of the case."""
    for source in sources:
        export_annotations(
            f"{path}/source_id={source.id}", source, annotations,
            definitions.get(source.id, []), fingerprints[source.id],
        )

