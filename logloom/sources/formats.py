"""Custom file formats: a row producer as a Spark data source.

A format is a function ``parse(path, options)`` that returns ``columns``, an
iterable ``rows`` of cell lists and, if it likes, ``column_types``.  Files are
read in parallel and streamed batch by batch: one task per file, or one per byte
range where the format also states ``ranges(path, options)``, a list of (start,
stop) that cover the file.  ``parse`` then finds ``start`` and ``stop`` among its
options and gives the rows that begin between them.

Cells of columns that are not asked for, and rows that a simple filter leaves
out, never leave the reader's process; a format that can skip them earlier finds
``columns`` and ``where`` among its options.  Rows are numbered as the file holds
them, whatever is filtered: every range reports how many it had, and prefix sums
over the ranges make the numbers dense.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.columns import annotate, ref
from ..operators.detect import infer_types
from ..session import broadcast_if_small, materialise
from .schema import clean_names, normalise_rows

# Readers travel with their job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROW_SCHEMA = "file int, part int, place bigint, cells array<string>"
BATCH_ROWS = 4096
TESTS = {"equals": lambda cell, value: cell == value, "in": lambda cell, value: cell in value}


class Range(InputPartition):
    def __init__(self, file: int, part: int, path: str, start: int | None = None, stop: int | None = None):
        super().__init__((file, part))
        self.file, self.part, self.path, self.start, self.stop = file, part, path, start, stop


class CellReader(DataSourceReader):
    def __init__(self, parse: Callable, ranges: Callable | None, options: dict):
        self.parse, self.ranges, self.options = parse, ranges, options

    def partitions(self):
        out = []
        for i, path in enumerate(self.options["paths"].split("\n")):
            spans = self.ranges(path, dict(self.options)) if self.ranges else []
            out += [Range(i, k, path, *span) for k, span in enumerate(spans or [()])]
        return out

    def read(self, partition: Range):
        options = dict(self.options)
        wanted = json.loads(options.get("wanted", "null"))
        tests = json.loads(options.get("tests", "[]"))
        if partition.start is not None:
            options |= {"start": partition.start, "stop": partition.stop}
        rows = iter(self.parse(partition.path, options)["rows"])
        place = 0
        while batch := list(islice(rows, BATCH_ROWS)):
            places, cells = [], []
            for i, row in enumerate(batch):
                text = [None if c is None else c if isinstance(c, str) else str(c) for c in row]
                if all(TESTS[op](text[at] if at < len(text) else None, value) for at, op, value in tests):
                    places.append(place + i)
                    # The width stays, so that rows of another one are still known.
                    cells.append(text if wanted is None else [c if k in wanted else None for k, c in enumerate(text)])
            yield self._rows(partition, places, cells)
            place += len(batch)
        yield self._rows(partition, [place], [None])  # how many rows the range has

    @staticmethod
    def _rows(partition: Range, places: list[int], cells: list) -> pa.RecordBatch:
        n = len(places)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([partition.file] * n, pa.int32()), pa.array([partition.part] * n, pa.int32()),
                pa.array(places, pa.int64()), pa.array(cells, pa.list_(pa.string())),
            ],
            ["file", "part", "place", "cells"],
        )


FORMATS: dict[str, Callable] = {}


def register_format(spark: SparkSession, name: str, parse: Callable, ranges: Callable | None = None) -> None:
    """Make ``parse`` available as a format for :func:`read_format`; with
    ``ranges`` its files are read in several tasks."""

    class Format(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return ROW_SCHEMA

        def reader(self, schema):
            return CellReader(parse, ranges, dict(self.options))

    FORMATS[name] = parse
    spark.dataSource.register(Format)


def even_ranges(size: int, most: int = 128 << 20) -> list[tuple[int, int]]:
    """A file of ``size`` bytes in ranges of at most ``most``."""
    return [(at, min(at + most, size)) for at in range(0, size, most)] or [(0, 0)]


def read_format(
    spark: SparkSession, name: str, paths: list[str], options: dict[str, str] | None = None, first_source_id: int = 1,
    columns: list[str] | None = None, where: list[tuple[str, str, object]] | None = None,
) -> DataFrame:
    """Files of one custom format, each file a source with dense row ids.

    The first file names the columns; ``_ragged`` marks rows of another width.
    ``columns`` asks for some columns only, ``where`` for rows whose cells pass
    every ``(column, "equals" or "in", value)``; row ids stay those of the file."""
    options = dict(options or {})
    described = FORMATS[name](paths[0], dict(options))
    every = clean_names(list(described["columns"]))
    unknown = [c for c in [*(columns or []), *(c for c, _, _ in where or [])] if c not in every]
    if unknown:
        raise ValueError(f"The format has no columns {unknown}")
    asked = [c for c in every if columns is None or c in columns]
    if columns is not None:
        options |= {"columns": "\n".join(asked), "wanted": json.dumps([every.index(c) for c in asked])}
    if where:
        tests = [[every.index(c), op, list(value) if op == "in" else value] for c, op, value in where]
        if any(op not in TESTS for _, op, _ in tests):
            raise ValueError(f"A reader's filter is one of {sorted(TESTS)}")
        options |= {"where": json.dumps([[c, op, v] for (c, _, _), (_, op, v) in zip(where, tests)]), "tests": json.dumps(tests)}
    raw = spark.read.format(name).options(paths="\n".join(paths), **options).load()
    raw = materialise(raw, "format")  # the producers run once
    # One row per range.
    ranges = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = raw.where("cells IS NULL").select("file", "part", F.coalesce(F.sum("place").over(ranges), F.lit(0)).alias("before"))
    rows = raw.where("cells IS NOT NULL").join(broadcast_if_small(materialise(before, "ranges")), ["file", "part"])
    wide = normalise_rows(rows, "cells", every)
    keyed = wide.select(
        (F.col("file") + first_source_id).cast("int").alias("source_id"), (F.col("before") + F.col("place") + 1).alias("rid"),
        *[ref(c) for c in asked], "_ragged",
    )
    types = {r["column"]: r["type"] for r in infer_types(keyed.drop("_ragged")).collect()}
    types.update({c: t for c, t in zip(every, described.get("column_types") or []) if t and c in asked})
    return annotate(keyed, types)
