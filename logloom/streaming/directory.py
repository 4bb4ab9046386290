"""Importing a folder as a stream: each file exactly once, new files later."""

from __future__ import annotations

import csv
import hashlib
import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import KEYS, logical_types, ref
from ..functions.scalars import stripped
from ..operators.detect import infer_types
from ..operators.ids import file_blocks, file_row_ids
from ..sources.delimited import literal_path, parse_delimited, sniff_delimiter, text_lines
from ..sources.files import JSON_EXTENSIONS
from ..sources.json_records import LINE_EXTENSIONS, line_shapes, read_json_records, read_line_files
from ..sources.schema import clean_names

# What a broken file raises; inside a batch Spark's own errors may come unconverted.
UNREADABLE = (ValueError, PySparkException, Py4JJavaError)

FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
])


def first_lines(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The first line that is not blank of every file that has one, by one job
    over the files' first splits; one line per listed file comes back."""
    lines = text_lines(spark, [literal_path(p) for p in paths]).where(
        (F.col("_block") == 0) & (stripped(F.ltrim("text", F.lit("\ufeff"))) != "")
    )
    found = lines.groupBy("_file").agg(F.min_by("text", "_seq").alias("text"))
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = found.join(F.broadcast(listed), same_file(F.col("_file"), F.col("path"))).select("path", "text")
    return {r["path"]: r["text"].lstrip("\ufeff") for r in rows.collect()}


def layouts(heads: dict[str, str], delimiter: str | None = None) -> dict[tuple[str, tuple[str, ...]], list[str]]:
    """Files by ``(delimiter, column names)``: files of one layout are read by
    one scan, so the number of jobs follows the layouts, not the files."""
    found: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for path, line in sorted(heads.items()):
        sep = delimiter or sniff_delimiter([line])
        names = tuple(clean_names(next(csv.reader([line], delimiter=sep))))
        found.setdefault((sep, names), []).append(path)
    return found


def json_groups(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """Files of JSON lines by their keys: those of one shape are read by one
    scan.  A shape per listed file comes back."""
    if len(paths) < 2:
        return []
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    shapes = line_shapes(spark, [literal_path(p) for p in paths])
    found: dict[str, list[str]] = {}
    for r in shapes.join(F.broadcast(listed), same_file(F.col("_file"), F.col("path"))).select("path", "shape").collect():
        found.setdefault(r["shape"], []).append(r["path"])
    return [sorted(files) for _, files in sorted(found.items()) if len(files) > 1]


REGISTRY = (
    "source_id int, path string, kind string, layout string, columns string, types string, reason string"
)


def _last_source(spark: SparkSession, out: str, batch_id: int) -> int:
    """The largest source id of the earlier batches."""
    try:
        earlier = spark.read.parquet(f"{out}/sources").where(F.col("batch") < batch_id)
    except AnalysisException:
        return 0
    return earlier.agg(F.max("source_id")).head()[0] or 0


def _types(df: DataFrame) -> str:
    return json.dumps({r["column"]: r["type"] for r in infer_types(df.drop("_ragged")).collect()})


def ingest_directory_stream(
    spark: SparkSession, root: str, out: str, checkpoint: str, file_glob: str = "*",
    delimiter: str | None = None, max_files_per_batch: int = 1000, flatten: str = "none",
):
    """Import every not yet imported file below ``root``, JSON or delimited by
    its extension.

    The stream only lists files; its checkpoint is the record of what was
    imported.  Each batch writes ``out/data/layout=<n>/batch=<id>`` (one row per
    record with ``source_id`` and ``rid``) and ``out/sources/batch=<id>``: every
    file with its columns and their types, or with the reason it gave no rows.
    A batch that is run again after a failure overwrites its own output."""

    def load(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # A list of file names, at most max_files_per_batch.
        paths = sorted(r["path"] for r in batch.select("path").collect())
        if not paths:
            return
        ids = {p: i for i, p in enumerate(paths, start=_last_source(session, out, batch_id) + 1)}
        registry: list[tuple] = []

        def write(rows: DataFrame, label: str) -> None:
            rows.write.mode("append").parquet(f"{out}/data/layout={label}/batch={batch_id}")

        _clear(session, f"{out}/data", batch_id)
        json_files = [p for p in paths if p.lower().endswith(tuple(JSON_EXTENSIONS))]
        heads = first_lines(session, [p for p in paths if p not in set(json_files)]) if len(json_files) < len(paths) else {}
        for path in paths:
            if path not in heads and path not in json_files:
                registry.append((ids[path], path, "csv", None, "[]", "{}", "the file holds no line"))
        together = json_groups(session, [p for p in json_files if p.lower().endswith(LINE_EXTENSIONS)])
        for files in together:
            known = session.createDataFrame([(p, ids[p]) for p in files], "_path string, source_id int")
            try:
                frame = read_line_files(session, [literal_path(f) for f in files], flatten)
                names = tuple(c for c in frame.columns if c not in ("_file", "rid"))
                label = layout_label("json", names)
                located = frame.join(F.broadcast(known), same_file(F.col("_file"), F.col("_path"))).select(
                    "source_id", "rid", *[ref(n) for n in names], F.lit(False).alias("_ragged")
                )
                types = _types(frame.select(*[ref(n) for n in names]))
            except UNREADABLE:
                continue  # a broken file among them: each is read by itself below
            write(located, label)
            registry += [(ids[p], p, "json", label, json_names(names), types, None) for p in files]
            json_files = [p for p in json_files if p not in set(files)]
        for path in json_files:
            try:
                frame = read_json_records(session, literal_path(path), flatten, source_id=ids[path])
            except UNREADABLE as e:
                said = e.java_exception.getMessage() if isinstance(e, Py4JJavaError) else str(e)
                registry.append((ids[path], path, "json", None, "[]", "{}", (said or "unreadable").splitlines()[0][:500]))
                continue
            names = tuple(c for c in frame.columns if c not in KEYS)
            label = layout_label("json", names)
            write(frame.withColumn("_ragged", F.lit(False)), label)
            registry.append((ids[path], path, "json", label, json_names(names), json.dumps(logical_types(frame)), None))
        for (sep, names), files in layouts(heads, delimiter).items():
            label = layout_label(sep, names)
            parsed = parse_delimited(session, [literal_path(f) for f in files], list(names), sep)
            known = session.createDataFrame([(p, ids[p]) for p in files], "_path string, source_id int")
            located = file_row_ids(parsed, file_blocks(parsed)).join(
                F.broadcast(known), same_file(F.col("_file"), F.col("_path"))
            ).select("source_id", "rid", *[ref(n) for n in names], "_ragged")
            write(located, label)
            types = _types(parsed.select(*[ref(n) for n in names]))
            registry += [(ids[p], p, "csv", label, json_names(names), types, None) for p in files]
        session.createDataFrame(registry, REGISTRY).write.mode("overwrite").parquet(f"{out}/sources/batch={batch_id}")

    files = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("recursiveFileLookup", True).option("pathGlobFilter", file_glob)
        .option("maxFilesPerTrigger", max_files_per_batch)
        .load(root).select("path", "length")
    )
    return (
        files.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _clear(spark: SparkSession, data: str, batch_id: int) -> None:
    """Empty what a failed run of this batch has left: each layout's folder of
    the batch is overwritten by no rows before rows are appended."""
    try:
        # Only this batch's folders are listed, whatever was imported before.
        left = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{data}/layout=*/batch={batch_id}")
    except AnalysisException:
        return
    folders = left.select(F.regexp_extract("path", f"^(.*/batch={batch_id})/", 1).alias("f")).where("f <> ''").distinct()
    for row in folders.collect():
        spark.read.parquet(row["f"]).limit(0).write.mode("overwrite").parquet(row["f"])


def same_file(scanned, listed):
    """Scan metadata gives URIs (``file:///a%20b``), listings plain paths
    (``file:/a b``)."""
    decoded = F.try_url_decode(F.replace(scanned, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "/") == F.regexp_replace(listed, "^file:/+", "/")


def layout_label(sep: str, names: tuple[str, ...]) -> str:
    return hashlib.sha256("\x1f".join([sep, *names]).encode()).hexdigest()[:16]


def json_names(names: tuple[str, ...]) -> str:
    return json.dumps(list(names))
