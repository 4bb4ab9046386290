"""Readers, writers and the import stream, run on files written from the given tables."""

import sys
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import logical_types, ref
from ..operators import annotations as ann
from ..operators.predicates import where_op
from ..operators.timeline import Source
from ..operators.view import build_view
from ..session import materialise, scratch_path
from ..sources import adhoc, delimited, files, formats, json_records, schema, sinks, webkit
from ..streaming.directory import ingest_directory_stream
from .catalog import NOTES_SQL, TAG_DEFS_SQL, TAGS_SQL, query

CELLS = "o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_totalprice::VARCHAR AS o_totalprice, o_orderpriority"


def _orders_csv(t) -> str:
    """Orders as CSV part files in key order."""
    path = scratch_path(t.spark, "orders-csv")
    t.raw("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").orderBy("o_orderkey").write.option(
        "header", True
    ).csv(path)
    return path


@query("read_delimited", f"SELECT o_orderkey + 1 AS rid, {CELLS}, 0 AS ragged FROM orders")
def _(t):
    read = delimited.read_delimited(t.spark, _orders_csv(t))
    return read.frame.drop("source_id").withColumn("ragged", F.lit(read.ragged_rows))


@query("read_delimited_ragged",
       "SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS status, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS prio, "
       "(SELECT count(*) FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 400000) AS ragged FROM orders")
def _(t):
    path = scratch_path(t.spark, "ragged")
    line = F.concat_ws(
        "\t", F.col("o_orderkey").cast("string"), "o_orderstatus",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")),
        F.when((F.col("o_orderstatus") != "P") & (F.col("o_totalprice") > 400000), F.lit("one too many")),
    )
    lines = t.raw("orders").select(line.alias("value"))
    lines.write.text(path)
    names = ["key", "status", "prio"]
    parsed = materialise(delimited.parse_delimited(t.spark, [path], names, "\t", has_header=False), "ragged")
    return parsed.select(*names).withColumn("ragged", parsed.agg(F.count_if("_ragged")).scalar())


@query("read_delimited_multiline",
       "SELECT rid, key, cell, last, (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 9) AS ragged FROM ("
       "SELECT o_orderkey + 1 + (o_orderkey + 1) // 10 - CASE WHEN o_orderkey % 10 = 9 THEN 1 ELSE 0 END AS rid, o_orderkey::VARCHAR AS key, "
       "o_orderstatus || chr(10) || '\"' || chr(10) || ',' AS cell, o_orderpriority AS last FROM orders "
       "UNION ALL SELECT o_orderkey + 1 + (o_orderkey + 1) // 10, '', '', '' FROM orders WHERE o_orderkey % 10 = 9)")
def _(t):
    """Line breaks, quotes and separators inside quotes; every tenth row is
    followed by a blank line."""
    path = scratch_path(t.spark, "quoted")
    cell = F.concat(F.lit('"'), "o_orderstatus", F.lit('\n""\n,"'))
    end = F.when(F.col("o_orderkey") % 10 == 9, "\n").otherwise("")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), cell, F.concat("o_orderpriority", end))
    t.raw("orders").orderBy("o_orderkey").select(line.alias("value")).write.text(path)
    read = delimited.read_delimited(t.spark, path, delimiter=",", has_header=False)
    return read.frame.select("rid", F.col("col_1").alias("key"), F.col("col_2").alias("cell"), F.col("col_3").alias("last")).withColumn(
        "ragged", F.lit(read.ragged_rows))


@query("read_json_full",
       "SELECT event_id::VARCHAR AS event_id, event_type AS \"user.kind\", user_id::VARCHAR AS \"user.more.id\", "
       "'[\"' || event_type || '\",\"x\"]' AS tags FROM events")
def _(t):
    return json_records.read_json_records(t.spark, _events_json(t), flatten="full").drop("source_id", "rid")


@query("read_json_depth",
       "SELECT event_id::VARCHAR AS event_id, event_type AS \"user.kind\", '{\"id\":' || user_id::VARCHAR || '}' AS \"user.more\", "
       "'[\"' || event_type || '\",\"x\"]' AS tags FROM events")
def _(t):
    return json_records.read_json_records(t.spark, _events_json(t), flatten="depth", depth=1).drop("source_id", "rid")


@query("read_json_none",
       "SELECT event_id::VARCHAR AS event_id, '{\"kind\":\"' || event_type || '\",\"more\":{\"id\":' || user_id::VARCHAR || '}}' AS user, "
       "'[\"' || event_type || '\",\"x\"]' AS tags FROM events")
def _(t):
    return json_records.read_json_records(t.spark, _events_json(t)).drop("source_id", "rid")


NESTED = [
    "event_id", "named_struct('kind', event_type, 'more', named_struct('id', user_id)) AS user", "array(event_type, 'x') AS tags",
]


def _events_json(t) -> str:
    path = scratch_path(t.spark, "events") + ".jsonl"
    t.raw("events").selectExpr(*NESTED).write.json(path)
    return path


@query("flatten_objects",
       "SELECT event_id::VARCHAR AS event_id, event_type AS \"user.kind\", '{\"id\":' || user_id::VARCHAR || '}' AS \"user.more\", "
       "'[\"' || event_type || '\",\"x\"]' AS tags FROM events")
def _(t):
    return json_records.flatten_objects(t.raw("events").selectExpr(*NESTED), max_depth=1)


@query("scan_files",
       "SELECT DISTINCT 'o_orderstatus=' || o_orderstatus AS folder, CASE WHEN o_orderstatus = 'P' THEN 'excluded' ELSE 'matched' END AS status, "
       "CASE WHEN o_orderstatus = 'P' THEN 'excluded by pattern: *status=P/*' END AS reason, "
       "CASE WHEN o_orderstatus <> 'P' THEN 'csv' END AS kind FROM orders")
def _(t):
    path = scratch_path(t.spark, "scan")
    t.raw("orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").csv(path)
    found = files.scan_files(t.spark, path, include=["*.CSV"], exclude=["*status=P/*"])
    folder = F.substring_index("rel_path", "/", 1).alias("folder")
    return found.select(folder, "status", "reason", "kind").distinct()


@query("normalise_rows",
       "SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS \"First_1\", "
       "CASE WHEN p_size > 25 THEN p_type ELSE '' END AS col_3, p_size <= 25 OR p_size > 40 AS _ragged FROM part")
def _(t):
    cells = F.concat(
        F.split("p_name", " "), F.when(F.col("p_size") > 25, F.array("p_type")).otherwise(F.array().cast("array<string>")),
        F.when(F.col("p_size") > 40, F.array(F.lit("cut"))).otherwise(F.array().cast("array<string>")),
    )
    rows = t.raw("part").select("p_partkey", cells.alias("cells"))
    return schema.normalise_rows(rows, "cells", ["first", "First", " "])


def _parse_marked(path, options):
    """A row producer for lines of ``~``-separated cells on any shared storage."""
    import pyarrow.fs

    files, local = pyarrow.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") else path)

    def rows():
        import io

        with files.open_input_stream(local) as stream:
            for line in io.TextIOWrapper(stream, encoding="utf-8"):
                yield line.rstrip("\n").split(options["mark"])

    return {"columns": ["key", "status", "price"], "rows": rows(), "column_types": ["number", "text", "number"]}


cloudpickle.register_pickle_by_value(sys.modules[__name__])


@query("custom_format",
       "SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS status, o_totalprice::VARCHAR AS price, false AS _ragged FROM orders")
def _(t):
    path = scratch_path(t.spark, "marked")
    cells = F.concat_ws("~", F.col("o_orderkey").cast("string"), "o_orderstatus", F.col("o_totalprice").cast("string"))
    t.raw("orders").repartition(4).select(cells.alias("value")).write.text(path)
    parts = [r["path"] for r in files.scan_files(t.spark, path, extensions=[".txt"]).where("status = 'matched'").collect()]
    formats.register_format(t.spark, "marked", _parse_marked)
    return formats.read_format(t.spark, "marked", parts, {"mark": "~"}).drop("source_id", "rid")


def _marked_ranges(path, options):
    import pyarrow.fs

    files, local = pyarrow.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1))
    return formats.even_ranges(files.get_file_info(local).size, 40_000)


def _parse_marked_range(path, options):
    """Like ``_parse_marked``, for the lines that begin in a byte range."""
    import io

    import pyarrow.fs

    files, local = pyarrow.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1))

    def rows():
        with io.BufferedReader(files.open_input_file(local)) as stream:
            at, stop = options["start"], options["stop"]
            stream.seek(max(at - 1, 0))
            if at:  # a line that began earlier belongs to the range before
                at += len(stream.readline()) - 1
            while at < stop and (line := stream.readline()):
                at += len(line)
                yield line.decode().rstrip("\n").split(options["mark"])

    return {"columns": ["key", "status", "price"], "rows": rows(), "column_types": ["number", "text", "number"]}


@query("custom_format_ranges",
       "SELECT row_number() OVER (ORDER BY o_orderkey) AS rid, o_orderkey::VARCHAR AS key, o_totalprice::VARCHAR AS price, o_orderstatus "
       "FROM orders QUALIFY o_orderstatus IN ('F', 'P')")
def _(t):
    # One file, read in ranges; the reader filters and leaves a column out.
    path = scratch_path(t.spark, "marked")
    cells = F.concat_ws("~", F.col("o_orderkey").cast("string"), "o_orderstatus", F.col("o_totalprice").cast("string"))
    t.raw("orders").orderBy("o_orderkey").coalesce(1).select(cells.alias("value")).write.text(path)
    parts = [r["path"] for r in files.scan_files(t.spark, path, extensions=[".txt"]).where("status = 'matched'").collect()]
    formats.register_format(t.spark, "marked_ranges", _parse_marked_range, _marked_ranges)
    read = formats.read_format(
        t.spark, "marked_ranges", parts, {"mark": "~"}, columns=["key", "status", "price"], where=[("status", "in", ["F", "P"])]
    )
    return read.withColumnRenamed("status", "o_orderstatus").select("rid", "key", "price", "o_orderstatus")


@query("read_json_array",
       "SELECT CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS rid, event_id::VARCHAR AS event_id, event_type AS \"what.type\", "
       "value::VARCHAR AS \"what.value\", props FROM events")
def _(t):
    path = scratch_path(t.spark, "array") + ".json"
    # One line of one file: an array of nested objects, in event order.
    record = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("event_id"),
        F.struct(F.col("event_type").alias("type"), F.col("value").cast("string").alias("value")).alias("what"), "props",
    ))
    ordered = t.raw("events").orderBy("event_id").coalesce(1).select(F.concat(
        F.when(F.monotonically_increasing_id() == 0, F.lit("[")).otherwise(F.lit(",")), record).alias("value"))
    closing = t.spark.range(1).select(F.lit("]").alias("value"))
    ordered.unionByName(closing).coalesce(1).write.option("lineSep", " ").text(path)
    return json_records.read_json_records(t.spark, path, "full").drop("source_id")


@query("convert_webkit",
       "SELECT event_id, CASE WHEN event_type = 'view' THEN 'none' ELSE strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS visit_time "
       "FROM events")
def _(t):
    return webkit.convert_webkit(_visits(t), ["Visit_Time"]).select("event_id", "visit_time")


def _visits(t):
    us = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) + 11644473600000000"
    return t.text(
        "events", event_id="event_id", visit_time=f"CASE WHEN event_type = 'view' THEN 'none' ELSE CAST({us} AS STRING) END",
        some_date="event_type",
    )


@query("detect_webkit",
       "SELECT 'visit_time' AS column FROM events HAVING avg(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) >= 0.7")
def _(t):
    rows = _visits(t)
    return webkit.detect_webkit(rows.where("visit_time <> 'none'"), sample=None)


@query("source_fingerprint", "SELECT count(*) AS row_count, true AS same_reordered, true AS differs_changed FROM orders")
def _(t):
    orders = t.raw("orders")
    a = schema.source_fingerprint(orders)
    b = schema.source_fingerprint(orders.repartition(7, "o_custkey"))
    c = schema.source_fingerprint(orders.withColumn("o_totalprice", F.col("o_totalprice") + 1))
    content = F.struct("row_count", "content_xor", "content_sum")
    return a.select(
        "row_count",
        (content == b.select(content).scalar()).alias("same_reordered"),
        (content != c.select(content).scalar()).alias("differs_changed"),
    )


AD_HOC = """SELECT c_mktsegment, {day}(CAST(o_orderdate AS {text})) AS day, count(*) AS n FROM orders
JOIN customer ON o_custkey = c_custkey WHERE {match}('urgent', o_orderpriority) GROUP BY 1, 2"""


@query("sql_query",
       "SELECT c_mktsegment, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders "
       "JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority ILIKE '%urgent%' GROUP BY 1, 2")
def _(t):
    sources = {"orders": t.raw("orders"), "customer": t.raw("customer")}
    text = AD_HOC.format(day="day_bucket", match="regexp_match", text="STRING") + " ORDER BY 1, 2"
    return adhoc.sql_query(t.spark, text, sources).frame


# ------------------------------------------------------------------- sinks

EXPORT_SQL = f"""WITH {TAGS_SQL}, {NOTES_SQL}, {TAG_DEFS_SQL}, named AS (
    SELECT rid, string_agg(name, '; ' ORDER BY tag_id) AS tags FROM tags JOIN tag_defs ON id = tag_id WHERE source_id = 1 GROUP BY rid
) SELECT (o_orderkey + 1)::VARCHAR AS "Line", coalesce(tags, '') AS "Tags", coalesce(note, '') AS "Note",
    o_orderstatus, o_orderpriority FROM orders """


@query("export_csv", EXPORT_SQL + "LEFT JOIN named ON named.rid = o_orderkey + 1 LEFT JOIN notes ON notes.rid = o_orderkey + 1 "
       "WHERE o_orderstatus = 'F'")
def _(t):
    path = scratch_path(t.spark, "export")
    rows = where_op(t.orders, "o_orderstatus", "equals", "F")
    ordered = build_view(rows, {"sort": [{"column": "o_totalprice", "dir": "desc"}]})
    cells = rows.select("source_id", "rid", "o_orderstatus", "o_orderpriority").join(ordered.frame, ["source_id", "rid"])
    sinks.export_csv(cells, path, t.tags, t.tag_defs, t.notes)
    return _read_back(t, path)


def _read_back(t, path):
    names = ["Line", "Tags", "Note", "o_orderstatus", "o_orderpriority"]
    rows = t.spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select(*[F.coalesce(ref(n), F.lit("")).alias(n) for n in names])


@query("export_tagged", EXPORT_SQL + "JOIN named ON named.rid = o_orderkey + 1 LEFT JOIN notes ON notes.rid = o_orderkey + 1")
def _(t):
    path = scratch_path(t.spark, "tagged")
    orders = Source(1, "orders", t.orders.select("rid", "o_orderstatus", "o_orderpriority"))
    customers = Source(3, "customer", t.customer.select("rid", "c_name"))
    sinks.export_tagged([orders, customers], path, t.tags, t.tag_defs, t.notes)
    return _read_back(t, path + "/source_id=1")


@query("export_tagged_all",
       f"WITH {TAGS_SQL}, {NOTES_SQL}, {TAG_DEFS_SQL}, named AS ("
       "SELECT source_id, rid, string_agg(name, '; ' ORDER BY tag_id) AS tags FROM tags JOIN tag_defs ON id = tag_id GROUP BY ALL) "
       "SELECT source_id, rid::VARCHAR AS \"Line\", tags AS \"Tags\", coalesce(note, '') AS \"Note\", "
       "coalesce(o_orderpriority, event_type) AS label FROM named LEFT JOIN notes USING (source_id, rid) "
       "LEFT JOIN orders ON source_id = 1 AND rid = o_orderkey + 1 LEFT JOIN events ON source_id = 2 AND rid = event_id + 1")
def _(t):
    path = scratch_path(t.spark, "tagged")
    sources = [
        Source(1, "orders", t.orders.select("rid", "o_orderstatus", "o_orderpriority")),
        Source(2, "events", t.events.select("rid", "event_type", "value", "ts")), Source(3, "customer", t.customer.select("rid", "c_name")),
    ]
    done = sinks.export_tagged(sources, path, t.tags, t.tag_defs, t.notes, rows_per_file=500)
    labels = {1: "o_orderpriority", 2: "event_type"}
    read = {sid: t.spark.read.option("header", True).option("escape", '"').csv(f"{path}/source_id={sid}") for sid in done}
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(sid).alias("source_id"), "Line", "Tags", F.coalesce("Note", F.lit("")).alias("Note"), F.col(labels[sid]).alias("label"))
        for sid, df in read.items()
    ])


@query("session_round_trip",
       f"WITH {TAGS_SQL}, {NOTES_SQL} SELECT t.source_id, t.rid, tag_id, note FROM tags t LEFT JOIN notes n "
       "ON n.source_id = t.source_id AND n.rid = t.rid WHERE t.source_id = 1")
def _(t):
    path = scratch_path(t.spark, "session")
    source = t.source("orders")
    sinks.export_annotations(path, source, ann.Annotations(t.tag_defs, t.tags, t.notes), [], schema.fingerprint_text(source.frame))
    back, _ = sinks.read_annotations(t.spark, path)
    return back.tags.join(back.notes, ["source_id", "rid"], "left")


# ------------------------------------------------------------------ stream

@query("ingest_directory_stream",
       "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_totalprice::VARCHAR AS o_totalprice, o_orderpriority, "
       "false AS _ragged, count(*) OVER () AS dense FROM orders")
def _(t):
    root, out = scratch_path(t.spark, "incoming"), scratch_path(t.spark, "imported")
    mark = scratch_path(t.spark, "stream-state")
    orders = t.raw("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    first, later = orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'")
    first.write.option("header", True).csv(f"{root}/a")
    t.raw("customer").select("c_custkey", "c_name").write.option("header", True).csv(f"{root}/b")
    ingest_directory_stream(t.spark, root, out, mark).awaitTermination()
    later.write.option("header", True).csv(f"{root}/c")
    # Files of the first run are not read again.
    ingest_directory_stream(t.spark, root, out, mark).awaitTermination()
    registry = t.spark.read.parquet(f"{out}/sources")
    label = registry.where("columns LIKE '%o_orderkey%'").select("layout").head()["layout"]
    rows = t.spark.read.option("recursiveFileLookup", True).parquet(f"{out}/data/layout={label}")
    # Row ids are dense per source: the largest ones add up to the row count.
    per_source = rows.groupBy("source_id").agg(F.max("rid").alias("top"))
    dense = per_source.agg(F.sum("top")).scalar()
    return rows.drop("source_id", "rid").withColumn("dense", dense)


@query("logical_types",
       "SELECT * FROM (VALUES ('o_orderkey', 'number'), ('o_orderstatus', 'text'), ('o_totalprice', 'number'), "
       "('o_orderpriority', 'text')) v(name, type) WHERE (SELECT count(*) FROM orders) > 0")
def _(t):
    frame = delimited.read_delimited(t.spark, _orders_csv(t)).frame
    return t.spark.createDataFrame(list(logical_types(frame).items()), "name string, type string")
