"""Grouping, tags, notes, timeline, sweeps and graphs over the given tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import annotations as ann
from ..operators import graph, grouping, search
from ..operators.hierarchy import join_journal, resolve_paths
from ..operators.timeline import Source, merge_sources, timeline, timeline_view
from .catalog import NOTES_SQL, TAGS_SQL, query


@query("group_summary",
       "SELECT event_type AS value, count(*) AS count, false AS truncated FROM events "
       "WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20 00:00:01' GROUP BY 1")
def _(t):
    from ..operators.predicates import time_range

    return grouping.group_summary(time_range(t.events, "2024-01-05", "2024-01-20"), "event_type")


@query("group_summary_truncated",
       "SELECT o_custkey AS value, count(*) AS count, true AS truncated FROM orders GROUP BY 1 "
       "ORDER BY 2 DESC, 1 LIMIT 25")
def _(t):
    return grouping.group_summary(t.orders, "o_custkey", limit=25)


@query("group_by_value",
       "SELECT o_orderpriority AS value, count(*) AS count, true AS truncated FROM orders GROUP BY 1 "
       "ORDER BY lower(value) DESC LIMIT 3")
def _(t):
    return grouping.group_summary(t.orders, "o_orderpriority", order="value", direction="desc", limit=3)


@query("group_day", "SELECT strftime(ts, '%Y-%m-%d') AS value, count(*) AS count FROM events GROUP BY 1")
def _(t):
    return grouping.group_day(t.events, "ts")


@query("group_nested",
       "SELECT strftime(ts, '%Y-%m-%d') AS value, count(*) AS count, false AS truncated FROM events "
       "WHERE event_type = 'error' AND user_id = 8 GROUP BY 1")
def _(t):
    path = [{"column": "event_type", "value": "error"}, {"column": "user_id", "value": 8}]
    return grouping.group_summary(t.events, "ts", order="value", path=path)


@query("expand_group",
       "SELECT event_id, event_type FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-09' AND event_type = 'view'")
def _(t):
    rows = grouping.expand_group(t.events, "ts", "2024-01-09", path=[{"column": "event_type", "value": "view"}])
    return rows.select("event_id", "event_type")


@query("column_values",
       "SELECT o_orderdate AS value, count(*) AS count FROM orders GROUP BY 1")
def _(t):
    return grouping.column_values(t.orders, "o_orderdate")


@query("column_max_lengths",
       "SELECT 'doc_id' AS column, max(length(doc_id::VARCHAR)) AS max_length FROM documents "
       "UNION ALL SELECT 'text', max(length(text)) FROM documents UNION ALL SELECT 'lang', max(length(lang)) FROM documents "
       "UNION ALL SELECT 'source', max(length(source)) FROM documents "
       "UNION ALL SELECT 'n_chars', max(length(n_chars::VARCHAR)) FROM documents")
def _(t):
    return grouping.column_max_lengths(t.documents).withColumn("max_length", F.col("max_length").cast("bigint"))


@query("group_merged",
       "SELECT nation AS value, count(*) AS count, false AS truncated FROM (SELECT c_nationkey AS nation FROM customer "
       "UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def _(t):
    customers = t.customer.selectExpr("rid", "c_name AS name", "c_nationkey AS nation")
    suppliers = t.supplier.selectExpr("rid", "s_name AS name", "s_nationkey AS nation")
    merged = merge_sources([Source(21, "customers", customers), Source(22, "suppliers", suppliers)])
    return grouping.group_summary(merged, "nation")


# ------------------------------------------------------------------- tags

@query("group_by_tag",
       f"WITH {TAGS_SQL} SELECT tag_id AS value, count(*) AS count, false AS truncated FROM orders "
       "LEFT JOIN tags ON rid = o_orderkey + 1 AND source_id = 1 GROUP BY 1")
def _(t):
    return grouping.group_summary(
        t.orders, grouping.TAG_COLUMN, order="value", tags=t.tags, tag_defs=t.tag_defs
    )


@query("group_below_tag",
       f"WITH {TAGS_SQL} SELECT o_orderstatus AS value, count(*) AS count, false AS truncated FROM orders "
       "WHERE o_orderkey + 1 IN (SELECT rid FROM tags WHERE source_id = 1 AND tag_id = 2) GROUP BY 1")
def _(t):
    return grouping.group_summary(
        t.orders, "o_orderstatus", path=[{"column": grouping.TAG_COLUMN, "value": 2}], tags=t.tags
    )


@query("filter_tagged_none",
       f"WITH {TAGS_SQL} SELECT event_id FROM events WHERE event_id + 1 NOT IN (SELECT rid FROM tags WHERE source_id = 2)")
def _(t):
    return ann.filter_tagged(t.events, t.tags, ["__none__"]).select("event_id")


@query("filter_tagged_any",
       f"WITH {TAGS_SQL} SELECT event_id FROM events WHERE event_id + 1 IN (SELECT rid FROM tags WHERE source_id = 2)")
def _(t):
    return ann.filter_tagged(t.events, t.tags, ["__any__"]).select("event_id")


@query("explode_tags",
       f"WITH {TAGS_SQL} SELECT o_orderkey, tag_id FROM orders JOIN tags ON rid = o_orderkey + 1 AND source_id = 1")
def _(t):
    return ann.explode_tags(t.orders, t.tags).select("o_orderkey", "tag_id")


@query("attach_annotations",
       f"WITH {TAGS_SQL}, {NOTES_SQL}, sets AS (SELECT rid, string_agg(tag_id::VARCHAR, ',' ORDER BY tag_id) AS tag_ids "
       "FROM tags WHERE source_id = 1 GROUP BY rid) SELECT o_orderkey, coalesce(tag_ids, '') AS tag_ids, note FROM orders "
       "LEFT JOIN sets ON sets.rid = o_orderkey + 1 LEFT JOIN notes ON notes.rid = o_orderkey + 1")
def _(t):
    rows = ann.attach_annotations(t.orders, t.tags, t.notes)
    return rows.select(
        "o_orderkey", F.array_join(F.transform("tag_ids", lambda x: x.cast("string")), ",").alias("tag_ids"), "note"
    )


@query("tag_counts", f"WITH {TAGS_SQL} SELECT tag_id, count(*) AS count FROM tags GROUP BY 1")
def _(t):
    return ann.tag_counts(t.tags)


@query("tag_counts_in_view",
       f"WITH {TAGS_SQL} SELECT tag_id, count(*) AS count FROM tags JOIN orders ON rid = o_orderkey + 1 AND source_id = 1 "
       "WHERE o_orderstatus = 'F' GROUP BY 1")
def _(t):
    return ann.tag_counts_in_view(t.orders.where("o_orderstatus = 'F'"), t.tags)


@query("tag_time_bounds",
       f"WITH {TAGS_SQL} SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') "
       'AS "end" FROM events WHERE event_id + 1 IN (SELECT rid FROM tags WHERE source_id = 2 AND tag_id = 2)')
def _(t):
    return ann.tag_time_bounds(t.events, t.tags, [2])


@query("source_stats",
       f"WITH {TAGS_SQL}, {NOTES_SQL}, rows_ AS (SELECT 1 AS source_id, count(*) AS row_count FROM orders "
       "UNION ALL SELECT 2, count(*) FROM events UNION ALL SELECT 3, count(*) FROM customer) "
       "SELECT source_id, row_count, "
       "(SELECT count(DISTINCT rid) FROM tags WHERE tags.source_id = rows_.source_id) AS tagged_row_count, "
       "(SELECT count(*) FROM notes WHERE notes.source_id = rows_.source_id) AS note_count FROM rows_")
def _(t):
    keys = [getattr(t, n).select("source_id", "rid") for n in ("orders", "events", "customer")]
    return ann.source_stats(keys[0].unionByName(keys[1]).unionByName(keys[2]), t.tags, t.notes)


TARGET = "o_totalprice BETWEEN 300000 AND 420000"


@query("tag_delta",
       f"WITH {TAGS_SQL} SELECT 1 AS source_id, o_orderkey + 1 AS rid, 2 AS tag_id FROM orders WHERE {TARGET} "
       "AND o_orderkey + 1 NOT IN (SELECT rid FROM tags WHERE source_id = 1 AND tag_id = 2)")
def _(t):
    return ann.tag_delta(t.orders.where(TARGET), t.tags, 2)


@query("tag_apply",
       f"WITH {TAGS_SQL} SELECT source_id, rid, tag_id FROM tags UNION "
       f"SELECT 1, o_orderkey + 1, 2 FROM orders WHERE {TARGET} AND o_orderkey NOT IN (3, 5)")
def _(t):
    return ann.tag_view(t.orders.where(TARGET), t.tags, 2, exclude=[(1, 4), (1, 6)]).tags


@query("tag_remove",
       f"WITH {TAGS_SQL} SELECT source_id, rid, tag_id FROM tags EXCEPT "
       f"SELECT 1, o_orderkey + 1, 2 FROM orders WHERE {TARGET}")
def _(t):
    return ann.tag_view(t.orders.where(TARGET), t.tags, 2, on=False).tags


@query("tag_revert", f"WITH {TAGS_SQL} SELECT source_id, rid, tag_id FROM tags")
def _(t):
    change = ann.tag_view(t.orders.where(TARGET), t.tags, 2)
    return ann.revert_delta(change.tags, change.delta)


@query("tag_summary",
       f"WITH {TAGS_SQL} SELECT (SELECT count(*) FROM orders WHERE {TARGET}) AS affected, "
       f"(SELECT count(*) FROM orders WHERE {TARGET} AND o_orderkey + 1 NOT IN "
       "(SELECT rid FROM tags WHERE source_id = 1 AND tag_id = 1)) AS changed")
def _(t):
    rows = t.orders.where(TARGET).select("source_id", "rid")
    return ann.set_tags(rows.unionByName(rows), t.tags, 1).summary()


@query("distinct_rows", "SELECT DISTINCT 1 AS source_id, l_orderkey + 1 AS rid FROM lineitem")
def _(t):
    lines = t.raw("lineitem").select(F.lit(1).alias("source_id"), (F.col("l_orderkey") + 1).alias("rid"))
    return ann.distinct_rows(lines)


@query("drop_tag", f"WITH {TAGS_SQL} SELECT source_id, rid, tag_id FROM tags WHERE tag_id <> 1")
def _(t):
    return ann.drop_tag(t.tags, t.tag_defs, 1)[0]


@query("remove_source", f"WITH {TAGS_SQL} SELECT source_id, rid, tag_id FROM tags WHERE source_id <> 2")
def _(t):
    return ann.remove_source({"tags": t.tags, "notes": t.notes, "tag_defs": t.tag_defs}, 2)["tags"]


@query("upsert_notes",
       f"WITH {NOTES_SQL}, changes AS (SELECT 1 AS source_id, o_orderkey + 1 AS rid, CASE WHEN o_orderstatus = 'P' "
       "THEN '  ' ELSE 'seen ' || o_orderstatus END AS note FROM orders WHERE o_totalprice > 440000) "
       "SELECT coalesce(n.source_id, c.source_id) AS source_id, coalesce(n.rid, c.rid) AS rid, coalesce(c.note, n.note) AS note "
       "FROM notes n FULL JOIN changes c ON n.source_id = c.source_id AND n.rid = c.rid WHERE trim(coalesce(c.note, n.note)) <> ''")
def _(t):
    changes = t.orders.where("o_totalprice > 440000").select(
        "source_id", "rid",
        F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.concat(F.lit("seen "), "o_orderstatus")).alias("note"),
    )
    return ann.upsert_notes(t.notes, changes)


@query("upsert_notes_twice",
       "SELECT 1 AS source_id, o_orderkey + 1 AS rid, CASE WHEN o_totalprice > 470000 THEN 'second' ELSE 'check ' || o_orderpriority END AS note "
       "FROM orders WHERE o_totalprice > 450000 AND o_totalprice <= 490000")
def _(t):
    """Of several changes of a row the last one counts, a blank one as well."""
    changed = t.orders.where("o_totalprice > 470000").select("source_id", "rid", "o_totalprice")
    first = changed.select("source_id", "rid", F.lit("zz first").alias("note"), F.lit(1).alias("at"))
    second = changed.select("source_id", "rid", F.lit("second").alias("note"), F.lit(2).alias("at"))
    third = changed.where("o_totalprice > 490000").select("source_id", "rid", F.lit(" ").alias("note"), F.lit(3).alias("at"))
    return ann.upsert_notes(t.notes, second.unionByName(third).unionByName(first), order="at")


@query("import_case",
       f"WITH {TAGS_SQL} SELECT source_id, rid, tag_id FROM tags "
       "UNION SELECT 1, o_orderkey + 1, 5 FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' "
       "UNION SELECT 1, o_orderkey + 1, 2 FROM orders WHERE o_totalprice > 380000 "
       "UNION SELECT 1, o_orderkey + 1, 5 FROM orders WHERE o_totalprice < 5000")
def _(t):
    """A case that knew the orders under another id, and a source not open here."""
    there = _incoming(t)
    other = lambda df: df.withColumn("source_id", F.lit(71)).unionByName(df.withColumn("source_id", F.lit(72)))
    session = t.spark.createDataFrame([(71, "a"), (72, "gone")], "source_id int, fingerprint string")
    here = t.spark.createDataFrame([(1, "a"), (2, "b")], "source_id int, fingerprint string")
    moved = ann.Annotations(there.tag_defs, other(there.tags), other(there.notes))
    return ann.import_case(ann.Annotations(t.tag_defs, t.tags, t.notes), moved, session, here).annotations.tags


@query("merged_tag_defs",
       "WITH mine AS (SELECT CAST(row_number() OVER (ORDER BY name) AS INT) AS id, name FROM (SELECT DISTINCT c_mktsegment AS name FROM customer)), "
       "theirs AS (SELECT 100 + row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT lower(c_mktsegment) AS name FROM customer "
       "WHERE c_mktsegment < 'H' UNION SELECT DISTINCT event_type FROM events)) "
       "SELECT * FROM mine UNION ALL SELECT CAST((SELECT max(id) FROM mine) + row_number() OVER (ORDER BY id) AS INT), name FROM theirs "
       "WHERE lower(name) NOT IN (SELECT lower(name) FROM mine)")
def _(t):
    def defined(names, first):
        numbered = names.distinct().withColumn("id", (F.row_number().over(Window.orderBy("name")) + first).cast("int"))
        return numbered.select("id", "name", F.lit("#111111").alias("color"), F.lit(None).cast("string").alias("hotkey"))

    segments = t.raw("customer").select(F.col("c_mktsegment").alias("name"))
    theirs = segments.where("name < 'H'").select(F.lower("name").alias("name")).union(t.raw("events").select("event_type"))
    other = _incoming(t)
    merged = ann.merge_annotations(
        ann.Annotations(defined(segments, 0), t.tags, t.notes), ann.Annotations(defined(theirs, 100), other.tags, other.notes)
    )
    return merged.tag_defs.select("id", "name")


def _incoming(t):
    """Another analyst's session over the same orders."""
    defs = t.spark.createDataFrame(
        [(1, "BIG", "#000000", None), (2, "Late", "#111111", None), (9, "late", "#222222", None)],
        "id int, name string, color string, hotkey string",
    )
    late = t.orders.where("o_orderdate >= timestamp_ntz'2001-01-01'").select("source_id", "rid", F.lit(2).alias("tag_id"))
    big = t.orders.where("o_totalprice > 380000").select("source_id", "rid", F.lit(1).alias("tag_id"))
    odd = t.orders.where("o_totalprice < 5000").select("source_id", "rid", F.lit(9).alias("tag_id"))
    notes = t.orders.where("o_totalprice > 480000").select("source_id", "rid", F.lit("theirs").alias("note"))
    return ann.Annotations(defs, late.unionByName(big).unionByName(odd), notes)


@query("merge_annotations",
       f"WITH {TAGS_SQL} SELECT source_id, rid, tag_id FROM tags "
       "UNION SELECT 1, o_orderkey + 1, 5 FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' "
       "UNION SELECT 1, o_orderkey + 1, 2 FROM orders WHERE o_totalprice > 380000 "
       "UNION SELECT 1, o_orderkey + 1, 5 FROM orders WHERE o_totalprice < 5000")
def _(t):
    return ann.merge_annotations(ann.Annotations(t.tag_defs, t.tags, t.notes), _incoming(t)).tags


@query("merge_annotations_replace",
       f"WITH {TAGS_SQL} SELECT source_id, rid, tag_id FROM tags WHERE source_id <> 1 "
       "UNION SELECT 1, o_orderkey + 1, 5 FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' "
       "UNION SELECT 1, o_orderkey + 1, 2 FROM orders WHERE o_totalprice > 380000 "
       "UNION SELECT 1, o_orderkey + 1, 5 FROM orders WHERE o_totalprice < 5000")
def _(t):
    return ann.merge_annotations(ann.Annotations(t.tag_defs, t.tags, t.notes), _incoming(t), merge=False).tags


@query("merge_notes",
       "SELECT 1 AS source_id, o_orderkey + 1 AS rid, CASE WHEN o_totalprice > 480000 THEN 'theirs' "
       "ELSE 'check ' || o_orderpriority END AS note FROM orders WHERE o_totalprice > 450000")
def _(t):
    return ann.merge_annotations(ann.Annotations(t.tag_defs, t.tags, t.notes), _incoming(t)).notes


# ------------------------------------------------------- timeline and merges

@query("merge_sources",
       "SELECT 21 AS source_id, c_custkey + 1 AS rid, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer "
       "WHERE c_acctbal > 5000 UNION ALL SELECT 22, s_suppkey + 1, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 5000")
def _(t):
    from ..operators.predicates import where_op

    customers = t.customer.selectExpr("rid", "c_name AS name", "c_nationkey AS nation", "c_acctbal AS balance")
    suppliers = t.supplier.selectExpr("rid", "s_acctbal AS BALANCE", "s_name AS Name", "s_nationkey AS Nation")
    merged = merge_sources([Source(21, "customers", customers), Source(22, "suppliers", suppliers)])
    return where_op(merged, "balance", ">", "5000")


TIMELINE_SQL = f"""WITH {TAGS_SQL}, sets AS (
    SELECT source_id, rid, string_agg(tag_id::VARCHAR, ',' ORDER BY tag_id) AS tag_ids FROM tags GROUP BY 1, 2
), every_row AS (
    SELECT 1 AS source_id, o_orderkey + 1 AS rid, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts,
        o_orderstatus || ' | ' || o_orderpriority AS body, 'Order' AS type_label, 'orders' AS source_name FROM orders
    UNION ALL
    SELECT 2, event_id + 1, strftime(ts, '%Y-%m-%d %H:%M:%S'),
        event_type || ' | ' || user_id::VARCHAR || ' | ' || props, 'events', 'events' FROM events
), hits AS (SELECT * FROM every_row JOIN sets USING (source_id, rid))
"""
TIMELINE_CONFIG = {
    1: {"body_columns": ["o_orderstatus", "o_orderpriority", "gone"], "type_label": "Order"},
    2: {"timestamp_column": "nope", "body_columns": ["event_type", "user_id", "props"]},
}


def _flat_tags(df):
    return df.withColumn("tag_ids", F.array_join(F.transform("tag_ids", lambda x: x.cast("string")), ","))


@query("timeline", TIMELINE_SQL + "SELECT source_id, rid, ts, body, type_label, source_name, tag_ids FROM hits")
def _(t):
    return _flat_tags(timeline([t.source("orders"), t.source("events")], t.tags, TIMELINE_CONFIG))


@query("timeline_one_tag", TIMELINE_SQL + """
SELECT row_number() OVER (ORDER BY ts NULLS LAST, source_id, rid) AS pos, source_id, rid, ts, tag_ids FROM hits
WHERE (source_id, rid) IN (SELECT (source_id, rid) FROM tags WHERE tag_id = 2)""")
def _(t):
    rows = timeline([t.source("orders"), t.source("events")], t.tags, TIMELINE_CONFIG, tag_ids=[2])
    return _flat_tags(timeline_view(rows).frame).select("pos", "source_id", "rid", "ts", "tag_ids")


# ------------------------------------------------------------------ sweeps

SWEEP_TEXT = """swept AS (
    SELECT 6 AS source_id, concat_ws(' ', doc_id::VARCHAR, text, lang, source, n_chars::VARCHAR) AS b FROM documents
    UNION ALL SELECT 7, concat_ws(' ', page_id::VARCHAR, url, html) FROM pages
    UNION ALL SELECT 9, concat_ws(' ', conv_id::VARCHAR, turn::VARCHAR, role, text) FROM conversations
    UNION ALL SELECT 8, concat_ws(' ', item_id::VARCHAR, text) FROM benchmark
)"""
SWEEP_TERMS = ["license", "http", "@", "assistant", "zzzz-no-such-term"]


def _sweep(t):
    return {6: t.documents, 7: t.pages, 9: t.conversations, 8: t.benchmark}


@query("search_all",
       f"WITH {SWEEP_TEXT}, hits AS (SELECT source_id, count(*) AS n FROM swept WHERE b ILIKE '%the%' GROUP BY 1) "
       "SELECT source_id, n AS match_count, false AS capped FROM hits")
def _(t):
    return search.search_all(_sweep(t), "the")


@query("search_all_terms",
       f"WITH {SWEEP_TEXT}, hits AS (SELECT source_id, count(*) AS n FROM swept WHERE "
       + " OR ".join(f"b ILIKE '%{term}%'" for term in SWEEP_TERMS)
       + " GROUP BY 1) SELECT source_id, n AS match_count, false AS capped FROM hits")
def _(t):
    return search.search_all(_sweep(t), terms=[{"term": x, "connector": "OR"} for x in SWEEP_TERMS])


@query("search_all_by_term",
       f"WITH {SWEEP_TEXT}, hits AS (SELECT source_id, term, count(*) AS n FROM swept, "
       "(VALUES " + ", ".join(f"('{term}')" for term in SWEEP_TERMS) + ") v(term) "
       "WHERE contains(lower(b), lower(term)) GROUP BY 1, 2) "
       "SELECT source_id, term, n AS match_count, false AS capped FROM hits")
def _(t):
    terms = search.positive_or_terms([{"term": x, "connector": "OR"} for x in SWEEP_TERMS])
    return search.search_all_by_term(_sweep(t), terms)


# ------------------------------------------------------------------- graphs

@query("edges",
       "SELECT l_suppkey::VARCHAR AS src, l_partkey::VARCHAR AS dst, count(*) AS n, count(DISTINCT l_returnflag) AS labels, "
       "true AS truncated FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2 ORDER BY n DESC, src, dst LIMIT 500")
def _(t):
    return graph.edges(t.raw("lineitem"), "l_suppkey", "l_partkey", "l_returnflag", limit=500)


@query("edges_all",
       "SELECT user_id::VARCHAR AS src, event_type AS dst, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return graph.edges(t.events, "user_id", "event_type", limit=None)


@query("node_degrees",
       "WITH e AS (SELECT l_suppkey::VARCHAR AS src, l_partkey::VARCHAR AS dst, count(*) AS n FROM lineitem "
       "WHERE l_suppkey <> l_partkey GROUP BY 1, 2), ends AS (SELECT src AS node, n, n AS o FROM e "
       "UNION ALL SELECT dst, n, 0 FROM e) SELECT node, sum(n)::BIGINT AS degree, sum(o)::BIGINT AS out_degree FROM ends GROUP BY 1")
def _(t):
    return graph.node_degrees(graph.edges(t.raw("lineitem"), "l_suppkey", "l_partkey", limit=None))


# Parts as a file tree: part k lies in part k/2, parts 0 and 1 in the root.
# Parts of size 50 had their number re-used, so what names them is an orphan.

def _files(t):
    parts = t.part.selectExpr(
        "p_partkey + 100 AS entry", "IF(p_size = 50, 2, 1) AS seq", "p_name AS name",
        "CASE WHEN p_partkey < 2 THEN 5L ELSE p_partkey div 2 + 100 END AS parent_entry", "1 AS parent_seq",
    )
    return parts


@query("resolve_paths",
       r"""WITH RECURSIVE files AS (
    SELECT p_partkey + 100 AS entry, CASE WHEN p_size = 50 THEN 2 ELSE 1 END AS seq, p_name AS name,
        CASE WHEN p_partkey < 2 THEN 5 ELSE p_partkey // 2 + 100 END AS parent_entry FROM part
), tops AS (
    SELECT f.entry, f.seq, CASE WHEN f.parent_entry = 5 THEN '.\' || f.name ELSE '.\<orphan>\' || f.name END AS full_path
    FROM files f LEFT JOIN files p ON p.entry = f.parent_entry
    WHERE f.parent_entry = 5 OR p.entry IS NULL OR p.seq <> 1
), walk AS (
    SELECT entry, seq, full_path FROM tops
    UNION ALL
    SELECT f.entry, f.seq, w.full_path || '\' || f.name FROM files f JOIN walk w ON w.entry = f.parent_entry AND w.seq = 1
    WHERE f.parent_entry <> 5
) SELECT entry, full_path FROM walk""")
def _(t):
    return resolve_paths(_files(t)).select("entry", "full_path")


@query("join_journal",
       "SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice, name FROM lineitem LEFT JOIN "
       "(SELECT p_partkey + 100 AS entry, CASE WHEN p_size = 50 THEN 2 ELSE 1 END AS seq, p_name AS name FROM part) f "
       "ON f.entry = l_partkey + 100 AND f.seq = 1")
def _(t):
    journal = t.raw("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_partkey + 100 AS entry", "1 AS seq"
    )
    return join_journal(journal, _files(t).select("entry", "seq", "name")).drop("entry", "seq")


@query("timestomp_flag",
       "SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_shipdate < o_orderdate THEN 'Y' ELSE '' END AS flag "
       "FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def _(t):
    joined = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        scalars.timestomp_flag(F.col("l_shipdate"), F.col("o_orderdate")).alias("flag"),
    )
