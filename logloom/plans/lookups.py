"""Registered queries: whole lists of moments, terms and values looked up at
once, and whole summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import annotate
from ..operators import grouping, nearest, predicates, search, view
from ..session import scratch_path
from .catalog import TAGS_SQL, query


@query("nearest_timestamps",
       "WITH held AS (SELECT event_id + 1 AS rid, date_trunc('second', ts) AS m FROM events WHERE event_type = 'click'), "
       "probes AS (SELECT event_id AS probe, date_trunc('second', ts) AS m FROM events WHERE event_type = 'error'), "
       "pairs AS (SELECT probe, rid, held.m, abs(date_diff('second', probes.m, held.m)) AS d FROM probes, held) "
       "SELECT probe, rid, strftime(m, '%Y-%m-%d %H:%M:%S') AS ts, d AS distance_seconds FROM pairs "
       "QUALIFY row_number() OVER (PARTITION BY probe ORDER BY d, rid) = 1")
def _(t):
    probes = t.events.where("event_type = 'error'").select(F.col("event_id").alias("probe"), "ts").withColumnRenamed("ts", "moment")
    return nearest.nearest_timestamps(t.events.where("event_type = 'click'"), probes).drop("moment", "source_id")


@query("nearest_timestamps_columns",
       "WITH held AS (SELECT o_orderkey + 1 AS rid, unnest([o_orderdate, o_orderdate + INTERVAL (7 + o_custkey % 90) DAY]) AS m FROM orders), "
       "probes AS (SELECT DISTINCT l_shipdate AS m FROM lineitem), "
       "firsts AS (SELECT m, min(rid) AS rid FROM held GROUP BY m), "
       "pairs AS (SELECT probes.m AS shipped, rid, firsts.m, abs(date_diff('second', probes.m, firsts.m)) AS d FROM probes, firsts), "
       "best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY shipped ORDER BY d, rid, m) = 1) "
       "SELECT strftime(l_shipdate, '%m/%d/%Y') AS shipped, count(*) AS lines, any_value(rid) AS rid, "
       "any_value(strftime(m, '%Y-%m-%d %H:%M:%S')) AS ts, any_value(d) AS distance_seconds "
       "FROM lineitem JOIN best ON shipped = l_shipdate GROUP BY 1")
def _(t):
    rows = t.text(
        "orders", placed="cast(o_orderdate as string)",
        due="date_format(o_orderdate + make_dt_interval(7 + o_custkey % 90), 'M/d/yyyy h:mm:ss a')",
    )
    probes = t.raw("lineitem").select(F.date_format("l_shipdate", "MM/dd/yyyy").alias("shipped"))
    found = nearest.nearest_timestamps(annotate(rows, {"placed": "datetime", "due": "datetime"}), probes, "shipped")
    return found.groupBy("shipped").agg(
        F.count(F.lit(1)).alias("lines"), *[F.min(c).alias(c) for c in ("rid", "ts", "distance_seconds")]
    )


WORDS_SQL = "terms AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS term FROM benchmark)"
DOCUMENT_BLOB = "concat_ws(' ', doc_id::VARCHAR, text, lang, source, n_chars::VARCHAR)"


def _words(t):
    return t.raw("benchmark").select(F.explode(F.split("text", r"\s+")).alias("term"))


@query("match_term_table",
       f"WITH {WORDS_SQL}, blobs AS (SELECT doc_id, lower({DOCUMENT_BLOB}) AS b FROM documents) "
       "SELECT term, count(*) AS rows, CAST(sum(doc_id) AS BIGINT) AS ids FROM blobs, terms "
       "WHERE (length(term) > 8 OR term = 'a') AND contains(b, lower(term)) GROUP BY term")
def _(t):
    postings = search.write_postings(t.documents, scratch_path(t.spark, "postings"))
    hits = search.match_term_table(t.documents, postings, _words(t).where("length(term) > 8 OR term = 'a'"))
    return hits.groupBy("term").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("rid") - 1).alias("ids"))


@query("search_all_by_term_table",
       f"WITH {WORDS_SQL}, blobs AS (SELECT 6 AS source_id, lower({DOCUMENT_BLOB}) AS b FROM documents UNION ALL "
       "SELECT 7, lower(concat_ws(' ', page_id::VARCHAR, url, html)) FROM pages) "
       "SELECT source_id, term, least(count(*), 40) AS match_count, count(*) > 40 AS capped FROM blobs, terms "
       "WHERE length(term) > 8 AND contains(b, lower(term)) GROUP BY source_id, term")
def _(t):
    indexed = {
        sid: (rows, search.write_postings(rows, scratch_path(t.spark, "postings"))) for sid, rows in ((6, t.documents), (7, t.pages))
    }
    return search.search_all_by_term_table(indexed, _words(t).where(F.length("term") > 8), cap=40)


TREE_SQL = """
    SELECT *, CAST(row_number() OVER (PARTITION BY level, {parent} ORDER BY count DESC, {own}) AS INT) AS position,
           count(*) OVER (PARTITION BY level, {parent}) > {limit} AS truncated
    FROM (SELECT {level} AS level, {columns}, count(*) AS count FROM {source} GROUP BY {group})
    QUALIFY position <= {limit}"""


@query("group_tree", f"""
WITH held AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, user_id FROM events),
one AS ({TREE_SQL.format(parent="1", own="event_type", limit=4, level=1, columns="event_type, NULL AS day, NULL AS user_id", source="held", group="event_type")}),
two AS ({TREE_SQL.format(parent="event_type", own="day", limit=4, level=2, columns="event_type, day, NULL AS user_id", source="held SEMI JOIN one USING (event_type)", group="event_type, day")}),
three AS ({TREE_SQL.format(parent="event_type, day", own="user_id", limit=4, level=3, columns="event_type, day, user_id", source="held SEMI JOIN two USING (event_type, day)", group="event_type, day, user_id")})
SELECT level, event_type, day AS ts, user_id, count, position, truncated FROM one UNION ALL FROM two SELECT level, event_type, day, user_id, count, position, truncated
UNION ALL FROM three SELECT level, event_type, day, user_id, count, position, truncated""")
def _(t):
    return grouping.group_tree(t.events, ["event_type", "ts", "user_id"], limit=4)


@query("group_tree_tags", f"""
WITH {TAGS_SQL}, held AS (SELECT o_orderkey + 1 AS rid, o_orderstatus FROM orders),
tagged AS (SELECT held.*, tag_id FROM held LEFT JOIN (SELECT rid, tag_id FROM tags WHERE source_id = 1) USING (rid)),
levels AS (
    SELECT 1 AS level, o_orderstatus, NULL AS tag_id, count(*) AS count FROM held GROUP BY o_orderstatus
    UNION ALL SELECT 2, o_orderstatus, tag_id, count(*) FROM tagged GROUP BY o_orderstatus, tag_id)
SELECT level, o_orderstatus, tag_id AS tag, count, false AS truncated,
       CAST(row_number() OVER (PARTITION BY level, CASE level WHEN 2 THEN o_orderstatus END ORDER BY count DESC,
           CASE level WHEN 1 THEN o_orderstatus END, tag_id NULLS FIRST) AS INT) AS position
FROM levels""")
def _(t):
    tree = grouping.group_tree(t.orders, ["o_orderstatus", grouping.TAG_COLUMN], tags=t.tags)
    return tree.withColumnRenamed(grouping.TAG_COLUMN, "tag")


@query("top_values",
       "SELECT o_custkey % 97 AS value, count(*) AS count, true AS truncated FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def _(t):
    rows = t.orders.select("source_id", "rid", (F.col("o_custkey") % 97).alias("customer"))
    return grouping.top_values(rows, "customer", 30)


@query("top_values_open",
       "SELECT o_custkey AS value, count(*) AS count, true AS truncated FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def _(t):
    # Too even for the summary to prove anything: all values are counted.
    return grouping.top_values(t.orders, "o_custkey", 25, tracked=100)


@query("filter_in_list",
       "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')")
def _(t):
    wanted = t.raw("orders").where("o_orderpriority = '5-LOW'").select("o_orderkey")
    return predicates.where_in(t.raw("lineitem"), "l_orderkey", wanted).select("l_orderkey", "l_linenumber")


@query("filter_in_long",
       "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey < 15000 AND o_orderstatus = 'O'")
def _(t):
    listed = "\n".join(str(n) for n in range(1, 15_000, 3))
    spec = {"filters": [{"column": "o_orderkey", "op": "in", "value": listed}, {"column": "o_orderstatus", "op": "equals", "value": "O"}]}
    return view.apply_spec(t.orders, spec).select("o_orderkey")


@query("search_all_capped",
       "WITH hits AS (SELECT 1 AS source_id FROM orders WHERE concat_ws(' ', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, "
       "o_totalprice::VARCHAR, o_orderdate::VARCHAR, o_orderpriority) ILIKE '%urgent%' UNION ALL "
       "SELECT 3 FROM customer WHERE c_mktsegment ILIKE '%urgent%' OR c_name ILIKE '%urgent%' UNION ALL "
       f"SELECT 6 FROM documents WHERE {DOCUMENT_BLOB} ILIKE '%urgent%') "
       "SELECT source_id, least(count(*), 150) AS match_count, count(*) > 150 AS capped FROM hits GROUP BY 1")
def _(t):
    return search.search_all({1: t.orders, 3: t.customer, 6: t.documents}, "urgent", cap=150)
