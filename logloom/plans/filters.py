"""Filters, search, views and paging over the given tables."""

from pyspark.sql import functions as F

from ..functions.columns import annotate
from ..operators import predicates as p
from ..operators import search, view
from ..operators.derived import add_derived
from ..operators.ids import with_position, with_row_id
from ..session import scratch_path
from .catalog import NOTES_SQL, TAGS_SQL, query

PART = "p_partkey, p_name, p_brand"
ORDER = "o_orderkey, o_orderstatus, o_totalprice"


@query("filter_contains", f"SELECT {PART} FROM part WHERE p_name ILIKE '%RING%'")
def _(t):
    return p.where_op(t.part, "p_name", "contains", "RING").selectExpr(*PART.split(", "))


# Priorities with gaps: NULL, empty and filled cells.
GAPPY = "CASE o_orderpriority WHEN '5-LOW' THEN '' WHEN '2-HIGH' THEN NULL ELSE o_orderpriority END"


@query("filter_not_contains",
       f"SELECT o_orderkey, prio FROM (SELECT o_orderkey, {GAPPY} AS prio FROM orders) "
       "WHERE prio NOT ILIKE '%urgent%' OR prio IS NULL")
def _(t):
    rows = t.text("orders", o_orderkey="o_orderkey", prio=GAPPY)
    return p.where_op(rows, "prio", "not_contains", "urgent").select("o_orderkey", "prio")


@query("filter_equals", f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    return p.where_op(t.orders, "o_orderstatus", "equals", "P").selectExpr(*ORDER.split(", "))


@query("filter_not_equals",
       f"SELECT o_orderkey, prio FROM (SELECT o_orderkey, {GAPPY} AS prio FROM orders) "
       "WHERE prio <> '1-URGENT' OR prio IS NULL")
def _(t):
    rows = t.text("orders", o_orderkey="o_orderkey", prio=GAPPY)
    return p.where_op(rows, "prio", "not_equals", "1-URGENT").select("o_orderkey", "prio")


@query("filter_starts", f"SELECT {PART} FROM part WHERE p_name ILIKE 'Blue%'")
def _(t):
    return p.where_op(t.part, "p_name", "starts", "Blue").selectExpr(*PART.split(", "))


@query("filter_regex", f"SELECT {PART} FROM part WHERE regexp_matches(p_name, '^(RED|blue) .*t$', 'i')")
def _(t):
    return p.where_op(t.part, "p_name", "regex", "^(RED|blue) .*t$").selectExpr(*PART.split(", "))


@query("filter_regex_invalid", f"SELECT {PART} FROM part WHERE false")
def _(t):
    return p.where_op(t.part, "p_name", "regex", "(unclosed").selectExpr(*PART.split(", "))


@query("filter_compare", f"SELECT {ORDER} FROM orders WHERE o_totalprice >= 400000 AND o_totalprice < 450000.5")
def _(t):
    low = p.where_op(t.orders, "o_totalprice", ">=", "400000")
    return p.where_op(low, "o_totalprice", "<", "450000.5").selectExpr(*ORDER.split(", "))


# Sizes as text, some of them no number: they must drop out, not count as zero.
MIXED = "CASE WHEN p_size > 45 THEN 'N/A' WHEN p_size < 3 THEN '' ELSE CAST(p_size AS VARCHAR(9)) END"


@query("filter_compare_text_number",
       f"SELECT p_partkey, size FROM (SELECT p_partkey, {MIXED} AS size FROM part) WHERE try_cast(size AS DOUBLE) <= 9")
def _(t):
    rows = annotate(t.text("part", p_partkey="p_partkey", size=MIXED.replace("VARCHAR(9)", "STRING")), {"size": "number"})
    return p.where_op(rows, "size", "<=", "9").select("p_partkey", "size")


@query("filter_empty",
       f"SELECT o_orderkey FROM (SELECT o_orderkey, {GAPPY} AS prio FROM orders) WHERE coalesce(prio, '') = ''")
def _(t):
    rows = t.text("orders", o_orderkey="o_orderkey", prio=GAPPY)
    return p.where_op(rows, "prio", "empty").select("o_orderkey")


@query("filter_not_empty",
       f"SELECT o_orderkey, prio FROM (SELECT o_orderkey, {GAPPY} AS prio FROM orders) WHERE coalesce(prio, '') <> ''")
def _(t):
    rows = t.text("orders", o_orderkey="o_orderkey", prio=GAPPY)
    return p.where_op(rows, "prio", "not_empty").select("o_orderkey", "prio")


@query("filter_in", f"SELECT {ORDER} FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(t):
    return p.where_op(t.orders, "o_orderpriority", "in", "1-URGENT\n2-HIGH\n").selectExpr(*ORDER.split(", "))


TREE = {
    "type": "group", "op": "AND", "children": [
        {"type": "cond", "column": "o_totalprice", "op": ">", "value": "250000"},
        {"type": "group", "op": "OR", "children": [
            {"type": "cond", "column": "o_orderstatus", "op": "equals", "value": "F"},
            {"type": "cond", "column": "o_orderpriority", "op": "contains", "value": "urgent"},
            {"type": "cond", "column": "no_such_column", "op": "equals", "value": "x"},
            {"type": "raw", "sql": "o_custkey BETWEEN 10 AND 20"},
        ]},
    ],
}


@query("filter_tree",
       f"SELECT {ORDER} FROM orders WHERE o_totalprice > 250000 AND "
       "(o_orderstatus = 'F' OR o_orderpriority ILIKE '%urgent%' OR o_custkey BETWEEN 10 AND 20)")
def _(t):
    return p.filter_tree(t.orders, TREE).selectExpr(*ORDER.split(", "))


@query("where_expr",
       f"SELECT {ORDER} FROM orders WHERE o_totalprice > 300000 AND (o_orderstatus = 'F' OR o_custkey < 100)")
def _(t):
    return p.where_expr(
        t.orders, "o_totalprice > 300000 AND (o_orderstatus = 'F' OR o_custkey < 100)"
    ).selectExpr(*ORDER.split(", "))


@query("exclude_rows", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (2, 4, 9)")
def _(t):
    return p.exclude_rows(t.nation, [(10, 3), (10, 5), (10, 10), (99, 1)]).select("n_nationkey", "n_name")


@query("project", "SELECT 1 AS source_id, o_orderkey + 1 AS rid, o_orderkey::VARCHAR AS key, "
       "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS moment FROM orders")
def _(t):
    rows = t.text("orders", key="CAST(o_orderkey AS STRING)", raw="date_format(o_orderdate, 'yyyyMMddHHmmss')")
    derived = add_derived(rows, "moment", "raw", "compact_ymd")
    return p.project(derived.select("moment", "rid", "key", "source_id"))


@query("time_range",
       "SELECT event_id, event_type FROM events "
       "WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 12:00:01'")
def _(t):
    return p.time_range(t.events, "2024-01-10", "1/12/2024 12:00 PM").select("event_id", "event_type")


# Order dates as US text: month, day and hour without leading zeros.
US_SPARK = (
    "concat(month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate), ' ', "
    "CASE WHEN o_custkey % 12 = 0 THEN 12 ELSE o_custkey % 12 END, ':05:09', "
    "CASE WHEN o_custkey % 24 < 12 THEN ' AM' ELSE ' PM' END)"
)
US_MOMENT = "(o_orderdate + to_hours(CAST(o_custkey % 24 AS INTEGER)) + INTERVAL '5 minutes' + INTERVAL '9 seconds')"


@query("time_range_text",
       f"SELECT o_orderkey FROM orders WHERE {US_MOMENT} BETWEEN TIMESTAMP '1997-03-01 08:05:09' "
       "AND TIMESTAMP '1997-06-30 20:05:09'")
def _(t):
    rows = annotate(t.text("orders", o_orderkey="o_orderkey", seen=US_SPARK), {"seen": "datetime"})
    return p.time_range(rows, "3/1/1997 8:05:09 AM", "1997-06-30T20:05:09").select("o_orderkey")


@query("search_contains",
       "SELECT c_custkey FROM customer WHERE concat_ws(' ', c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, "
       "c_acctbal::VARCHAR, c_mktsegment) ILIKE '%7 customer#%'")
def _(t):
    return search.search_contains(t.customer, "7 customer#").select("c_custkey")


@query("search_regex", "SELECT doc_id FROM documents WHERE regexp_matches("
       "concat_ws(' ', doc_id::VARCHAR, text, lang, source, n_chars::VARCHAR), 'released\\s+under|e.?mail', 'i')")
def _(t):
    return search.search_regex(t.documents, r"released\s+under|e.?mail").select("doc_id")


TERMS = [
    {"term": "entry", "exclude": True}, {"term": "en src", "connector": "AND"},
    {"term": "License", "connector": "OR"}, {"term": "mit", "connector": "AND", "exclude": True},
]


@query("search_terms",
       "SELECT doc_id FROM (SELECT doc_id, concat_ws(' ', doc_id::VARCHAR, text, lang, source, n_chars::VARCHAR) b "
       "FROM documents) WHERE (b NOT ILIKE '%entry%' AND b ILIKE '%en src%') "
       "OR (b ILIKE '%license%' AND b NOT ILIKE '%mit%')")
def _(t):
    return search.search_terms(t.documents, TERMS).select("doc_id")


@query("match_terms",
       "SELECT doc_id, term FROM (SELECT doc_id, concat_ws(' ', doc_id::VARCHAR, text, lang, source, n_chars::VARCHAR) b "
       "FROM documents), (VALUES ('license'), ('@'), ('Password'), ('de src1')) v(term) WHERE contains(lower(b), lower(term))")
def _(t):
    hits = search.match_terms(t.documents, ["license", "@", "Password", "de src1", " license "])
    return hits.select((F.col("rid") - 1).alias("doc_id"), "term")


@query("indexed_search",
       "SELECT doc_id FROM documents WHERE concat_ws(' ', doc_id::VARCHAR, text, lang, source, n_chars::VARCHAR) "
       "ILIKE '%under the MIT License%'")
def _(t):
    postings = search.write_postings(t.documents, scratch_path(t.spark, "postings"))
    return search.indexed_search(t.documents, postings, "under the MIT license").select("doc_id")


SPEC = {
    "filters": [{"column": "o_orderstatus", "op": "in", "value": ["F", "O"]}],
    "filter_tree": {"type": "group", "op": "OR", "children": [
        {"type": "cond", "column": "o_totalprice", "op": "<", "value": "150000"},
        {"type": "cond", "column": "o_totalprice", "op": ">", "value": "300000"},
    ]},
    "search": "1997-0", "tags": ["1", "2"],
    "time_range": {"enabled": True, "start": "1997-02-01", "end": "1998-01-01"},
}


@query("apply_spec",
       f"WITH {TAGS_SQL} SELECT {ORDER} FROM orders WHERE o_orderstatus IN ('F', 'O') "
       "AND (o_totalprice < 150000 OR o_totalprice > 300000) AND CAST(o_orderdate AS VARCHAR) LIKE '%1997-0%' "
       "AND o_orderdate >= TIMESTAMP '1997-02-01' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:01' "
       "AND o_orderkey + 1 IN (SELECT rid FROM tags WHERE source_id = 1 AND tag_id IN (1, 2))")
def _(t):
    return view.apply_spec(t.orders, SPEC, t.tags).selectExpr(*ORDER.split(", "))


SORT = [{"column": "o_orderpriority", "dir": "desc"}, {"column": "o_totalprice", "dir": "asc"}]
SORT_SQL = "lower(o_orderpriority) DESC, o_totalprice ASC, o_orderkey ASC"


@query("sort_page",
       f"WITH {TAGS_SQL}, {NOTES_SQL}, ranked AS (SELECT *, row_number() OVER (ORDER BY {SORT_SQL}) AS pos FROM orders "
       "WHERE o_orderstatus = 'O'), sets AS (SELECT rid, string_agg(tag_id::VARCHAR, ',' ORDER BY tag_id) AS tag_ids "
       "FROM tags WHERE source_id = 1 GROUP BY rid) "
       "SELECT pos, o_orderkey, o_totalprice, coalesce(tag_ids, '') AS tag_ids, coalesce(note, '') AS note FROM ranked "
       "LEFT JOIN sets ON sets.rid = o_orderkey + 1 LEFT JOIN notes ON notes.rid = o_orderkey + 1 "
       "WHERE pos BETWEEN 101 AND 180")
def _(t):
    spec = {"filters": [{"column": "o_orderstatus", "op": "equals", "value": "O"}], "sort": SORT}
    ordered = view.build_view(t.orders, spec)
    rows = view.page(ordered, t.orders, 101, 80, t.tags, t.notes)
    return rows.select(
        "pos", "o_orderkey", "o_totalprice",
        F.array_join(F.transform("tag_ids", lambda x: x.cast("string")), ",").alias("tag_ids"),
        F.coalesce("note", F.lit("")).alias("note"),
    )


@query("sort_rows", f"SELECT o_orderkey, o_orderpriority FROM orders ORDER BY {SORT_SQL} LIMIT 500")
def _(t):
    return view.sort_rows(t.orders, SORT).select("o_orderkey", "o_orderpriority").limit(500)


@query("with_position",
       f"SELECT o_orderkey, row_number() OVER (ORDER BY {SORT_SQL}) AS pos FROM orders")
def _(t):
    return with_position(t.orders, view.sort_columns(t.orders, SORT)).select("o_orderkey", "pos")


@query("with_row_id",
       "SELECT l_orderkey, count(*) AS n, min(rid) AS first_rid, max(rid) AS last_rid FROM "
       "(SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) AS rid FROM lineitem) GROUP BY l_orderkey")
def _(t):
    lines = t.raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    order = [F.col(c) for c in lines.columns]
    numbered = with_row_id(lines, order)
    return numbered.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("rid").alias("first_rid"), F.max("rid").alias("last_rid")
    )


@query("page_by_rid", "SELECT o_orderkey, o_orderkey + 1 AS pos FROM orders WHERE o_orderkey + 1 BETWEEN 701 AND 950")
def _(t):
    return view.page_unsorted(t.orders, 1, 701, 250).select("o_orderkey", "pos")


@query("find_position",
       f"SELECT pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {SORT_SQL}) AS pos FROM orders) "
       "WHERE o_orderkey = 777")
def _(t):
    return view.find_position(view.build_view(t.orders, {"sort": SORT}), 1, 778)


@query("tag_positions",
       f"WITH {TAGS_SQL}, ranked AS (SELECT o_orderkey + 1 AS rid, row_number() OVER (ORDER BY {SORT_SQL}) AS pos FROM orders) "
       "SELECT pos, tag_id FROM ranked JOIN tags ON tags.rid = ranked.rid AND source_id = 1 ORDER BY pos, tag_id LIMIT 20000")
def _(t):
    return view.tag_positions(view.build_view(t.orders, {"sort": SORT}), t.tags)


@query("nearest_timestamp",
       "SELECT event_id + 1 AS rid, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, "
       "abs(date_diff('second', TIMESTAMP '2024-01-15 06:30:00', date_trunc('second', ts))) AS distance_seconds "
       "FROM events ORDER BY 3, 1 LIMIT 1")
def _(t):
    return view.nearest_timestamp(t.events, "1/15/2024 6:30 AM").drop("source_id")


FAR = 2**53  # from here on doubles skip whole numbers


@query("filter_exact_keys", f"SELECT o_orderkey + {FAR} AS far FROM orders WHERE o_orderkey IN (1, 3, 5) OR o_orderkey >= 1001 AND o_orderkey < 1003 AND o_orderkey <> 1002")
def _(t):
    rows = t.text("orders", far=f"o_orderkey + {FAR}L")
    equal = p.condition(rows, "far", "equals", str(FAR + 1)) | p.condition(rows, "far", "in", [str(FAR + 3), str(FAR + 5)])
    between = p.condition(rows, "far", ">=", str(FAR + 1001)) & p.condition(rows, "far", "<", str(FAR + 1003))
    return rows.where(equal | between & p.condition(rows, "far", "not_equals", str(FAR + 1002))).select("far")
