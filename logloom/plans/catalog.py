"""The registered queries and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ref
from ..operators.timeline import Source
from ..session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables as sources: ``rid`` from the key column, from 1."""

    KEYS = {
        "orders": ("o_orderkey", 1), "events": ("event_id", 2), "customer": ("c_custkey", 3),
        "part": ("p_partkey", 4), "supplier": ("s_suppkey", 5), "documents": ("doc_id", 6),
        "pages": ("page_id", 7), "benchmark": ("item_id", 8), "nation": ("n_nationkey", 10),
    }

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def __getattr__(self, table: str) -> DataFrame:
        """A table with ``source_id`` and ``rid`` in front."""
        if table not in self.KEYS:
            raise AttributeError(table)
        key, source_id = self.KEYS[table]
        df = self.raw(table)
        return df.select(
            F.lit(source_id).cast("int").alias("source_id"), (ref(key).cast("bigint") + 1).alias("rid"), "*"
        )

    @property
    def conversations(self) -> DataFrame:
        """Turns of a conversation; the pair (conv_id, turn) becomes the rid."""
        df = self.raw("conversations")
        return df.select(
            F.lit(9).cast("int").alias("source_id"),
            (F.col("conv_id") * 1000 + F.col("turn") + 1).cast("bigint").alias("rid"), "*",
        )

    def source(self, table: str) -> Source:
        return Source(self.KEYS[table][1], table, getattr(self, table).drop("source_id"))

    def text(self, table: str, **columns) -> DataFrame:
        """Keys plus text columns given as SQL expressions."""
        return getattr(self, table).select(
            "source_id", "rid", *[F.expr(e).alias(n) for n, e in columns.items()]
        )

    # Annotations everyone can derive from the tables.

    @property
    def tags(self) -> DataFrame:
        orders = self.orders.select(
            "source_id", "rid",
            F.explode(F.array_compact(F.array(
                F.when(F.col("o_orderpriority") == "1-URGENT", 1),
                F.when(F.col("o_totalprice") > 400000, 2),
                F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 100000), 3),
            ))).alias("tag_id"),
        )
        events = self.events.select(
            "source_id", "rid",
            F.explode(F.array_compact(F.array(
                F.when(F.col("event_type") == "error", 1), F.when(F.col("value") > 200, 2),
            ))).alias("tag_id"),
        )
        return orders.unionByName(events)

    @property
    def notes(self) -> DataFrame:
        return self.orders.where("o_totalprice > 450000").select(
            "source_id", "rid", F.concat(F.lit("check "), F.col("o_orderpriority")).alias("note")
        )

    @property
    def tag_defs(self) -> DataFrame:
        return self.spark.createDataFrame(
            [(1, "Urgent", "#c0392b", "1"), (2, "big", "#d68a2e", "2"), (3, "Aside", "#5d8a66", "3"),
             (4, "unused", "#888888", None)],
            "id int, name string, color string, hotkey string",
        )


TAGS_SQL = """tags AS (
    SELECT 1 AS source_id, o_orderkey + 1 AS rid, 1 AS tag_id FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 1, o_orderkey + 1, 2 FROM orders WHERE o_totalprice > 400000
    UNION ALL SELECT 1, o_orderkey + 1, 3 FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 100000
    UNION ALL SELECT 2, event_id + 1, 1 FROM events WHERE event_type = 'error'
    UNION ALL SELECT 2, event_id + 1, 2 FROM events WHERE value > 200
)"""
NOTES_SQL = """notes AS (
    SELECT 1 AS source_id, o_orderkey + 1 AS rid, 'check ' || o_orderpriority AS note
    FROM orders WHERE o_totalprice > 450000
)"""
TAG_DEFS_SQL = """tag_defs AS (
    SELECT * FROM (VALUES (1, 'Urgent'), (2, 'big'), (3, 'Aside'), (4, 'unused')) v(id, name)
)"""


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its oracle."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
