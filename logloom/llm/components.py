"""Connected components of an edge table by alternating stars.

The large star links every larger neighbour of a node to the smallest node it
sees, the small star every smaller one; repeated, they leave one star around the
smallest node of each component.  Each round is written to the shared folder,
and nothing but a count and a checksum of the edges comes to the driver; only
few edges are left to Spark to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS
from .common import materialise


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("sum")).first()
    return row["n"], row["sum"] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that is not the smallest of its component.

    ``edges`` has two bigint columns; loops and repeated edges do not matter,
    and without edges the result is empty.  A node that is not listed is the
    smallest, or the only one, of its component."""
    a, b = (F.col(c) for c in edges.columns)
    current = materialise(
        edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges"
    )
    before = _state(current)

    def beside(nodes: DataFrame) -> DataFrame:
        # Stars compress so well that many edges look small to Spark.
        return nodes.hint("merge") if before[0] > BROADCAST_ROWS else nodes

    while before[0]:
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        seen = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(beside(seen), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        linked = large.join(beside(lowest), "hi")
        small = linked.select("hi", F.col("m").alias("lo")).unionByName(
            linked.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        )
        current = materialise(small.distinct(), "edges")
        after = _state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
