"""Exact top-k search with one KD-tree per shard.

Vectors become integers, the score is their inner product.  Each shard's tree
splits at the median of the widest side and keeps tight bounding boxes; a query
visits boxes best first, by the largest score any point of the box could have,
and leaves off when that is below its k-th score so far.

Shards are regions of space: the upper levels of a KD-tree, fitted on
at most ``SAMPLE_ROWS`` vectors picked by hash, deal all vectors, and a region with more
than ``SHARD_ROWS`` of them (many copies of one vector, say) is several shards.
Queries of one region form blocks of at most ``QUERY_ROWS``.  A block starts in
its own region; with the k-th scores found there it meets the shards' boxes, and
only shards whose box can still matter to one of its queries are visited, with
the k-th scores at hand.  Shards and blocks are rows of written tables, and a
task handles one (block, shard) pair at a time.

Defined results: vectors that are null or empty or hold a null or non-finite
component take no part, nor does a null id as a query; only vectors of the same length
are compared; ties go to the smaller id; rows that repeat an id are candidates
of their own, and as queries they are one, with the best scores of its vectors;
scores are exact below 2**63; a table without queries gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_below, finite_vector, materialise, materialise_blocks, query, table

SHARD_ROWS = 8192
QUERY_ROWS = 512
LEAF_ROWS = 256
SAMPLE_ROWS = 16_384
REGION_SAMPLE = 128  # vectors drawn for a region, as far as the sample goes
REGION_ROWS = 16  # sample vectors of a region at least
BOXES = 1024  # shards whose boxes a block meets at once


def build_tree(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, low, high): points permuted so that every node is a run;
    a node is (first, end, left child, right child), leaves have no children."""
    order = np.arange(len(points))
    nodes: list[list[int]] = []
    low, high = [], []
    stack = [(0, len(points), -1, 0)]
    while stack:
        first, end, parent, side = stack.pop()
        held = points[order[first:end]]
        box = held.min(axis=0), held.max(axis=0)
        number = len(nodes)
        nodes.append([first, end, -1, -1])
        low.append(box[0])
        high.append(box[1])
        if parent >= 0:
            nodes[parent][2 + side] = number
        widths = box[1] - box[0]
        if end - first <= leaf_rows or not widths.size or not widths.max():
            continue
        axis = int(widths.argmax())
        middle = (end - first) // 2
        order[first:end] = order[first:end][np.argpartition(held[:, axis], middle)]
        stack += [(first, first + middle, number, 0), (first + middle, end, number, 1)]
    return order, np.array(nodes, np.int32), np.array(low), np.array(high)


def search_tree(
    points: np.ndarray, ids: np.ndarray, nodes: np.ndarray, low: np.ndarray, high: np.ndarray,
    queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, k: int,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, and ids and scores of what may be among its
    ``k`` best given that ``k`` others score ``least`` already."""
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    children = nodes.tolist()
    for q in range(len(queries)):
        bound, vector, own = bounds[q].tolist(), queries[q], query_ids[q]
        kth = least[q]
        best_scores, best_ids = np.zeros(0, points.dtype), np.zeros(0, np.int64)
        heap = [(-bound[0], 0)]
        while heap:
            top, number = heapq.heappop(heap)
            if -top < kth:
                break
            first, end, left, right = children[number]
            if left >= 0:
                for child in (left, right):
                    if bound[child] >= kth:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            scores = points[first:end] @ vector
            hit = np.flatnonzero((scores >= kth) & (ids[first:end] != own))
            if not len(hit):
                continue
            best_scores = np.concatenate([best_scores, scores[hit]])
            best_ids = np.concatenate([best_ids, ids[first:end][hit]])
            if len(best_scores) > k:
                order = np.lexsort((best_ids, -best_scores))[:k]
                best_scores, best_ids = best_scores[order], best_ids[order]
            if len(best_scores) == k:
                kth = max(kth, best_scores.min())
        yield q, best_ids, best_scores


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles where the largest possible score is exact in a double."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a.astype(float), b.astype(float)) if reach < 2**52 else (a, b)


def _pack(points: np.ndarray) -> bytes:
    return np.ascontiguousarray(points, np.int64).tobytes()


def whole_numbers(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def _dense(table_: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table_.column("vec_id").to_numpy()
    flat = table_.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)


@dataclass(frozen=True)
class Regions:
    """The upper levels of a KD-tree: (axis, threshold, left, right) per node; a
    negative child -1 - r is region r."""

    nodes: list[tuple[int, int, int, int]]
    count: int

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))] if self.nodes else []
        while todo:
            number, at = todo.pop()
            if number < 0:
                out[at] = -1 - number
                continue
            axis, threshold, left, right = self.nodes[number]
            below = points[at, axis] <= threshold
            todo += [(left, at[below]), (right, at[~below])]
        return out


def fit_regions(sample: np.ndarray, wanted: int) -> Regions:
    """Median splits of the widest side, of the fullest region first, until
    there are ``wanted`` regions or too few sample vectors to split."""
    held: list[np.ndarray | None] = [sample]
    parts = [(-len(sample), 0, -1, 0)]  # size, region, node above, side
    nodes: list[list[int]] = []
    while parts and len(held) < min(wanted, max(1, len(sample) // REGION_ROWS)):
        _, region, above, side = heapq.heappop(parts)
        points = held[region]
        widths = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(0)
        if not widths.size or not widths.max():
            continue  # copies of one vector
        axis = int(widths.argmax())
        threshold = int(np.sort(points[:, axis])[(len(points) - 1) // 2])
        below = points[:, axis] <= threshold
        if below.all():
            threshold -= 1
            below = points[:, axis] <= threshold
        if above >= 0:
            nodes[above][2 + side] = len(nodes)
        number, other = len(nodes), len(held)
        nodes.append([axis, threshold, -1 - region, -1 - other])
        held[region] = points[below]
        held.append(points[~below])
        heapq.heappush(parts, (-len(held[region]), region, number, 0))
        heapq.heappush(parts, (-len(held[other]), other, number, 1))
    return Regions([tuple(n) for n in nodes], len(held))


def _dealt(rows: DataFrame, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (dim, vec_id, v) with their region, and (dim, region, first,
    shards): the shard numbers of every region."""
    regions: dict[int, Regions] = {}
    for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per vector length
        # Half a shard on average, so that few regions need more than one.
        wanted = 1 if r["n"] <= shard_rows else -(-2 * r["n"] // shard_rows)
        sample = [] if wanted == 1 else rows.where(F.col("dim") == r["dim"]).select("v").orderBy(F.xxhash64("v", "vec_id")).limit(min(SAMPLE_ROWS, wanted * REGION_SAMPLE)).collect()
        regions[r["dim"]] = fit_regions(np.array([x["v"] for x in sample], np.int64).reshape(len(sample), r["dim"]), wanted)

    @F.arrow_udf("bigint")
    def region_of(vectors: pa.Array) -> pa.Array:
        sizes, flat = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False)
        starts, out = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.zeros(len(sizes), np.int64)
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            out[at] = regions[dim].of(flat[starts[at][:, None] + np.arange(dim)])
        return pa.array(out)

    placed = materialise(rows.withColumn("region", region_of("v")), "kd-dealt")
    # A row per region: their number is bounded by the sample.
    sizes = placed.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))
    before = Window.partitionBy("dim").orderBy("region").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sizes.withColumn("first", F.coalesce(F.sum("shards").over(before), F.lit(0)))
    return placed, F.broadcast(materialise(numbered, "kd-regions"))


def build_shards(vectors: DataFrame, regions: DataFrame) -> DataFrame:
    """One row per (dim, shard): the permuted points and their tree."""

    def build(group: pa.Table) -> pa.Table:
        ids, points = _dense(group)
        order, nodes, low, high = build_tree(points)
        return pa.table({
            "dim": [points.shape[1]], "shard": [group.column("shard")[0].as_py()], "n": [len(ids)],
            "ids": [ids[order].tobytes()], "points": [_pack(points[order])], "nodes": [nodes.tobytes()],
            "low": [_pack(low)], "high": [_pack(high)],
        }, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()),
                             ("points", pa.binary()), ("nodes", pa.binary()), ("low", pa.binary()), ("high", pa.binary())]))

    shard = F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("shards"))
    dealt = vectors.join(regions, ["dim", "region"]).select("dim", shard.alias("shard"), "vec_id", "v")
    parts = regions.agg(F.sum("shards").alias("n")).first()["n"] or 1
    return materialise_blocks(
        dealt.repartition(max(parts, 1), "dim", "shard").groupBy("dim", "shard").applyInArrow(
            build, "dim int, shard bigint, n bigint, ids binary, points binary, nodes binary, low binary, high binary"),
        "kd-shards",
    )


BLOCK = "dim int, region bigint, block bigint, n bigint, ids binary, points binary, least binary"
FOUND = "query_id bigint, vec_id bigint, score bigint"


def _query_blocks(queries: DataFrame, query_rows: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of queries of one region, and the block of every query."""
    def pack(group: pa.Table) -> pa.Table:
        ids, points = _dense(group)
        floor = np.full(len(ids), np.iinfo(np.int64).min, np.int64)
        return pa.table({
            "dim": [points.shape[1]], "region": [group.column("region")[0].as_py()], "block": [group.column("block")[0].as_py()],
            "n": [len(ids)], "ids": [ids.tobytes()], "points": [_pack(points)], "least": [floor.tobytes()],
        }, schema=pa.schema([("dim", pa.int32()), ("region", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()),
                             ("points", pa.binary()), ("least", pa.binary())]))

    sizes = queries.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / query_rows).alias("blocks"))
    before = Window.partitionBy(F.lit(0)).orderBy("dim", "region").rowsBetween(Window.unboundedPreceding, -1)  # a row per region
    numbered = F.broadcast(materialise(sizes.withColumn("offset", F.coalesce(F.sum("blocks").over(before), F.lit(0))), "kd-blocks"))
    block = F.col("offset") + F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("blocks"))
    dealt = materialise(queries.join(numbered, ["dim", "region"]).select("dim", "region", block.alias("block"), "vec_id", "v"), "kd-asked")
    blocks = materialise_blocks(dealt.groupBy("block").applyInArrow(pack, BLOCK), "kd-queries")
    return blocks, dealt.select(F.col("vec_id").alias("query_id"), "block").distinct()


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                raw, asked = (np.frombuffer(r[c], np.int64).reshape(-1, r["dim"]) for c in ("points", "q_points"))
                points, queries = _exact(raw, asked)
                shape = (-1, r["dim"])
                low, high = (np.frombuffer(r[c], np.int64).reshape(shape).astype(points.dtype) for c in ("low", "high"))
                ids, query_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                nodes = np.frombuffer(r["nodes"], np.int32).reshape(-1, 4)
                least = np.frombuffer(r["least"], np.int64)
                found = list(search_tree(points, ids, nodes, low, high, queries, query_ids, least, k))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(query_ids, [len(x[1]) for x in found])),
                    pa.array(np.concatenate([x[1] for x in found])),
                    pa.array(np.concatenate([x[2] for x in found]).astype(np.int64)),
                ], ["query_id", "vec_id", "score"])

    return run


def _raise_floor(blocks: DataFrame, block_of: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``blocks`` with each query's k-th score so far: found rows of a block are
    put back into the block's order.  A block has a bounded number of queries."""
    kth = (
        found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
        .where(F.col("r") == k).select("query_id", "score")
    )

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        scores = dict(zip(right.column("query_id").to_pylist(), right.column("score").to_pylist()))
        raised = []  # a block number has a row for each vector length
        for ids, floors in zip(left.column("ids").to_pylist(), left.column("least").to_pylist()):
            least = np.frombuffer(floors, np.int64).copy()
            for i, q in enumerate(np.frombuffer(ids, np.int64).tolist()):
                least[i] = max(least[i], scores.get(q, least[i]))
            raised.append(least.tobytes())
        return left.set_column(left.schema.get_field_index("least"), "least", pa.array(raised, pa.binary()))

    # An id that several vectors have can be in several blocks.
    return blocks.groupBy("block").cogroup(kth.join(block_of, "query_id").groupBy("block")).applyInArrow(put, BLOCK)


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, shard) where the shard's box may hold a score that one of the
    block's queries needs."""
    for batch in batches:
        for r in batch.to_pylist():
            low, high = (np.frombuffer(b"".join(r[c]), np.int64).reshape(-1, r["dim"]) for c in ("low", "high"))
            queries = np.frombuffer(r["points"], np.int64).reshape(-1, r["dim"])
            (low, exact), (high, _) = _exact(low, queries), _exact(high, queries)
            bounds = np.maximum(exact, 0) @ high.T + np.minimum(exact, 0) @ low.T
            needed = (bounds >= np.frombuffer(r["least"], np.int64)[:, None]).any(axis=0)
            shards = np.array(r["shards"], np.int64)[needed]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(shards), r["dim"], np.int32)), pa.array(np.full(len(shards), r["block"])), pa.array(shards)], ["dim", "block", "shard"]
            )


def reached_pairs(blocks: DataFrame, shards: DataFrame) -> DataFrame:
    """(dim, block, shard) that are worth a visit.  A block meets the boxes of
    ``BOXES`` shards at a time; no vector is read."""
    edge = F.col("dim") * 8
    boxes = shards.select("dim", "shard", F.substring("low", F.lit(1), edge).alias("low"), F.substring("high", F.lit(1), edge).alias("high"))
    packed = materialise_blocks(
        boxes.groupBy("dim", F.call_function("div", F.col("shard"), F.lit(BOXES)).alias("part")).agg(
            F.array_sort(F.collect_list(F.struct("shard", "low", "high"))).alias("b")
        ).select("dim", "part", F.col("b.shard").alias("shards"), F.col("b.low").alias("low"), F.col("b.high").alias("high")), "kd-boxes",
    )
    parts = packed.groupBy("dim").agg(F.max("part").alias("parts"))  # a row per vector length
    asked = blocks.join(F.broadcast(parts), "dim").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts"))))
    met = asked.select("dim", "part", "block", "points", "least").join(broadcast_below(packed, F.size("shards") * F.col("dim") * 16), ["dim", "part"])
    return materialise(met.mapInArrow(_reached, "dim int, block bigint, shard bigint"), "kd-pairs")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``vectors`` has vec_id and v (array<bigint>, without nulls); returns
    query_id, rank, vec_id and score."""
    spark = vectors.sparkSession
    rows = vectors.withColumn("dim", F.size("v")).where("dim > 0").select("dim", "vec_id", "v", is_query.alias("asks"))
    rows, regions = _dealt(materialise(rows, "kd-vectors"), shard_rows)
    shards = build_shards(rows, regions)
    asked = rows.where("asks").dropDuplicates(["vec_id", "v"])
    blocks, block_of = _query_blocks(asked, query_rows)
    renamed = [F.col(c).alias(f"q_{c}") for c in ("n", "ids", "points")]
    tasks = 8 * spark.sparkContext.defaultParallelism

    def visit(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """Search the shards of (dim, block, shard) pairs."""
        held = of.select("dim", "block", *renamed, "least").join(pairs, ["dim", "block"])
        n = max(1, min(pairs.count(), tasks))
        return held.join(shards, ["dim", "shard"]).repartition(n).mapInArrow(_search(k), FOUND)

    # A block's home is a shard of its region; blocks of one region take turns.
    home = F.col("first") + F.col("block") % F.col("shards")
    homes = materialise(blocks.select("dim", "region", "block").join(regions, ["dim", "region"]).select("dim", "block", home.alias("shard")), "kd-homes")
    first = materialise(visit(homes, blocks), "kd-found")
    raised = materialise_blocks(_raise_floor(blocks, block_of, first, k), "kd-queries")
    others = reached_pairs(raised, shards).join(homes, ["dim", "block", "shard"], "left_anti")
    rest = visit(materialise(others, "kd-visits"), raised)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


@query("op4_kdtree_topk", SQL)
def op4_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(finite_vector(F.col("embedding")) & F.col("vec_id").isNotNull())
    return top_k(rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), whole_numbers(F.col("embedding")).alias("v")), F.col("vec_id") % 20 == 0)
