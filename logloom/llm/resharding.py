"""Resharding with the fewest bytes moved, by minimum-cost flow.

Documents lie in old shards; the new shards have capacities.  The old shards
are cut into blocks by a hash, so that the sizes of at most ``BLOCKS`` blocks of
each shard describe the whole corpus.  A minimum-cost flow from old sizes to
new capacities, in which staying costs nothing and moving a byte costs one,
says how many bytes go from where to where; blocks realise the flow.

Law of the query: ``bytes``, that is, shards of nearly equal size.  Blocks are
cut by the text, so equal texts stay together unless their block would fill a
shard.  Heavy blocks are counted in cells cut by the document: a block that
would fill a shard is placed cell by cell, and documents are numbered inside
their cell, the cells' counts shifting the numbers.  So neither a shard nor a
group of copies is ever gathered in one task.

Defined results: a null text has no bytes, size 1 and the CRC of no bytes;
repeated rows are documents of their own; a null id is a key like any other;
an empty table gives an empty result; only the named columns are read, and
``rewrite`` passes further columns on.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, query, table, text_or_empty

BLOCKS = 2048  # of each old shard
CELLS = 256  # of a heavy block
HEAVY = 8  # times the mean block
FULL = 0.9  # of an even shard: a heavier block is placed cell by cell
OLD_SHARDS = 6  # of the query


def shortest_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Minimum-cost flow between two sides by successive shortest paths.

    Ships all supply; ``sum(demand) >= sum(supply)``.  Costs are not negative.
    Shards are few, so the graph is small whatever the corpus holds."""
    m, n = len(supply), len(demand)
    flow = [[0] * n for _ in range(m)]
    left, room = list(supply), list(demand)
    potential = [0] * (m + n)
    while any(left):
        # Dijkstra over residual arcs from every shard that still has supply.
        dist, came = [float("inf")] * (m + n), [None] * (m + n)
        heap = []
        for i in range(m):
            if left[i]:
                dist[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if u < m:
                arcs = [(m + j, cost[u][j]) for j in range(n)]
            else:
                arcs = [(i, -cost[i][u - m]) for i in range(m) if flow[i][u - m]]
            for v, c in arcs:
                reduced = d + c + potential[u] - potential[v]
                if reduced < dist[v]:
                    dist[v], came[v] = reduced, u
                    heapq.heappush(heap, (reduced, v))
        ends = [j for j in range(n) if room[j] and dist[m + j] < float("inf")]
        if not ends:
            raise ValueError("the new shards cannot hold the old ones")
        # True path lengths: undo the potentials of both ends.
        end = min(ends, key=lambda j: dist[m + j] + potential[m + j])
        longest = max(d for d in dist if d < float("inf"))
        potential = [p + min(d, longest) for p, d in zip(potential, dist)]
        path, v = [], m + end
        while came[v] is not None:
            path.append((came[v], v))
            v = came[v]
        amount = min([left[v], room[end]] + [flow[b][a - m] for a, b in path if a >= m])
        for a, b in path:
            if a < m:
                flow[a][b - m] += amount
            else:
                flow[b][a - m] -= amount
        left[v] -= amount
        room[end] -= amount
    return flow


@dataclass(frozen=True)
class Block:
    """A unit that moves as one: a block, or a cell of one that is too large."""

    old: int
    block: int
    size: int


def assign_blocks(blocks: list[Block], old_shards: int, shards: int) -> dict[tuple[int, int], int]:
    """New shard of every block: the flow's bytes, in whole blocks.

    Large blocks are placed first, each where the flow from its old shard has
    most left; what whole blocks leave uneven is evened out block by block."""
    sizes = [0] * old_shards
    for b in blocks:
        sizes[b.old] += b.size
    total = sum(sizes)
    capacity = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    cost = [[0 if i == j else 1 for j in range(shards)] for i in range(old_shards)]
    open_flow = shortest_flow(sizes, capacity, cost)
    place, load = {}, [0] * shards
    for b in sorted(blocks, key=lambda b: (-b.size, b.old, b.block)):
        to = max(range(shards), key=lambda j: (open_flow[b.old][j], capacity[j] - load[j], -j))
        open_flow[b.old][to] -= b.size
        load[to] += b.size
        place[b.old, b.block] = to
    _even_out(blocks, place, load)
    return place


def _even_out(blocks: list[Block], place: dict[tuple[int, int], int], load: list[int]) -> None:
    """Move the block that fits best from the fullest to the emptiest shard
    while that brings the two closer."""
    held = [sorted((b.size, b.old, b.block) for b in blocks if place[b.old, b.block] == j) for j in range(len(load))]
    for _ in range(len(blocks)):
        full, empty = max(range(len(load)), key=load.__getitem__), min(range(len(load)), key=load.__getitem__)
        gap = load[full] - load[empty]
        fits = [x for x in held[full] if x[0] < gap]
        if not fits:
            return
        best = min(fits, key=lambda x: (abs(gap - 2 * x[0]), x))
        held[full].remove(best)
        held[empty].append(best)
        place[best[1], best[2]] = empty
        load[full] -= best[0]
        load[empty] += best[0]


@dataclass(frozen=True)
class Plan:
    """Where every cell goes; ``cells`` has old, cell, shard and first_slot, a
    number of rows bounded by the parameters."""

    cells: DataFrame
    heavy: tuple[int, ...]
    blocks: int
    changed: tuple[int, ...]  # shards that documents enter or leave

    def place(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("cell", cell_of(self.heavy, self.blocks)).join(F.broadcast(self.cells), ["old", "cell"])


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("text_crc32", "size"), F.lit(blocks))


def cell_of(heavy: tuple[int, ...], blocks: int) -> Column:
    block = _block(blocks)
    if not heavy:
        return block
    fine = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(1)), F.lit(CELLS))
    return F.when((F.col("old") * blocks + block).isin(list(heavy)), blocks + block * CELLS + fine).otherwise(block)


def plan_reshard(rows: DataFrame, old_shards: int, shards: int, blocks: int = BLOCKS) -> Plan:
    """``rows`` has doc_id, size, text_crc32 and old (below ``old_shards``).

    The driver holds the sizes of the cells: at most ``old_shards * blocks``,
    and ``CELLS`` for each of at most one block in ``HEAVY``."""
    coarse = materialise(rows.groupBy("old", _block(blocks).alias("block")).agg(F.sum("size").alias("size")), "reshard-blocks")
    total = coarse.agg(F.sum("size").alias("n")).first()["n"] or 0
    above = coarse.where(F.col("size") > HEAVY * total / (old_shards * blocks)).select("old", "block").collect()
    heavy = tuple(sorted(r["old"] * blocks + r["block"] for r in above))
    counted = (
        rows.groupBy("old", cell_of(heavy, blocks).alias("cell"))
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).orderBy("old", "cell").collect()
    )
    whole: dict[tuple[int, int], int] = {}
    for r in counted:
        key = r["old"], _block_number(r["cell"], blocks)
        whole[key] = whole.get(key, 0) + r["size"]
    # A unit is a block, or a cell of a block that would fill a shard.
    unit = {}
    for r in counted:
        key = r["old"], _block_number(r["cell"], blocks)
        unit[r["old"], r["cell"]] = (r["old"], r["cell"]) if whole[key] > FULL * total / shards else key
    sizes: dict[tuple[int, int], int] = {}
    for r in counted:
        key = unit[r["old"], r["cell"]]
        sizes[key] = sizes.get(key, 0) + r["size"]
    place = assign_blocks([Block(*key, size) for key, size in sizes.items()], old_shards, shards)
    slots, plan, changed = [0] * shards, [], set()
    for r in counted:
        to = place[unit[r["old"], r["cell"]]]
        plan.append((r["old"], r["cell"], to, slots[to]))
        slots[to] += r["rows"]
        if r["old"] != to:
            changed |= {r["old"], to}
    cells = rows.sparkSession.createDataFrame(plan, "old int, cell bigint, shard int, first_slot bigint")
    return Plan(cells, heavy, blocks, tuple(sorted(x for x in changed if x < shards)))


def _block_number(cell: int, blocks: int) -> int:
    return cell if cell < blocks else (cell - blocks) // CELLS


def reshard(rows: DataFrame, old_shards: int, shards: int, blocks: int = BLOCKS) -> DataFrame:
    """``rows`` with shard and slot; it is read three times: pass a written table."""
    inside = Window.partitionBy("old", "cell").orderBy("doc_id", "text_crc32", "size")
    placed = plan_reshard(rows, old_shards, shards, blocks).place(rows)
    return placed.withColumn("slot", F.col("first_slot") + F.row_number().over(inside) - 1)


def sized(docs: DataFrame, old: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The whole row and what resharding needs to know of it.  ``old`` is the
    old shard, by default the text's CRC over ``OLD_SHARDS`` shards."""
    raw = F.encode(text_or_empty(F.col(text)), "UTF-8")
    crc = F.crc32(raw).cast("bigint")
    return docs.select(
        F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        crc.alias("text_crc32"), (F.pmod(crc, F.lit(OLD_SHARDS)) if old is None else old).cast("int").alias("old"),
    )


def rewrite(docs: DataFrame, old: Column, old_shards: int, shards: int, path: str,
            doc_id: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> Plan:
    """Write the shards whose content changes, each to its own folder of the
    Parquet table ``path``; the other shards keep their files, and the folder of
    a shard that all rows leave, or that is no longer one, is emptied.  ``docs``
    must not be read from ``path`` itself.  Documents keep all their columns; the
    folders are named after ``shard``, with underscores added while the documents
    have such a column."""
    rows = sized(docs, old, doc_id, text)
    plan = plan_reshard(materialise(rows.drop("row"), "reshard-rows"), old_shards, shards, blocks)
    name = "shard"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    written = plan.place(rows).where(F.col("shard").isin(list(plan.changed)))
    written.select("row.*", F.col("shard").alias(name)).write.partitionBy(name).mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").parquet(path)
    # Only folders that receive rows are replaced.
    filled = {r["shard"] for r in plan.cells.select("shard").distinct().collect()}
    for gone in {*plan.changed, *range(shards, old_shards)} - filled:
        _drop(docs.sparkSession, f"{path}/{name}={gone}")
    return plan


def _drop(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any Hadoop store, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@query("op7_reshard")
def op7_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(sized(table(spark, sf_dir, "documents")).drop("row"), "reshard-rows")
    return reshard(rows, OLD_SHARDS, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
