"""Embedding near-duplicates by an inverted multi-index.

Two codebooks, one per half of the vector, span a grid of cells; every vector
lies in the cell of its nearest pair of centroids.  A vector is compared with
the cells that a multi-sequence traversal visits first: pairs of centroids in
the order of the summed distances.  How many cells are visited follows from the
target recall: on perturbed sample vectors exactly at the threshold, the worst
case, that share of partners must lie in visited cells; these vectors are held
out from the codebooks, and there is no limit short of all cells.  A pair counts when
either vector visits the other's cell, and only after its cosine was computed in
double precision.

Equal vectors are one class and never meet.  A cell is worked off in blocks of
at most ``DATA_ROWS`` by ``QUERY_ROWS`` vectors, so a crowded cell is many
tasks; a block adds up its links and emits a spanning set of edges, never its
pairs.

The codebooks are fitted on ``TRAIN_ROWS`` vectors picked by hash; every vector
is indexed.  The number of centroids follows the number of classes, about
``CELL_ROWS`` of them to a cell.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component, and vectors without a label, link with nothing; so do
vectors of different lengths; rows that repeat a vector link with one another;
a null id counts as a vector but names no component while another can; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import finite_vector, materialise, query, table
from .components import connected_components

TRAIN_ROWS = 8192
CELL_ROWS = 64
MOST_CENTROIDS = 1024
HELD_SHARE = 8  # one in so many sample vectors measures the recall, and fits nothing
FIRST_CELLS = 64  # tried at first
DATA_ROWS = 1024
QUERY_ROWS = 4096
TARGET_RECALL = 0.99


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)


def fit_codebook(x: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; empty centroids stay."""
    centroids = x[np.linspace(0, len(x) - 1, size).astype(int)].copy()
    for _ in range(rounds):
        nearest = _distances(x, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=size)
        filled = counts > 0
        centroids[filled] = sums[filled] / counts[filled, None]
    return centroids


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their scale."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    width: int  # vectors are padded to it
    visits: int

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.zeros((len(x), self.width))
        padded[:, : x.shape[1]] = x
        half = self.width // 2
        return _distances(padded[:, :half], self.first), _distances(padded[:, half:], self.second)

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self._halves(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def traverse(self, x: np.ndarray, cells: int) -> np.ndarray:
        """The ``cells`` first cells of every row's multi-sequence order.

        The pair of the i-th and j-th nearest centroids comes after all (i+1)(j+1)
        pairs below it, so only pairs under that staircase can be among them."""
        a, b = self._halves(x)
        order_a, order_b = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        near_a, near_b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
        stair = [(i, j) for i in range(a.shape[1]) for j in range(min(b.shape[1], cells // (i + 1)))]
        i, j = np.array(stair).T
        sums = near_a[:, i] + near_b[:, j]
        cells = min(cells, len(stair))
        first = sums.argsort(1, kind="stable")[:, :cells]
        return order_a[np.arange(len(x))[:, None], i[first]] * len(self.second) + order_b[np.arange(len(x))[:, None], j[first]]


def visits_for(index: MultiIndex, held: np.ndarray, cosine: float, recall: float) -> int:
    """Cells to visit so that a partner exactly at ``cosine`` is met from either
    side with probability ``recall``, measured on perturbed vectors that the
    codebooks were not fitted on.

    Ever more cells are tried until the recall is reached, all of them at last,
    where every partner is met."""
    if not len(held):
        return 1
    noise = np.random.default_rng(11).normal(size=held.shape)
    noise -= (noise * held).sum(1, keepdims=True) * held
    y = cosine * held + np.sqrt(1 - cosine**2) * unit(noise)
    place, every = min(len(held) - 1, int(np.ceil(recall * len(held)))), len(index.first) * len(index.second)
    most = min(FIRST_CELLS, every)
    while True:
        rank = np.full(len(held), every + 1)
        for p, q in ((held, y), (y, held)):
            met = index.traverse(p, most) == index.home(q)[:, None]
            rank = np.minimum(rank, np.where(met.any(1), met.argmax(1) + 1, every + 1))
        visits = int(np.sort(rank)[place])
        if visits <= most:
            return visits
        if most == every:
            raise RuntimeError("A partner lies in no cell")
        most = min(4 * most, every)


def fit_index(classes: DataFrame, cosine: float, recall: float = TARGET_RECALL, train_rows: int = TRAIN_ROWS) -> MultiIndex:
    row = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(2, row["width"] or 2)
    sample = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(train_rows).collect()
    x = np.zeros((max(len(sample), 1), width))
    for i, r in enumerate(sample):
        x[i, : len(r["v"])] = r["v"]
    if not sample:
        x[:] = 1.0
    x = unit(x)
    # Rows come in the order of a hash, so any part of them is a sample.
    held = x[: max(1, len(x) // HELD_SHARE)][:1024]
    x = x[len(held) :] if len(x) > 2 * HELD_SHARE else x
    size = int(np.clip(round(((row["n"] or 1) / CELL_ROWS) ** 0.5), 2, min(MOST_CENTROIDS, len(x) + 1)))
    half = width // 2
    index = MultiIndex(fit_codebook(x[:, :half], size), fit_codebook(x[:, half:], size), width, 1)
    return MultiIndex(index.first, index.second, width, visits_for(index, held, cosine, recall))


def _coded(classes: DataFrame, index: MultiIndex) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(v, float) for v in batch.column("v").to_pylist()]
            home, visits, units = [None] * len(rows), [None] * len(rows), [None] * len(rows)
            for width in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == width]
                x = unit(np.array([rows[i] for i in at]))
                for i, h, v, u in zip(at, index.home(x).tolist(), index.traverse(x, index.visits).tolist(), x):
                    home[i], visits[i], units[i] = h, v, u.tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column("node"), batch.column("label"), batch.column("copies"), pa.array([len(r) for r in rows], pa.int32()),
                pa.array(units, pa.binary()), pa.array(home, pa.int32()), pa.array(visits, pa.list_(pa.int32())),
            ], ["node", "label", "copies", "dim", "unit", "home", "visits"])

    schema = "node bigint, label {}, copies bigint, dim int, unit binary, home int, visits array<int>".format(
        classes.schema["label"].dataType.simpleString())
    return materialise(classes.select("node", "label", "copies", "v").mapInArrow(run, schema), "imi-coded")


def _block_links(cosine: float):
    """Links of one block: for each node the copies it is linked to, and the
    smallest node of the block it hangs together with."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("lowest", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return pa.table({"node": [], "links": [], "lowest": []}, schema=schema)

        def columns(t: pa.Table):
            units = np.frombuffer(b"".join(t.column("unit").to_pylist()), float).reshape(t.num_rows, -1)
            visits = t.column("visits").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            return (t.column("node").to_numpy(), t.column("copies").to_numpy(), units, t.column("home").to_numpy(), visits)

        q_node, q_copies, q_unit, q_home, _ = columns(left)
        d_node, d_copies, d_unit, _, d_visits = columns(right)
        q, d = np.nonzero(q_unit @ d_unit.T >= cosine)
        other = q_node[q] != d_node[d]
        q, d = q[other], d[other]
        # Where each visits the other's cell the pair is met twice and counts once.
        twice = (d_visits[d] == q_home[q][:, None]).any(1)
        once = ~twice | (q_node[q] < d_node[d])
        q, d = q[once], d[once]
        links = np.concatenate([
            np.bincount(q, weights=d_copies[d], minlength=len(q_node)), np.bincount(d, weights=q_copies[q], minlength=len(d_node)),
        ]).astype(np.int64)
        low_q, low_d = q_node.copy(), d_node.copy()
        while len(q):
            before = low_q.sum(), low_d.sum()
            np.minimum.at(low_d, d, low_q[q])
            np.minimum.at(low_q, q, low_d[d])
            if (low_q.sum(), low_d.sum()) == before:
                break
        keep = links > 0
        return pa.table({
            "node": np.concatenate([q_node, d_node])[keep], "links": links[keep], "lowest": np.concatenate([low_q, low_d])[keep],
        }, schema=schema)

    return run


@dataclass(frozen=True)
class Linked:
    nodes: DataFrame  # node, links (other vectors linked directly, beside copies)
    components: DataFrame  # node, component


def link_classes(classes: DataFrame, cosine: float, recall: float = TARGET_RECALL) -> Linked:
    """``classes`` has node, label, v (floats) and copies."""
    coded = _coded(classes, fit_index(classes, cosine, recall))
    key = ["label", "dim", "cell"]
    data = coded.withColumn("cell", F.col("home"))
    asking = coded.withColumn("cell", F.explode("visits"))
    held = data.groupBy(*key).agg(F.count(F.lit(1)).alias("d"))
    asked = asking.groupBy(*key).agg(F.count(F.lit(1)).alias("q"))
    cells = broadcast_if_small(materialise(
        held.join(asked, key).select(
            *key, F.ceil(F.col("d") / DATA_ROWS).alias("d_blocks"), F.ceil(F.col("q") / QUERY_ROWS).alias("q_blocks")
        ),
        "imi-cells",
    ))

    def blocks(rows: DataFrame, own: str, other: str) -> DataFrame:
        """A row's own block, and a copy of the row for each block it meets."""
        columns = [*key, "d_block", "q_block", "node", "copies", "unit", "home", "visits"]
        # Both sides come from one table: toDF gives each its own columns.
        return rows.join(cells, key).withColumn(own, F.pmod(F.xxhash64("node"), F.col(f"{own}s"))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}s") - 1))
        ).select(*columns).toDF(*columns)

    group = [*key, "d_block", "q_block"]
    found = blocks(asking, "q_block", "d_block").groupBy(*group).cogroup(
        blocks(data, "d_block", "q_block").groupBy(*group)
    ).applyInArrow(_block_links(cosine), "node bigint, links bigint, lowest bigint")
    found = materialise(found, "imi-links")
    return Linked(
        found.groupBy("node").agg(F.sum("links").alias("links")),
        connected_components(found.where("node <> lowest").select("node", "lowest")),
    )


def near_vectors(rows: DataFrame, cosine: float = 0.93, recall: float = TARGET_RECALL) -> DataFrame:
    """``rows`` (vec_id, embedding, label) with n_links and component_id."""
    zero = F.forall("embedding", lambda x: x == 0)
    usable = finite_vector(F.col("embedding")) & ~F.coalesce(zero, F.lit(True)) & F.col("label").isNotNull()
    classes = materialise(
        rows.where(usable).groupBy("label", F.col("embedding").alias("v"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
        .withColumn("node", F.monotonically_increasing_id()),
        "imi-classes",
    )
    linked = link_classes(classes, cosine, recall)
    named = classes.join(linked.nodes, "node", "left").join(linked.components, "node", "left").select(
        F.col("label").alias("c_label"), "v", "low", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"),
        F.coalesce("component", "node").alias("component"),
    )
    lowest = named.groupBy("component").agg(F.min("low").alias("lowest"))
    final = named.join(lowest, "component").select("c_label", "v", "n", "lowest")
    joined = rows.withColumn("usable", usable).join(
        final, F.col("usable") & (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("v")), "left"
    )
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("lowest"))
    return joined.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


@query("op5_multi_index")
def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
