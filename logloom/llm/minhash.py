"""Near-duplicate documents by fast similarity sketching.

Every document's set of word shingles gets a sketch, the sketch is cut into
bands, and documents that agree in a band are candidates.  Two filters go
before the comparison of the full sets: sizes too different to be similar
enough, and sketches that agree in fewer coordinates than a similar pair's
would, by the sketch's concentration, but once in ``1 / MISS`` cases.

Copies never meet one another: documents with equal sets are one class, and
only classes are banded.  Candidates are found inside a bucket, in blocks of at
most ``BLOCK`` classes, and never listed: a first pass over the small sketches
keeps the classes that have a candidate at all, a second reads their texts,
compares sets and emits only links that join what was apart.  Of several
buckets that hold the same two classes the first band's compares them.  So a
group of near copies costs as many links as it has members, in blocks that are
separate tasks, and nothing is capped.

Spark sizes a table by its files and the widths of its columns' types, not by
what an ``explode`` makes of its rows: the bands of a million classes count as
some megabytes and are gigabytes.  So where classes are linked and documents
dropped, joins with a side that grows with the input are hinted to shuffle, and
only what was measured is broadcast; ``labelled`` leaves its join to Spark.

The number of bands follows from the threshold: a pair exactly at it is missed
with a probability of at most ``MISS``.

Defined results: null, empty and blank texts have no shingles and link with
nothing; fewer words than a shingle are one shingle; a component's id is its
smallest id that is not null (null if it has none); rows that repeat an id are
documents of their own; whole texts count, however long; an empty table gives
an empty result; all columns of the documents, whatever their names, are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_below, materialise, query, table
from .components import connected_components
from .shingles import band_hashes, fast_similarity_sketch, fingerprint, shingle_sets, sketch_seeds, utf8

MISS = 1e-6
ROWS = 4
BLOCK = 512


def band_count(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def least_agreement(coordinates: int, similarity: float, miss: float = MISS) -> int:
    """Fewest coordinates in which a pair at ``similarity`` agrees, but for ``miss``."""
    total = 0.0
    for k in range(coordinates + 1):
        total += math.comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if total > miss:
            return k
    return coordinates


@dataclass(frozen=True)
class Sketched:
    """Written tables: documents with their set's fingerprint, and the classes."""

    docs: DataFrame  # uid, row, n_shingles, print
    classes: DataFrame  # node, print, uid of one document, low (smallest id), n_shingles, bands, marks


def sketch(docs: DataFrame, words: int, similarity: float, doc_id: str = "doc_id", text: str = "text") -> Sketched:
    """Sketch every text; ``docs`` is read once and written with its sketches,
    since a class's text is needed again."""
    bands = band_count(similarity)
    t = bands * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = sketch_seeds(t)
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            sizes, prints, keys, marks = [], [], [], []
            for s in shingle_sets(raw, offsets, words):
                sizes.append(len(s))
                made = fast_similarity_sketch(s, t, seeds) if len(s) else None
                prints.append(fingerprint(s) if len(s) else None)
                keys.append(band_hashes(made, ROWS).tobytes() if len(s) else None)
                marks.append(made.astype(np.uint8).tobytes() if len(s) else None)  # a byte of each coordinate
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(sizes, pa.int64())] + [pa.array(x, pa.binary()) for x in (prints, keys, marks)],
                ["row", "n_shingles", "print", "bands", "marks"],
            )

    rows = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([
        rows.schema["row"], T.StructField("n_shingles", T.LongType()), T.StructField("print", T.BinaryType()),
        T.StructField("bands", T.BinaryType()), T.StructField("marks", T.BinaryType()),
    ])
    sketched = rows.mapInArrow(run, schema)
    written = materialise(sketched.withColumn("uid", F.monotonically_increasing_id()), "near-docs")
    classes = (
        written.where("print IS NOT NULL").groupBy("print")
        .agg(F.min("uid").alias("uid"), F.min(F.col(f"row.{doc_id}")).alias("low"), F.max("n_shingles").alias("n_shingles"))
    )
    # The class's bands are those of the document it is named after.
    named = classes.join(written.select("uid", "bands", "marks").hint("merge"), "uid").withColumn("node", F.monotonically_increasing_id())
    return Sketched(written.drop("bands", "marks"), materialise(named, "near-classes"))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole (bucket, low, high) groups of sorted rows; what
    begins a group that may go on is kept for the next batch."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        keys = [rows.column(c).to_numpy() for c in ("bucket", "low", "high")]
        same = np.logical_and.reduce([k == k[-1] for k in keys]) if rows.num_rows else np.zeros(0, bool)
        first = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
        if first:
            yield rows.slice(0, first)
        held = rows.slice(first)
    if held is not None and held.num_rows:
        yield held


def candidates(rows: pa.Table, percent: int, agree: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of candidate pairs, by growing distance of the two rows."""
    n = rows.num_rows
    bucket, low, high, block, band, size = (
        rows.column(c).to_numpy() for c in ("bucket", "low", "high", "block", "band", "n_shingles")
    )
    marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), np.uint8).reshape(n, -1)
    bands = np.frombuffer(b"".join(rows.column("bands").to_pylist()), np.int64).reshape(n, -1)
    before = np.arange(bands.shape[1])
    for d in range(1, n):
        together = (bucket[d:] == bucket[:-d]) & (low[d:] == low[:-d]) & (high[d:] == high[:-d])
        if not together.any():
            return
        # Of two blocks only pairs across them; each block meets itself once.
        i = np.flatnonzero(together & ((low[d:] == high[d:]) | (block[d:] != block[:-d])))
        j = i + d
        close = (size[i] * 100 >= size[j] * percent) & (size[j] * 100 >= size[i] * percent)
        i, j = i[close], j[close]
        alike = (marks[i] == marks[j]).sum(1) >= agree
        i, j = i[alike], j[alike]
        earlier = ((bands[i] == bands[j]) & (before < band[i][:, None])).any(1)
        if not earlier.all():
            yield i[~earlier], j[~earlier]


def _with_candidates(percent: int, agree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            keep = np.zeros(rows.num_rows, bool)
            for i, j in candidates(rows, percent, agree):
                keep[i] = keep[j] = True
            yield from rows.filter(pa.array(keep)).to_batches()

    return run


def _links(words: int, percent: int, agree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            node, texts = rows.column("node").to_pylist(), rows.column("text")
            sets: dict[int, np.ndarray] = {}
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            def set_of(i: int) -> np.ndarray:
                if node[i] not in sets:
                    sets[node[i]] = next(shingle_sets(*utf8(pa.array([texts[i].as_py()], pa.large_string())), words))
                return sets[node[i]]

            out = []
            for left, right in candidates(rows, percent, agree):
                for i, j in zip(left.tolist(), right.tolist()):
                    a, b = find(node[i]), find(node[j])
                    if a == b:
                        continue
                    x, y = set_of(i), set_of(j)
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int((y[at] == x).sum())
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        root[max(a, b)] = min(a, b)
                        out.append((node[i], node[j]))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


GROUP = ["bucket", "low", "high"]


def link_classes(sketched: Sketched, text: str, words: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(node, component) of the classes that are linked, but for the smallest."""
    bands = band_count(percent / 100)
    agree = least_agreement(bands * ROWS, percent / 100)

    @F.arrow_udf("array<bigint>")
    def numbers(keys: pa.Array) -> pa.Array:
        flat = np.frombuffer(b"".join(keys.to_pylist()), np.int64)
        return pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * bands, flat)

    banded = sketched.classes.select("node", F.posexplode(numbers("bands")).alias("band", "bucket"))
    # Most buckets hold one class; they are counted before the shuffle.
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    members = materialise(banded.join(shared.hint("merge"), "bucket"), "near-members")
    blocks = F.ceil(F.col("held") / block)
    dealt = (
        members.join(sketched.classes.select("node", "n_shingles", "bands", "marks").hint("merge"), "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        .select(
            "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "band",
            "node", "n_shingles", "bands", "marks",
        )
    )

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition(*GROUP).sortWithinPartitions(*GROUP)

    found = materialise(grouped(dealt).mapInArrow(_with_candidates(percent, agree), dealt.schema), "near-candidates")
    wanted = materialise(
        sketched.classes.select("node", "uid").join(found.select("node").distinct().hint("merge"), "node"), "near-wanted"
    )
    texts = sketched.docs.select("uid", F.col(f"row.{text}").cast("string").alias("text")).join(
        broadcast_below(wanted, F.lit(16)), "uid"
    ).select("node", "text")
    links = grouped(found.join(texts.hint("merge"), "node")).mapInArrow(_links(words, percent, agree), "a bigint, b bigint")
    return connected_components(materialise(links, "near-links"))


@dataclass(frozen=True)
class NearDuplicates:
    sketched: Sketched
    groups: DataFrame  # print, group, component_id (smallest id of the group)

    def labelled(self) -> DataFrame:
        """uid, row, n_shingles, group and component_id of every document."""
        return self.sketched.docs.join(self.groups, "print", "left")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> NearDuplicates:
    sketched = sketch(docs, words, percent / 100, doc_id, text)
    components = link_classes(sketched, text, words, percent)
    named = sketched.classes.select("node", "print", "low").join(broadcast_below(components, F.lit(16)), "node", "left")
    grouped = named.select("print", "low", F.coalesce("component", "node").alias("group"))
    lowest = grouped.groupBy("group").agg(F.min("low").alias("component_id"))
    return NearDuplicates(sketched, materialise(grouped.select("print", "group").join(lowest.hint("merge"), "group"), "near-groups"))


def dedupe(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id,
    ids that are null last, and of several such rows any one."""
    near = near_duplicates(docs, words, percent, doc_id, text)
    keys = near.sketched.docs.select("uid", "print", F.col(f"row.{doc_id}").alias("id"))
    grouped = keys.join(near.groups.select("print", "group").hint("merge"), "print")
    kept = grouped.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first"))
    dropped = materialise(
        grouped.join(kept, "group").where(F.col("uid") != F.col("first.uid")).select("uid"), "near-dropped"
    )
    rows = near.sketched.docs.join(broadcast_below(dropped, F.lit(8)), "uid", "left_anti")
    return rows.select("row.*")


@query("op6_minhash")
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = near_duplicates(docs, words=3, percent=85).labelled()
    doc_id = F.col("row.doc_id")
    component = F.when(F.col("group").isNull(), doc_id).otherwise(F.col("component_id"))
    return labelled.select(
        doc_id.alias("doc_id"), "n_shingles", component.alias("component_id"), doc_id.eqNullSafe(component).alias("kept")
    )
