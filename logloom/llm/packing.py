"""Packing documents into as few sequences as possible.

A document's ids and an end id are cut only where they exceed a sequence.  What
is packed is the histogram of the pieces' lengths, at most as many numbers as a
sequence has places.  The configuration program (how often is each filling of a
sequence used?) is solved over it by multiplicative weights: lengths that are
covered little weigh more, a knapsack recurrence over the sequence's places
prices the heaviest filling, and the filling is used a step further.  The
solution is rounded down; what is left over is filled length by length, each
time with the subset of the lengths left that fills the sequence best.

The plan is a table of runs: the pieces of a length numbered ``first`` and on
go to sequences numbered ``sequence`` and on, at one offset.  Pieces are
numbered within task and length while they are cut, and the counts of (task,
length) shift the numbers; so neither a length nor a sequence is gathered.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; a null id stays with its pieces; an empty table has no pieces;
``packed`` reads only id and text, so other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_below, materialise, query, table
from .tokens import END, Encoder, Vocabulary, vocabulary

PLACES = 1024
ROUNDS = 1000  # of multiplicative weights
RATE, STEP = 10.0, 0.25
FULL = 1.0  # what a rounded filling must fill; the rest is left over


def price(weights: np.ndarray, places: int) -> list[int]:
    """Lengths of a heaviest filling, by the knapsack recurrence: the best of
    ``c`` places is a length and the best of the places it leaves.
    ``weights[l]`` is the weight of length ``l``, 0 for none."""
    best = np.zeros(places + 1)
    last = np.zeros(places + 1, np.int64)
    for c in range(1, places + 1):
        gains = weights[1 : c + 1] + best[c - 1 :: -1][:c]
        at = int(gains.argmax())
        best[c], last[c] = gains[at], at + 1
    out, c = [], places
    while c > 0:
        if weights[last[c]] > 0:
            out.append(int(last[c]))
        c -= int(last[c])
    return out


def configurations(demand: np.ndarray, places: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Fillings and how often each is used, covering ``demand`` (by length)."""
    wanted = np.flatnonzero(demand)
    covered = np.zeros(len(demand))
    uses: dict[tuple[int, ...], float] = {}
    weights = np.zeros(len(demand))
    for _ in range(rounds):
        share = covered[wanted] / demand[wanted]
        if share.min() >= 1:
            break
        # The dual price of a length: the less of its demand is covered, the more.
        weights[wanted] = np.exp(-RATE * (share - share.min())) / demand[wanted]
        filling = price(weights, places)
        lengths, counts = np.unique(filling, return_counts=True)
        step = max(STEP * float((demand[lengths] / counts).min()), 1e-9)
        covered[lengths] += step * counts
        key = tuple(sorted(filling, reverse=True))
        uses[key] = uses.get(key, 0.0) + step
    return uses


def best_subset(lengths: list[int], places: int) -> list[int]:
    """The lengths, each at most as often as listed, that fill ``places`` best."""
    reach = [1]
    within = (1 << (places + 1)) - 1
    for n in lengths:
        reach.append(reach[-1] | (reach[-1] << n) & within)
        if reach[-1] >> places & 1:
            break
    left = reach[-1].bit_length() - 1
    out = []
    for i in range(len(reach) - 1, 0, -1):
        if not reach[i - 1] >> left & 1:
            out.append(lengths[i - 1])
            left -= lengths[i - 1]
    return out


def fillings(histogram: dict[int, int], places: int = PLACES) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences) covering the histogram exactly."""
    left = np.zeros(places + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[places]:
        plan.append(((places,), int(left[places])))
        left[places] = 0

    def use(lengths: tuple[int, ...], most: int) -> None:
        kinds, counts = np.unique(lengths, return_counts=True)
        times = int(min(most, (left[kinds] // counts).min()))
        if times > 0:
            left[kinds] -= times * counts
            plan.append((lengths, times))

    if left.any():
        uses = configurations(left.astype(float), places)
        for filling, times in sorted(uses.items(), key=lambda x: (-x[1], x[0])):
            if sum(filling) >= FULL * places and times >= 1:
                use(filling, int(times))
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        rest = [int(n) for n in np.flatnonzero(left)[::-1] for _ in range(min(int(left[n]), 2)) if n <= places - longest]
        left[longest] += 1
        use((longest, *best_subset(rest, places - longest)), int(left[longest]))
    return plan


@dataclass(frozen=True)
class Plan:
    """Runs sorted by length and first number."""

    keys: np.ndarray  # length << 40 | first number
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.keys, (length << 40) | number, side="right") - 1
        return self.sequence[run] + number - (self.keys[run] & ((1 << 40) - 1)), self.offset[run]


def plan_packing(histogram: dict[int, int], places: int = PLACES) -> Plan:
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for lengths, times in fillings(histogram, places):
        offset = 0
        for n in lengths:
            first = used.get(n, 0)
            runs.append(((n << 40) | first, sequence, offset))
            used[n] = first + times
            offset += n
        sequence += times
    runs.sort()
    keys, sequences, offsets = (np.array(x, np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3
    return Plan(keys, sequences, offsets, sequence)


def cut(count: int, places: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first may be shorter."""
    first = count % places or places
    return [(0, min(first, count))] + [(s, places) for s in range(first, count, places)]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, task int, nth bigint"


def pieces(docs: DataFrame, places: int = PLACES, keep_ids: bool = False, words: Vocabulary | None = None) -> DataFrame:
    """Every document's pieces, numbered within task and length."""
    words = words or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(words), TaskContext.get().partitionId()
        seen = np.zeros(places + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encoder.ids(text.as_py()), np.uint32(END)).astype("<u4")
                for number, (start, length) in enumerate(cut(len(ids), places)):
                    raw = ids[start : start + length].tobytes()
                    rows.append((doc_id, number, start, length, zlib.crc32(raw), raw if keep_ids else None, task, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    written = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)
    return materialise(written if keep_ids else written.drop("ids"), "pack-pieces")


def packed(docs: DataFrame, places: int = PLACES, keep_ids: bool = False, words: Vocabulary | None = None) -> DataFrame:
    """Every piece with its sequence_id and offset; ``docs`` has doc_id and text."""
    cut_up = pieces(docs, places, keep_ids, words)
    counts = materialise(cut_up.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(histogram, places)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n"), "pack-bases")
    numbered = cut_up.join(broadcast_below(bases, F.lit(20)), ["task", "length"]).withColumn("number", F.col("base") + F.col("nth"))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        sequence, offset = plan.place(length.to_numpy(), number.to_numpy())
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if keep_ids else [])
    return numbered.withColumn("at", place("length", "number")).select(*kept, "at.sequence_id", "at.offset")


def sequences(docs: DataFrame, places: int = PLACES, words: Vocabulary | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, its pieces in order, and
    its ids as little-endian 32-bit numbers.  A sequence has at most ``places``
    pieces, so gathering one is bounded."""
    one = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    gathered = packed(docs, places, True, words).groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return gathered.select("sequence_id", F.transform("p", lambda p: p.dropFields("ids")).alias("pieces"), ids.alias("ids"))


@query("op8_pack")
def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
