"""Training-order materialisation: every sequence at its slot of a keyed
permutation, in binary shards of fixed stride.

A document's ids are cut into sequences of ``length - 1`` ids; each is closed
by the end id, and a short one is filled up with it.  Sequences are numbered
densely, and a Feistel network over the next power of four, walked along its
cycle until it falls below their number, gives each its slot: a permutation
that any machine can compute for any slot, in both directions, without a table.

Shard ``s`` holds the slots from ``s * per_shard`` on, one record after another
and nothing else, so slot, shard and byte are one division apart; reading can
begin at any slot and reads only the shards from there on.

The texts are encoded twice.  The first pass keeps only sizes, which say the
number of sequences and every document's first number; the second encodes
again, so that no token is written but into its shard.  Records travel
compressed, and a shard is put together in one task from its own records, a
number fixed by ``per_shard``; tasks take up to ``TOGETHER`` neighbouring shards,
so their number follows the input.

Records end with the end id, whose last byte is zero; that byte is written as
the text writer's line separator, so Spark's own writer makes the files.

Rows that repeat both id and text are counted in the first pass and numbered one
after another, in parts of at most ``REPEATED`` sequences or one row; the second
encodes their text once for each part and writes the part's rows from it.

Defined results: a null or empty text is one sequence of end ids; every row is a
document, also one that repeats id and text; an empty table writes no shard;
columns other than id and text do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ids import number_sorted
from .common import broadcast_below, materialise, query, scratch_path, table, text_or_empty
from .shingles import mix
from .tokens import END, Encoder, Vocabulary, vocabulary

LENGTH = 512
PER_SHARD = 8192
ROUNDS = 6
KEY = 20240229
REPEATED = 4096  # sequences of a row and its repetitions that are numbered and written as one part
TOGETHER = 16  # shards put together by one task, at most
HELD = 32_768  # sequences put in order at once, beside one part


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of 0 .. size-1."""

    size: int
    key: int = KEY
    rounds: int = ROUNDS

    @property
    def _half(self) -> int:
        return max(1, (max(self.size - 1, 1).bit_length() + 1) // 2)

    def _round(self, r: int, half: np.ndarray, mask: np.uint64) -> np.ndarray:
        salt = np.uint64((self.key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % (1 << 64))
        return mix(half + salt) & mask

    def _network(self, x: np.ndarray, forward: bool) -> np.ndarray:
        bits, mask = np.uint64(self._half), np.uint64((1 << self._half) - 1)
        left, right = x >> bits, x & mask
        for r in range(self.rounds) if forward else reversed(range(self.rounds)):
            if forward:
                left, right = right, left ^ self._round(r, right, mask)
            else:
                left, right = right ^ self._round(r, left, mask), left
        return (left << bits) | right

    def _walk(self, x: np.ndarray, forward: bool) -> np.ndarray:
        out = self._network(np.asarray(x).astype(np.uint64), forward)
        while True:
            beyond = np.flatnonzero(out >= np.uint64(self.size))
            if not len(beyond):
                return out.astype(np.int64)
            out[beyond] = self._network(out[beyond], forward)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, True) if self.size else np.zeros(0, np.int64)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, False) if self.size else np.zeros(0, np.int64)


def records(ids: np.ndarray, length: int, dtype: str) -> np.ndarray:
    """The document's sequences, one per row."""
    count = max(1, -(-len(ids) // (length - 1)))
    out = np.full((count, length), END, dtype)
    flat = np.full(count * (length - 1), END, dtype)
    flat[: len(ids)] = ids
    out[:, :-1] = flat.reshape(count, length - 1)
    return out


@dataclass(frozen=True)
class Order:
    """Written shards and what they hold."""

    path: str
    permutation: Permutation
    length: int
    per_shard: int
    dtype: str
    index: DataFrame  # doc_id, piece, n_ids, number, slot

    @property
    def stride(self) -> int:
        return self.length * np.dtype(self.dtype).itemsize

    def read(self, spark: SparkSession, start: int = 0, count: int | None = None) -> DataFrame:
        """(slot, shard, byte_offset, record) from slot ``start`` on, opening
        only the shards that hold them."""
        stop = self.permutation.size if count is None else min(start + count, self.permutation.size)
        stride, per_shard = self.stride, self.per_shard
        schema = "slot bigint, shard int, byte_offset bigint, record binary"
        if start >= stop:
            return spark.createDataFrame([], schema)

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                    raw = content.as_buffer()
                    n = raw.size // stride
                    slots = shard * per_shard + np.arange(n)
                    at = np.flatnonzero((slots >= start) & (slots < stop))
                    if not len(at):
                        continue
                    held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(stride), n, [None, raw]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(slots[at]), pa.array(np.full(len(at), shard, np.int32)), pa.array(at * stride), held.cast(pa.binary()),
                    ], ["slot", "shard", "byte_offset", "record"])

        files = spark.read.format("binaryFile").load(self.path).where(
            F.col("shard").between(start // per_shard, (stop - 1) // per_shard)
        )
        return files.select("shard", "content").mapInArrow(split, schema)


def write_order(
    docs: DataFrame, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY,
    dtype: str = "<u2", words: Vocabulary | None = None,
) -> Order:
    """Write the sequences of ``docs`` (doc_id, text) in training order.

    ``dtype`` must hold the vocabulary's ids; ``docs`` is read twice, and once
    more where rows repeat."""
    words = words or vocabulary()
    room = length - 1
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty(F.col("text")).alias("text")).withColumn(
        "print", F.md5("text")
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(words)
        for batch in batches:
            counts = pa.array(encoder.counts(batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), counts], ["doc_id", "print", "n"])

    measured = keyed.select("doc_id", "print", "text").mapInArrow(measure, "doc_id bigint, print string, n bigint")
    sizes = materialise(measured, "order-sizes").groupBy("doc_id", "print").agg(
        F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")
    )
    # A part is a row, or as many repetitions of it as have REPEATED sequences.
    count = F.call_function("div", F.greatest(F.col("n") - 1, F.lit(0)), F.lit(room)) + 1
    at_once = F.greatest(F.lit(1), F.call_function("div", F.lit(REPEATED), F.col("count")))
    parts = sizes.withColumn("count", count).withColumn("most", at_once).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.call_function("div", F.col("copies") - 1, F.col("most"))))
    ).withColumn("times", F.least(F.col("most"), F.col("copies") - F.col("part") * F.col("most")).cast("int"))
    pieces = parts.withColumn("at", F.explode(F.sequence(F.lit(0), (F.col("times") * F.col("count") - 1).cast("int")))).withColumn(
        "piece", (F.col("at") % F.col("count")).cast("int")
    ).select(
        "doc_id", "print", "piece", F.least(F.lit(room), F.col("n") - F.col("piece") * room).cast("int").alias("n_ids"),
        "at", "times", (F.col("copies") > 1).alias("repeated"),
    )
    numbered = number_sorted(pieces, "order")
    permutation = Permutation(numbered.count, key)

    @F.arrow_udf("bigint")
    def slot_of(number: pa.Array) -> pa.Array:
        return pa.array(permutation.slot(number.to_numpy()))

    number = F.col("pos") - 1
    index = materialise(
        numbered.frame.select(
            "doc_id", "print", "piece", "n_ids", number.alias("number"), slot_of(number).alias("slot"), "at", "times", "repeated"
        ),
        "order-index",
    )
    first = materialise(index.where("at = 0").select(
        F.col("doc_id").alias("d"), F.col("print").alias("p"), F.col("number").alias("first"), "times", "repeated"
    ), "order-first")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p"))
    placed = keyed.join(broadcast_below(first.where(~F.col("repeated")), F.lit(56)), same).select("text", "first", "times")
    again = first.where("repeated")
    if not again.isEmpty():
        one = again.select("d", "p").distinct()
        texts = keyed.join(broadcast_below(materialise(one, "order-repeated"), F.lit(56)), same, "leftsemi").groupBy("doc_id", "print").agg(
            F.first("text").alias("text")
        )
        placed = placed.unionByName(texts.join(again, same).select("text", "first", "times").repartition("first"))

    def dealt_by_shard(held: list[np.ndarray], numbers: list[np.ndarray], codec: pa.Codec) -> pa.RecordBatch:
        """What sequences mean for each shard: slots, and the records compressed."""
        slots = permutation.slot(np.concatenate(numbers))
        order = np.argsort(slots)
        slots, made = slots[order], np.concatenate(held)
        shard, begin = np.unique(slots // per_shard, return_index=True)
        runs = list(zip(begin, np.append(begin[1:], len(slots))))
        return pa.RecordBatch.from_arrays([
            pa.array(shard.astype(np.int32)), pa.array([slots[a:b].tobytes() for a, b in runs], pa.binary()),
            pa.array([codec.compress(made[order[a:b]].tobytes(), asbytes=True) for a, b in runs], pa.binary()),
        ], ["shard", "slots", "records"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, codec = Encoder(words), pa.Codec("zstd", compression_level=3)
        for batch in batches:
            held, numbers, many = [], [], 0
            lists = encoder.lists(batch.column("text"))
            for ids, first, times in zip(lists, batch.column("first").to_pylist(), batch.column("times").to_pylist()):
                made = records(ids, length, dtype)
                held.append(np.tile(made, (times, 1)) if times > 1 else made)
                numbers.append(first + np.arange(len(held[-1])))
                many += len(held[-1])
                if many >= HELD:
                    yield dealt_by_shard(held, numbers, codec)
                    held, numbers, many = [], [], 0
            if held:
                yield dealt_by_shard(held, numbers, codec)

    shards = -(-permutation.size // per_shard)
    # Neighbouring shards share a task, a bounded number of them whatever the input.
    together = max(1, min(TOGETHER, shards // (4 * docs.sparkSession.sparkContext.defaultParallelism)))
    dealt = placed.mapInArrow(emit, "shard int, slots binary, records binary").repartitionById(
        max(1, -(-shards // together)), F.call_function("div", F.col("shard"), F.lit(together)).cast("int")
    ).sortWithinPartitions("shard")

    def content(held: list[tuple[bytes, bytes]]) -> bytes:
        """A shard's records in the order of their slots, without the last byte."""
        slots = [np.frombuffer(s, np.int64) for s, _ in held]
        stride = length * np.dtype(dtype).itemsize
        made = [
            np.frombuffer(pa.decompress(r, decompressed_size=len(s) * stride, codec="zstd"), dtype).reshape(-1, length)
            for s, (_, r) in zip(slots, held)
        ]
        return np.concatenate(made)[np.argsort(np.concatenate(slots))].tobytes()[:-1]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for s, slots, made in zip(*(batch.column(c).to_pylist() for c in ("shard", "slots", "records"))):
                if s != shard and held:
                    yield _file(shard, content(held))
                    held = []
                shard = s
                held.append((slots, made))
        if held:
            yield _file(shard, content(held))

    files = dealt.mapInArrow(join, "shard int, content binary")
    files.select("shard", F.col("content").cast("string").alias("content")).write.partitionBy("shard").option(
        "lineSep", "\u0000").option("compression", "none").text(path)
    return Order(path, permutation, length, per_shard, dtype, index.drop("at", "times", "repeated"))


def _file(shard: int, content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([content], pa.binary())], ["shard", "content"])


@query("op9_training_order")
def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence with its place and the checksum of what lies there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = write_order(docs, scratch_path(spark, "order"))
    read = order.read(spark).select("slot", "shard", "byte_offset", F.crc32("record").cast("bigint").alias("ids_crc32"))
    return order.index.join(read, "slot").select("doc_id", "piece", "n_ids", "number", "slot", "shard", "byte_offset", "ids_crc32")
