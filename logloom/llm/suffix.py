"""Removing long repeated byte strings, by fingerprints of suffixes that a
difference cover lets through.

Every byte covered by a string of ``WINDOW`` bytes that also starts anywhere
else is removed; strings never cross documents, and are judged on the input.

A suffix matters only by its first ``WINDOW`` bytes.  Whether they occur twice
is found in three passes over the texts, none of which holds more than one
bucket of suffixes at a time:

1. The cover sample: positions whose residue is in a difference cover of
   ``PERIOD``.  Any two positions have a common shift below ``PERIOD`` at which
   both are sampled, so equal windows contain equal sampled strings of
   ``WINDOW - PERIOD + 1`` bytes.  They get no ranks: the cover is a filter that
   tells, in buckets of fingerprints, the sampled strings that occur twice.
2. Suffixes with such a sampled string within reach are the only ones that can
   be repeated.  They are dealt into buckets, and each bucket is sorted by
   itself; neighbours with equal keys are equal windows.
3. The answers go back to the texts, which are cut accordingly.

Keys are fingerprints in place of bytes, since only equality counts: those of
the sample may collide, at the price of a suffix sorted for nothing, and those
of the suffixes have 64 bits and the bucket's, which come from another function.
The number of buckets follows the input, so with it grows the number of bits.
No window is compared by its bytes: equality rests on the fingerprints, and two
unequal windows of one fingerprint and bucket would be taken for a repetition.

Each part of the input (1 MB of texts) sends a key at most once into a bucket,
however often it holds it, and gets back one bit per key; a document that
repeats another in full sends nothing.  So no group of copies and no frequent
passage gathers in one bucket.

The same passes also run over words in place of bytes (``WORDS``): a passage of
more than 50 words that another document holds too is often shorter than a
window, so each document's words in such passages are counted beside its spans.

Defined results: a null text is empty; nothing is removed from a text shorter
than a window; whole texts count, a long one in several parts; a row that repeats a text is a copy of it like any other; a null id is
passed on; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_below, materialise, materialise_blocks, query, table
from .shingles import _POWERS, mix, utf8, words_of

WINDOW = 400
PERIOD = 183
# Perfect difference sets, every residue of 183 (of 31) is a difference of two.
COVER = (0, 12, 19, 20, 22, 43, 60, 71, 76, 85, 89, 115, 121, 168)
WORD_COVER = (1, 5, 11, 24, 25, 27)
PART = 1 << 20  # bytes of texts handled at once
DOCS = 4096  # of a chunk at most
SAMPLE_BUCKET, SUFFIX_BUCKET = 8 << 20, 2 << 20  # bytes of input to a bucket

WORD_BITS = 2  # bits by which words have fewer buckets than bytes

_U = np.uint64
_SALTS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)
_TABLES = [mix(np.arange(1, 257, dtype=_U) * _U(k)) for k in _SALTS]


@dataclass(frozen=True)
class Law:
    """Strings of ``window`` letters, sampled at a difference cover."""

    number: int
    window: int
    period: int
    cover: tuple[int, ...]

    @property
    def sampled(self) -> int:
        return self.window - self.period + 1


BYTES = Law(0, WINDOW, PERIOD, COVER)
WORDS = Law(1, 51, 31, WORD_COVER)


class Letters:
    """A chunk's texts end to end in a law's letters: bytes, or hashes of words."""

    def __init__(self, law: Law, raw: np.ndarray, sizes: np.ndarray, silent: np.ndarray, sample_bits: int, suffix_bits: int):
        self.law, self.raw, self.silent = law, raw, silent
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.sample_bits, self.suffix_bits = sample_bits, suffix_bits

    @property
    def parts(self) -> range:
        """Where parts begin; a chunk's words are one part."""
        return range(0, len(self.raw), PART if self.law is BYTES else max(1, len(self.raw)))

    def last(self, first: int) -> int:
        return min(first + self.parts.step, len(self.raw))

    def fingerprints(self, first: int, at: np.ndarray, length: int, function: int) -> np.ndarray:
        """64-bit fingerprints of the strings of ``length`` letters at ``at``
        (ascending, from ``first`` on)."""
        if not len(at):
            return np.zeros(0, _U)
        piece = self.raw[first : int(at[-1]) + length]
        values = _TABLES[function][piece] if self.law is BYTES else mix(piece + _U(_SALTS[function]))
        up, down = _POWERS.upto(len(piece))
        sums = np.zeros(len(piece) + 1, _U)
        np.cumsum(values * up, out=sums[1:])
        near = at - first
        return mix((sums[near + length] - sums[near]) * down[near])

    def _open(self, at: np.ndarray, length: int) -> np.ndarray:
        """Those positions whose string lies within a document that sends."""
        doc = np.searchsorted(self.ends, at, side="right")
        return at[(self.ends[doc] - at >= length) & ~self.silent[doc]]

    def _bucket(self, bucket: np.ndarray) -> np.ndarray:
        """Buckets of the two laws are apart."""
        return 2 * bucket.astype(np.int64) + self.law.number

    def sample(self, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sampled positions of a part, their buckets and keys of 32 bits."""
        last = self.last(first)
        grid = (np.arange(first - first % self.law.period, last, self.law.period)[:, None] + np.array(self.law.cover)).ravel()
        at = self._open(np.sort(grid[(grid >= first) & (grid < last)]), self.law.sampled)
        keys = self.fingerprints(first, at, self.law.sampled, 0) >> _U(32 - self.sample_bits)
        return at, self._bucket(keys >> _U(32)), keys.astype(np.uint32)

    def suffixes(self, first: int, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of a part with a repeated sampled string within reach,
        their buckets and keys."""
        last, period = self.last(first), self.law.period
        near = repeated[(repeated >= first) & (repeated < last + period)]
        edge = np.zeros(last - first + 1, np.int64)
        np.add.at(edge, np.clip(near - period + 1 - first, 0, last - first), 1)
        np.add.at(edge, np.clip(near + 1 - first, 0, last - first), -1)
        at = self._open(np.flatnonzero(np.cumsum(edge[:-1]) > 0) + first, self.law.window)
        bucket = self.fingerprints(first, at, self.law.window, 1)
        bucket = bucket >> _U(64 - self.suffix_bits) if self.suffix_bits else np.zeros(len(at), _U)
        return at, self._bucket(bucket), self.fingerprints(first, at, self.law.window, 2)

    def sample_marks(self, answers: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Positions of the sampled strings that occur twice."""
        out = [np.zeros(0, np.int64)]
        for first in self.parts:
            at, bucket, keys = self.sample(first)
            out.append(np.sort(at[self._twice(first, at, bucket, keys, answers, False)]))
        return np.concatenate(out)

    def suffix_marks(self, repeated: np.ndarray, answers: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Positions whose window occurs twice; for words, in another document."""
        out = [np.zeros(0, np.int64)]
        for first in self.parts:
            at, bucket, keys = self.suffixes(first, repeated)
            out.append(at[self._twice(first, at, bucket, keys, answers, self.law is WORDS)])
        return np.sort(np.concatenate(out))

    def _twice(self, part: int, at: np.ndarray, bucket: np.ndarray, keys: np.ndarray, answers: dict, documents: bool) -> np.ndarray:
        """Which of a part's strings occur twice in it, or were answered for."""
        if not len(at):
            return np.zeros(0, bool)
        order, new = _distinct(bucket, keys)
        group = np.cumsum(new) - 1
        counts = np.bincount(group)
        if documents:
            doc = np.searchsorted(self.ends, at[order], side="right")
            pairs = np.unique(group * np.int64(len(self.ends) + 1) + doc)
            counts = np.bincount(pairs // (len(self.ends) + 1))
        twice = (counts > 1) | _answered(bucket[order][new], part, answers)
        out = np.zeros(len(at), bool)
        out[order] = twice[group]
        return out


class Chunk:
    """Texts end to end, and which of them send keys."""

    def __init__(self, row: dict, sample_buckets: int, suffix_buckets: int):
        raw, sizes = np.frombuffer(row["bytes"], np.uint8), np.array(row["sizes"], np.int64)
        self.copy = np.zeros(len(sizes), bool)  # has a copy elsewhere
        silent = np.zeros(len(sizes), bool)  # and the copy speaks for it
        for at, owner in zip(row["twin_at"] or [], row["twin_owner"] or []):
            self.copy[at], silent[at] = True, not owner
        bits = int(sample_buckets).bit_length() - 1, int(suffix_buckets).bit_length() - 1
        self.bytes = Letters(BYTES, raw, sizes, silent, *bits)
        words, doc, _ = words_of(raw, self.bytes.ends) if len(raw) else (np.zeros(0, _U), np.zeros(0, np.int64), None)
        # There are some six times fewer words than bytes, so they get fewer buckets.
        self.words = Letters(WORDS, words, np.bincount(doc, minlength=len(sizes)), silent, *(max(0, b - WORD_BITS) for b in bits))
        self.laws = (self.bytes, self.words)

    def spans(self, repeated: np.ndarray, answers: dict[tuple[int, int], bytes]) -> list[list[tuple[int, int]]]:
        """Maximal removed runs of each document."""
        text = self.bytes
        starts = text.suffix_marks(repeated, answers)
        gap = np.flatnonzero(starts[1:] - starts[:-1] > WINDOW) if len(starts) else np.zeros(0, np.int64)
        out: list[list[tuple[int, int]]] = [[] for _ in text.ends]
        # A gap of exactly a window leaves no byte between; documents part runs too.
        doc = np.searchsorted(text.ends, starts, side="right")
        cut = np.flatnonzero(doc[1:] != doc[:-1]) if len(doc) else gap
        breaks = np.union1d(gap, cut)
        if len(starts):
            firsts, lasts = np.append(0, breaks + 1), np.append(breaks, len(starts) - 1)
            for a, b in zip(firsts, lasts):
                d = int(doc[a])
                out[d].append((int(starts[a] - text.starts[d]), int(starts[b] + WINDOW - text.starts[d])))
        for d in np.flatnonzero(self.copy & (text.ends - text.starts >= WINDOW)):
            out[d] = [(0, int(text.ends[d] - text.starts[d]))]
        return out

    def shared_words(self, repeated: np.ndarray, answers: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Per document the words in windows that another document holds too."""
        words = self.words
        sizes = words.ends - words.starts
        covered = np.zeros(len(words.raw) + 1, np.int64)
        starts = words.suffix_marks(repeated, answers)
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + words.law.window, -1)
        held = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
        return np.where(self.copy & (sizes >= words.law.window), sizes, held[words.ends] - held[words.starts])


def _distinct(bucket: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket and key, and where a new key begins in it."""
    if keys.dtype == np.uint32:  # one number says both
        order = np.argsort((bucket.astype(_U) << _U(32)) | keys, kind="stable")
    else:
        order = np.lexsort((keys, bucket))
    b, k = bucket[order], keys[order]
    return order, np.concatenate(([True], (b[1:] != b[:-1]) | (k[1:] != k[:-1])))


def _answered(bucket: np.ndarray, part: int, answers: dict[tuple[int, int], bytes]) -> np.ndarray:
    """The bits that the buckets sent back for a part's keys, in their order."""
    out = np.zeros(len(bucket), bool)
    if not len(bucket):
        return out
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for a, b in zip(first, np.append(first[1:], len(bucket))):
        bits = answers.get((part, int(bucket[a])))
        if bits is not None:
            out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return out


CHUNK = "chunk bigint, ids array<bigint>, sizes array<bigint>, prints array<binary>, bytes binary"
KEYS = "bucket bigint, chunk bigint, part bigint, keys binary"
ANSWER = "chunk bigint, part bigint, bucket bigint, bits binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    ids, sizes, prints, texts, held = [], [], [], [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([(task << 32) | number]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
            pa.array([prints], pa.list_(pa.binary())), pa.array([b"".join(texts)], pa.binary()),
        ], ["chunk", "ids", "sizes", "prints", "bytes"])

    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        raw = raw.tobytes()
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            text = raw[offsets[i] : offsets[i + 1]]
            if ids and (held + len(text) > PART or len(ids) == DOCS):
                yield row()
                number += 1
                ids, sizes, prints, texts, held = [], [], [], [], 0
            ids.append(doc_id)
            sizes.append(len(text))
            prints.append(hashlib.blake2b(text, digest_size=16).digest())
            texts.append(text)
            held += len(text)
    if ids:
        yield row()


def _mark(dtype: str):
    """Sort one bucket; a key that two parts sent is answered with a bit."""

    def run(group: pa.Table) -> pa.Table:
        sent = [np.frombuffer(k.as_buffer(), dtype) for k in group.column("keys")]
        sizes = np.array([len(k) for k in sent])
        keys = np.concatenate(sent)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        parts = np.split(twice, np.cumsum(sizes)[:-1])
        some = np.array([bool(p.any()) for p in parts])
        answered = group.filter(pa.array(some)).select(["chunk", "part", "bucket"])
        bits = [np.packbits(p).tobytes() for p, s in zip(parts, some) if s]
        return answered.append_column("bits", pa.array(bits, pa.binary()))

    return run


def _sent(chunk: int, part: int, bucket: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """One row per bucket of sorted keys."""
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(bucket))
    return pa.RecordBatch.from_arrays([
        pa.array(bucket[first], pa.int64()), pa.array(np.full(len(first), chunk)), pa.array(np.full(len(first), part)),
        pa.array([keys[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
    ], ["bucket", "chunk", "part", "keys"])


def _answers(rows: list[dict] | None) -> dict[tuple[int, int], bytes]:
    return {(r["part"], r["bucket"]): r["bits"] for r in rows or []}


def _answer_lists(answers: DataFrame, name: str) -> DataFrame:
    """The answers of each chunk in one row: at most a bit per byte of it."""
    gathered = answers.groupBy("chunk").agg(F.collect_list(F.struct("part", "bucket", "bits")).alias(name))
    return materialise_blocks(gathered, name)


def _size(answers: str) -> Column:
    return F.aggregate(answers, F.lit(0).cast("bigint"), lambda a, x: a + 40 + F.octet_length(x["bits"]))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (start, end in bytes), kept (the bytes that stay)
    and n_shared_words (words in runs of 51 or more that another document holds
    too) of every row of ``docs`` (doc_id, text).  ``docs`` is read once."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = materialise_blocks(named.mapInArrow(_pack, CHUNK), "suffix-chunks")
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("sizes", "prints")).alias("at", "d"))
    place = F.shiftleft("chunk", 12) + F.col("at")
    placed = each.select(place.alias("place"), F.col("d.prints").alias("print"), F.col("d.sizes").alias("size"))
    total = placed.agg(F.sum("size").alias("n")).first()["n"] or 0
    sample_buckets, suffix_buckets = (1 << max(0, (total // size).bit_length()) for size in (SAMPLE_BUCKET, SUFFIX_BUCKET))

    # Copies of whole texts: one of them speaks for all.
    owners = placed.where(F.col("size") >= WINDOW).groupBy("print").agg(F.min("place").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    owners = materialise(owners, "suffix-owners")
    twins = placed.join(broadcast_below(owners, F.lit(40)), "print").groupBy(F.shiftright("place", 12).alias("chunk")).agg(
        F.collect_list(F.struct(F.col("place").bitwiseAND(F.lit(DOCS - 1)).cast("int").alias("at"), (F.col("place") == F.col("owner")).alias("owner"))).alias("t")
    )
    twins = materialise(twins.select("chunk", F.col("t.at").alias("twin_at"), F.col("t.owner").alias("twin_owner")), "suffix-twins")
    texts = chunks.drop("prints").join(broadcast_below(twins, F.size("twin_at") * 8), "chunk", "left")

    def send_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row, sample_buckets, suffix_buckets)
            for letters in chunk.laws:
                for part in letters.parts:
                    _, bucket, keys = letters.sample(part)
                    if len(keys):
                        order, new = _distinct(bucket, keys)
                        yield _sent(row["chunk"], part, bucket[order][new], keys[order][new])

    sampled = texts.drop("ids").mapInArrow(send_sample, KEYS).groupBy("bucket").applyInArrow(_mark("<u4"), ANSWER)
    ranks = _answer_lists(sampled, "suffix-ranks")
    texts = texts.join(broadcast_below(ranks.withColumnRenamed("suffix-ranks", "ranks"), _size("ranks")), "chunk", "left")

    def send_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row, sample_buckets, suffix_buckets)
            answers = _answers(row["ranks"])
            for letters in chunk.laws:
                repeated = letters.sample_marks(answers)
                for part in letters.parts:
                    at, bucket, keys = letters.suffixes(part, repeated)
                    if len(at):
                        order, new = _distinct(bucket, keys)
                        yield _sent(row["chunk"], part, bucket[order][new], keys[order][new])

    sorted_ = texts.drop("ids").mapInArrow(send_suffixes, KEYS).groupBy("bucket").applyInArrow(_mark("<u8"), ANSWER)
    found = _answer_lists(sorted_, "suffix-found")
    texts = texts.join(broadcast_below(found.withColumnRenamed("suffix-found", "found"), _size("found")), "chunk", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row, sample_buckets, suffix_buckets)
            ranks, found = _answers(row["ranks"]), _answers(row["found"])
            spans = chunk.spans(chunk.bytes.sample_marks(ranks), found)
            shared = chunk.shared_words(chunk.words.sample_marks(ranks), found)
            kept = []
            for start, end, cuts in zip(chunk.bytes.starts.tolist(), chunk.bytes.ends.tolist(), spans):
                edges = [start, *[start + x for span in cuts for x in span], end]
                kept.append(b"".join(row["bytes"][a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([
                pa.array(row["ids"], pa.int64()), pa.array(row["sizes"], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.binary()), pa.array(shared, pa.int64()),
            ], ["doc_id", "n_bytes", "spans", "kept", "n_shared_words"])

    return texts.mapInArrow(
        cut, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary, n_shared_words bigint"
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return cleaned.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), "n_shared_words",
    )
