"""Aligning two tokenizers over the same texts.

Side A encodes a space and the text with a byte-level BPE, side B the text with
a piece model that puts the space itself.  Both token rows cover the same bytes,
so they can be laid over each other: an A and a B token are linked where their
byte ranges overlap, and a group ends where both sides end a token.

In a task, all texts of a part of the input (``PART`` bytes of texts) lie behind
each other on one byte axis.  Two ``pandas.merge_asof`` joins, keyed by document,
find for every token start the other side's covering token; the union of both
directions is every overlap, since of two overlapping tokens the later one
starts inside the other.  Very long parts are worked off in slices that end with
a group, so what is held besides the token ids does not grow with a text.

How often an id pair is linked in the whole corpus is found without moving
links: a part sends each of its distinct pairs once, with a count; the totals,
one row per pair, go back to the parts that hold the pair, and there each
document adds them up over its links.  A pair that every part holds is one row a
part.  The documents' own pairs are joined with their part's answers by part, a
group bounded by ``PART`` (or by one text that is longer).

Defined results: a text that is null or empty, or that one of the tokenizers
does not give back byte for byte, has no tokens, zero counts, and an empty
``groups_sha256``; repeated rows and rows without an id are rows of their own,
and their links count as often; ties for a B id's highest count are all best; an
empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_below, materialise, prepare, query, table
from .tokens import byte_ranks

PART = 2 << 20  # bytes of texts
SLICE = 1 << 18  # tokens of a side laid out at once


@dataclass(frozen=True)
class Files:
    """The ranks of side A and the piece model of side B, under the same path on
    every machine."""

    ranks: str
    pieces: str


def public_files() -> Files:
    import public_tokenizers

    return Files(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))


class Side:
    """A tokenizer's ids and, by id, the bytes they stand for."""

    def __init__(self, entries: list[bytes], within: bytes, last: bytes):
        self.size = len(entries)
        self.bytes = np.array([*entries, None], object)[:-1]
        self.length = np.array([len(e) for e in entries], np.int64)
        # An id's text inside a group, and where its side of the group ends.
        self.text = np.array([b"%d" % i + end for end in (within, last) for i in range(self.size)], object)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes[ids].tolist())


class Both:
    def __init__(self, files: Files):
        import sentencepiece

        self.encoding = byte_ranks(files.ranks)
        entries = self.encoding.token_byte_values()
        by_id = [b""] * (max(self.encoding.encode_single_token(e) for e in entries) + 1)
        for e in entries:
            by_id[self.encoding.encode_single_token(e)] = e
        self.model = sentencepiece.SentencePieceProcessor(model_file=files.pieces)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        b = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a, self.b = Side(by_id, b",", b"|"), Side(b, b",", b";")

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both sides, or none where a side changes the bytes."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        whole = (" " + text).encode()
        a = self.encoding.encode_to_numpy(" " + text, allowed_special=set(), disallowed_special=()).astype(np.int64)
        b = np.asarray(self.model.encode(text, out_type="numpy", num_threads=1)).astype(np.int64)
        return (a, b) if self.a.joined(a) == whole and self.b.joined(b) == whole else (none, none)


def links(starts_a: np.ndarray, doc_a: np.ndarray, starts_b: np.ndarray, doc_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all overlapping (A, B) tokens, from their starts on one axis."""
    a = pd.DataFrame({"at": starts_a, "doc": doc_a, "a": np.arange(len(starts_a))})
    b = pd.DataFrame({"at": starts_b, "doc": doc_b, "b": np.arange(len(starts_b))})
    over_a = pd.merge_asof(a, b, on="at", by="doc")["b"].to_numpy()
    over_b = pd.merge_asof(b, a, on="at", by="doc")["a"].to_numpy()
    inside = starts_a[over_b] < starts_b  # equal starts are found from either side
    return np.concatenate([a["a"].to_numpy(), over_b[inside]]), np.concatenate([over_a, b["b"].to_numpy()[inside]])


@dataclass
class Laid:
    """Per document of a part: counts, group texts' hashes and distinct pairs."""

    n_groups: np.ndarray
    n_links: np.ndarray
    hashes: list[str]
    doc: np.ndarray  # of each distinct (document, pair)
    pair: np.ndarray
    times: np.ndarray


def lay(both: Both, ids_a: list[np.ndarray], ids_b: list[np.ndarray]) -> Laid:
    n = len(ids_a)
    count_a, count_b = (np.array([len(x) for x in side], np.int64) for side in (ids_a, ids_b))
    a, b = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (ids_a, ids_b))
    end_a, end_b = np.cumsum(both.a.length[a]), np.cumsum(both.b.length[b])
    doc_a, doc_b = np.repeat(np.arange(n), count_a), np.repeat(np.arange(n), count_b)
    ends = np.intersect1d(end_a, end_b, assume_unique=True)  # of groups
    n_groups = np.bincount(doc_a[np.searchsorted(end_a, ends)], minlength=n) if len(ends) else np.zeros(n, np.int64)
    n_links = np.zeros(n, np.int64)
    states: dict[int, object] = {}
    found: list[tuple[np.ndarray, np.ndarray]] = []
    span = both.a.size * both.b.size
    i = j = g = 0
    while i < len(a):
        # A slice ends with the last group that fits, with one group at least.
        limit = end_a[min(i + SLICE, len(a)) - 1]
        h = max(int(np.searchsorted(ends, limit, side="right")), g + 1)
        i2, j2 = (int(np.searchsorted(e, ends[h - 1])) + 1 for e in (end_a, end_b))
        sa, sb, cut = slice(i, i2), slice(j, j2), ends[g:h]
        at_a, at_b = links(end_a[sa] - both.a.length[a[sa]], doc_a[sa], end_b[sb] - both.b.length[b[sb]], doc_b[sb])
        doc = doc_a[sa][at_a]
        n_links += np.bincount(doc, minlength=n)
        found.append(np.unique(doc * span + a[sa][at_a] * both.b.size + b[sb][at_b], return_counts=True))
        group_a, group_b = np.searchsorted(cut, end_a[sa]), np.searchsorted(cut, end_b[sb])
        texts = np.empty(i2 - i + j2 - j, object)
        place_a = np.arange(i2 - i) + np.searchsorted(group_b, group_a, side="left")
        place_b = np.arange(j2 - j) + np.searchsorted(group_a, group_b, side="right")
        texts[place_a] = both.a.text[a[sa] + both.a.size * (cut[group_a] == end_a[sa])]
        texts[place_b] = both.b.text[b[sb] + both.b.size * (cut[group_b] == end_b[sb])]
        for d in range(int(doc_a[i]), int(doc_a[i2 - 1]) + 1):
            low = np.searchsorted(doc_a[sa], d) + np.searchsorted(doc_b[sb], d)
            high = np.searchsorted(doc_a[sa], d, side="right") + np.searchsorted(doc_b[sb], d, side="right")
            if low < high:
                text = b"".join(texts[low:high].tolist())[:-1]
                if d in states:
                    states[d].update(b";" + text)
                else:
                    states[d] = hashlib.sha256(text)
        i, j, g = i2, j2, h
    keys = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in found)])
    times = np.concatenate([np.zeros(0, np.int64), *(c for _, c in found)])
    if len(found) > 1:
        keys, where = np.unique(keys, return_inverse=True)
        times = np.bincount(where, weights=times, minlength=len(keys)).astype(np.int64)
    hashes = [states[d].hexdigest() if d in states else "" for d in range(n)]
    return Laid(n_groups, n_links, hashes, keys // span, keys % span, times)


COUNTED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
PLACED = f"part bigint, {COUNTED}, pairs array<bigint>, times array<bigint>, part_pairs array<bigint>, part_times array<bigint>"


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))


def _aligned(files: Files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part = None, TaskContext.get().partitionId() << 32
        for batch in batches:
            both = both or Both(files)
            docs, texts, size = [], [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                docs.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= PART:
                    yield rows(both, part, docs, texts)
                    part, docs, texts, size = part + 1, [], [], 0
            if docs:
                yield rows(both, part, docs, texts)
                part += 1

    def rows(both: Both, part: int, docs: list, texts: list) -> pa.RecordBatch:
        ids = [both.encode(t) for t in texts]
        laid = lay(both, [a for a, _ in ids], [b for _, b in ids])
        n = len(docs)
        bounds = np.searchsorted(laid.doc, np.arange(n + 1))
        every, where = np.unique(laid.pair, return_inverse=True)
        totals = np.bincount(where, weights=laid.times, minlength=len(every)).astype(np.int64)
        first = np.concatenate([[0], np.full(n, len(every))])  # the part's pairs stand in its first row
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, part, np.int64)), pa.array([d.as_py() for d in docs], pa.int64()),
            pa.array([len(a) for a, _ in ids], pa.int64()), pa.array([len(b) for _, b in ids], pa.int64()),
            pa.array(laid.n_groups, pa.int64()), pa.array(laid.n_links, pa.int64()), pa.array(laid.hashes, pa.string()),
            _lists(laid.pair, bounds), _lists(laid.times, bounds), _lists(every, first), _lists(totals, first),
        ], [f.split()[0] for f in PLACED.split(", ")])

    return run


def pair_totals(placed: DataFrame, size_b: int) -> DataFrame:
    """(pair, total, best): how often each id pair is linked, and whether no
    other pair of its B id is linked more often."""
    sent = placed.select(F.explode(F.arrays_zip("part_pairs", "part_times")).alias("p"))
    totals = materialise(sent.groupBy(F.col("p.part_pairs").alias("pair")).agg(F.sum("p.part_times").alias("total")), "pair-totals")
    b = (F.col("pair") % size_b).alias("b")
    most = totals.groupBy(b).agg(F.max("total").alias("most"))
    return totals.select("*", b).join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def _summed(docs: pa.Table, answers: pa.Table) -> pa.Table:
    known = answers.column("pair").to_numpy()
    order = np.argsort(known)
    total = answers.column("total").to_numpy()[order]
    best = answers.column("best").to_numpy()[order]
    pairs, times = (docs.column(c).combine_chunks() for c in ("pairs", "times"))
    at = np.searchsorted(known[order], pairs.flatten().to_numpy())
    often = times.flatten().to_numpy()
    doc = np.repeat(np.arange(len(docs)), pairs.value_lengths().to_numpy())

    def per_document(values: np.ndarray) -> pa.Array:
        sums = np.zeros(len(docs), np.int64)
        np.add.at(sums, doc, values)
        return pa.array(sums)

    names = [f.split()[0] for f in COUNTED.split(", ")]
    return docs.select(names).append_column("n_best", per_document(often * best[at])).append_column("count_sum", per_document(often * total[at]))


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", files: Files | None = None) -> DataFrame:
    """One row per document: token, group and link counts, the hash of its
    groups, and its links' counts in the whole corpus."""
    import sentencepiece

    prepare(docs.sparkSession)
    files = files or public_files()
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    placed = materialise(named.mapInArrow(_aligned(files), PLACED), "aligned")
    size_b = sentencepiece.SentencePieceProcessor(model_file=files.pieces).get_piece_size()
    totals = materialise(pair_totals(placed, size_b), "pairs")
    asked = placed.select(F.col("part").alias("asker"), F.explode("part_pairs").alias("pair"))
    answers = asked.join(broadcast_below(totals, F.lit(17)), "pair")
    own = placed.drop("part_pairs", "part_times")
    return own.groupBy("part").cogroup(answers.groupBy("asker")).applyInArrow(_summed, f"{COUNTED}, n_best bigint, count_sum bigint")


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
