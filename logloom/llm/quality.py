"""Document quality by regularised quadratic discriminant analysis.

A document becomes a vector of transformed statistics of its text (lengths,
shares of kinds of characters, repetition of words, word pairs and lines).
For each class the mean and a shrunken covariance are fitted: the class's own
covariance is pulled towards that of both classes, and that towards the
identity.  The score is a logistic curve of the difference of the two
log-densities, each a Mahalanobis distance through the class's Cholesky factor,
which is computed once.

Statistics are whole multiples of 1/4096, so sums over documents are exact and
the model does not depend on how the rows are spread.  Fitting adds up one
vector of products per batch; only those sums, a few hundred numbers, come to
the driver, and every labelled row outside the held-out third counts.

Defined results: a null, empty or blank text has the statistics of no text and
gets a score like any other; a label that is null, or a document with labels
that disagree, teaches nothing; without labelled rows of both classes every
score is one half and everything counts as good; repeated rows are scored alike;
``keep_good`` passes all columns on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_below, materialise, prepare, query, table
from .shingles import STEP, utf8, words_of

GRAIN = 4096
OWN, SHARED = 0.9, 0.98  # weight of the class's covariance, and of covariances against the identity
FEATURES = (
    "words", "bytes_per_word", "upper", "digits", "marks", "symbols", "other_bytes", "distinct_words", "top_word",
    "distinct_pairs", "repeated_lines", "line_length", "capital_words", "marked_words",
)

_KINDS = np.zeros((6, 256), np.int64)  # upper, digit, mark, symbol, beyond ASCII, space
_KINDS[0, 65:91] = 1
_KINDS[1, 48:58] = 1
_KINDS[2, [ord(c) for c in ".,;:'\"!?()-"]] = 1
_KINDS[3, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"!?()-"]] = 1
_KINDS[4, 192:256] = 1
_KINDS[5, [9, 10, 11, 12, 13, 32]] = 1
_LINE = np.zeros(256, bool)
_LINE[[10, 13]] = True


def _repeats(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: distinct keys, weight of repeats beyond the first, count of the commonest key."""
    if not len(doc):
        return np.zeros(n), np.zeros(n), np.zeros(n)
    order = np.lexsort((key, doc))
    d, k, w = doc[order], key[order], weight[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])))
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(d)))
    top = np.zeros(n)
    np.maximum.at(top, d[at], counts)
    return np.bincount(d[at], minlength=n), np.bincount(d, weights=w * ~new, minlength=n), top


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of whole numbers (multiples of 1/GRAIN) per document."""
    n, i, out = len(offsets) - 1, 0, []
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, side="right")) - 1)
        out.append(_statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        i = j
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)), np.int64)


def _statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    n, ends = len(at) - 1, at[1:]
    size = np.diff(at).astype(float)
    doc_of = np.repeat(np.arange(n), np.diff(at))
    histogram = np.bincount(doc_of * 256 + raw, minlength=n * 256).reshape(n, 256)
    upper, digit, mark, symbol, other, space = (histogram @ kind for kind in _KINDS)
    word, doc, first = words_of(raw, ends)
    words = np.bincount(doc, minlength=n).astype(float)
    distinct, _, top = _repeats(doc, word, np.ones(len(doc)), n)
    same = doc[1:] == doc[:-1]
    pair = (word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:])[same]
    pairs, _, _ = _repeats(doc[1:][same], pair, np.ones(int(same.sum())), n)
    lines, line_doc, line_first = words_of(raw, ends, _LINE)
    stop = np.append(line_first[1:], len(raw))
    line_bytes = np.minimum(stop, ends[line_doc] if len(line_doc) else stop[:0]) - line_first if len(lines) else np.zeros(0)
    _, repeated, _ = _repeats(line_doc, lines, line_bytes, n)
    line_count = np.bincount(line_doc, minlength=n)
    capital = np.bincount(doc, weights=_KINDS[0][raw[first]], minlength=n) if len(first) else np.zeros(n)
    after = (_KINDS[5][raw[1:]] == 1) & (doc_of[1:] == doc_of[:-1])
    ends_marked = np.bincount(doc_of[:-1][after], weights=_KINDS[3][raw[:-1]][after] + (raw[:-1][after] == 33), minlength=n) if len(raw) > 1 else np.zeros(n)
    solid = size - space
    total_pairs = np.maximum(words - 1, 0)

    def rate(part: np.ndarray, whole: np.ndarray, usual: float, weight: float) -> np.ndarray:
        """Log of a share, as if ``weight`` more had been seen at the usual
        share: little text is little evidence."""
        return np.log((part + usual * weight) / (whole + weight))

    columns = [
        np.log(words + 20), rate(solid, words, 5.0, 20), rate(upper, solid, 0.02, 100), rate(digit, solid, 0.002, 100),
        rate(mark, solid, 0.03, 100), rate(symbol, solid, 0.002, 100), rate(other, solid, 0.02, 100),
        rate(distinct, words, 1.0, 20), rate(top, words, 0.06, 20), rate(pairs, total_pairs, 1.0, 20),
        rate(repeated, size, 0.002, 500), rate(size, line_count, 200.0, 3), rate(capital, words, 0.1, 20),
        rate(ends_marked, words, 0.002, 20),
    ]
    return np.rint(np.stack(columns, 1) * GRAIN).astype(np.int64)


def statistics_of(text: Column) -> Column:
    """The statistics of a text column as array<bigint>."""

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        rows = statistics(*utf8(texts))
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)
        return pa.ListArray.from_arrays(offsets, rows.ravel())

    return run(text.cast("string"))


@dataclass(frozen=True)
class Model:
    """Per class: mean, inverse Cholesky factor and log-determinant term."""

    means: np.ndarray
    factors: np.ndarray
    logs: np.ndarray
    lean: float  # log of the classes' odds

    def score(self, x: np.ndarray) -> np.ndarray:
        density = []
        for mean, factor, log in zip(self.means, self.factors, self.logs):
            z = (x / GRAIN - mean) @ factor.T
            density.append(-0.5 * (z * z).sum(1) - log)
        # Divided by the dimension, far from one half scores still differ.
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0] + self.lean) / x.shape[1], -30, 30)))


def solve(count: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Model | None:
    """The model from both classes' counts, sums and sums of products."""
    if count.min() < 2:
        return None
    means = sums / count[:, None]
    own = products / count[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (own * count[:, None, None]).sum(0) / count.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    factors, logs = [], []
    for c in range(2):
        covariance = OWN * own[c] + (1 - OWN) * pooled
        covariance = SHARED * covariance + (1 - SHARED) * np.diag(scale**2)
        lower = np.linalg.cholesky(covariance)
        factors.append(np.linalg.inv(lower))
        logs.append(np.log(np.diag(lower)).sum())
    return Model(means, np.array(factors), np.array(logs), float(np.log(count[1] / count[0])))


def fit(labelled: DataFrame) -> Model | None:
    """``labelled`` has x (statistics) and y (0 or 1)."""
    d = len(FEATURES)
    at = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 + d + len(at[0])
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                part = x[y == c]
                total[c] += np.concatenate([[len(part)], part.sum(0), (part.T @ part)[at]])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat([0, 1], size), pa.int32()), pa.array(np.tile(np.arange(size), 2), pa.int32()),
            pa.array(total.ravel()),
        ], ["y", "i", "v"])

    sums = labelled.select("x", "y").mapInArrow(partial, "y int, i int, v bigint")
    rows = sums.groupBy("y", "i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect()
    total = np.zeros((2, 1 + d + len(at[0])))
    for r in rows:
        total[r["y"], r["i"]] = float(r["v"])
    products = np.zeros((2, d, d))
    for c in (0, 1):
        products[c][at] = total[c, 1 + d :] / GRAIN**2
        products[c] = products[c] + np.triu(products[c], 1).T
    return solve(total[:, 0], total[:, 1 : 1 + d] / GRAIN, products)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training(features: DataFrame, labels: DataFrame) -> DataFrame:
    """x and y of the rows that may be learnt from; ``features`` has doc_id, x."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("most")).where("y = most")
        .select("doc_id", "y")
    )
    known = materialise(known, "quality-labels")
    return features.join(broadcast_below(known, F.lit(16)), "doc_id").select("x", "y")


def score_of(model: Model | None, x: Column) -> Column:
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(rows.flatten().to_numpy().reshape(-1, len(FEATURES)).astype(float)))

    return run(x)


def text_score(model: Model | None, text: Column) -> Column:
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(*utf8(texts)).astype(float)))

    return run(text.cast("string"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that score below one half.  The texts are read
    twice, and only labelled ones for the fit."""
    prepare(docs.sparkSession)
    known = labels.select("doc_id").distinct()
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = materialise(known, "quality-known")
    few = named.join(broadcast_below(known, F.lit(8)), "doc_id", "left_semi")
    features = materialise(few.select("doc_id", statistics_of(F.col("text")).alias("x")), "quality-features")
    model = fit(training(features, labels))
    return docs if model is None else docs.where(text_score(model, F.col(text)) >= 0.5)


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    features = materialise(docs.select("doc_id", statistics_of(F.col("text")).alias("x")), "quality-features")
    model = fit(training(features, table(spark, sf_dir, "labels")))
    return features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_of(model, F.col("x")).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)
    )
