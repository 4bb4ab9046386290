"""The corpus pipeline: five stages from raw documents to packed sequences.

1. ``quality`` drops documents that the classifier rejects.
2. ``near_duplicates`` keeps one document of each group of near copies
   (shingles of five words, similarity 0.8).
3. ``secrets`` replaces secrets in the texts.
4. ``mix`` repeats documents until each source has its target share; a document
   that is read twice is two rows, one that is left out is none.
5. ``pack`` cuts the texts into token pieces and packs these into sequences.

Each stage takes the documents its predecessor kept, as a written table, and
all but the last return the columns of the documents.  A null or empty text, a
null source or id, repeated rows and empty tables have the results that the
operators' docstrings state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logloom.llm.common import materialise, table
from logloom.llm.minhash import dedupe
from logloom.llm.mixing import mix
from logloom.llm.packing import packed
from logloom.llm.quality import keep_good
from logloom.llm.secret_scan import redact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedupe(docs, words=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mix", mixture),
    ("pack", pack),
]

# The classifier, the sketches and the tokenizer are beyond SQL; the tests hold
# the stages against plain programs instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
