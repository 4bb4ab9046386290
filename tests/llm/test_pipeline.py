"""The pipeline's stages, each on its own input."""

from collections import Counter

import odd
import pytest

import corpus_pipeline as pipeline
from test_documents_queries import near_groups


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("which", ["odd_tables", "empty_tables"])
def test_stages_keep_the_columns(spark, request, which, tmp_path):
    folder = request.getfixturevalue(which)
    docs = docs_of(spark, folder)
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert (docs.count() > 0) == (which == "odd_tables")
    assert pipeline.run(spark, folder).count() == docs.count()


def test_quality_keeps_good_documents(spark):
    folder = "/root/testdata/sf0.01"
    kept = {r["doc_id"] for r in pipeline.quality(spark, docs_of(spark, folder), folder).select("doc_id").collect()}
    for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
        if r["quality"] == 1:
            assert r["doc_id"] in kept or r["doc_id"] % 50 == 0
    bad = [r["doc_id"] not in kept for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r["quality"] == 0]
    assert sum(bad) >= 0.95 * len(bad)


def test_one_document_of_each_group_stays(spark, odd_tables):
    rows = odd.texts()
    sets, root = near_groups([t for _, t, _ in rows], 5, 80)
    wanted = Counter()
    groups = {}
    for (d, t, _), s, r in zip(rows, sets, root):
        if s:
            groups.setdefault(r, []).append((d is None, d))
        else:
            wanted[d] += 1
    for held in groups.values():
        wanted[min(held, key=lambda x: (x[0], x[1] or 0))[1]] += 1
    kept = pipeline.near_duplicates(spark, docs_of(spark, odd_tables), odd_tables)
    assert Counter(r["doc_id"] for r in kept.collect()) == wanted


def test_secrets_are_masked(spark, odd_tables):
    out = {r["doc_id"]: r for r in pipeline.secrets(spark, docs_of(spark, odd_tables), odd_tables).where("doc_id >= 20").collect()}
    before = {d: t for d, t, _ in odd.texts()}
    assert "hunter2" not in out[26]["text"] and "deadbeefdead" not in out[26]["text"] and "AKIAABC" not in out[26]["text"]
    assert "AKIASHORT" in out[26]["text"] and out[26]["text"].startswith('[SECRET]" token=ab secret=token:abcdefgh [SECRET]')
    assert out[26]["n_chars"] == len(out[26]["text"])
    assert out[21]["text"] == before[21] and out[27]["text"].startswith("naïve élan 漢字")


def test_mixture_repeats_whole_documents(spark, odd_tables):
    from logloom.llm.queries import QUERIES

    taken = Counter()
    for r in QUERIES["op1_mix_sources"](spark, odd_tables).collect():
        taken[r["doc_id"]] += r["taken"]
    mixed = Counter()
    for r in pipeline.mixture(spark, docs_of(spark, odd_tables), odd_tables).collect():
        mixed[r["doc_id"]] += len((r["text"] or "").split(None))
    size = {d: len((t or "").split(None)) for d, t, _ in odd.texts()}
    assert all(mixed[d] == taken[d] for d in size if d is not None and d != 27)
