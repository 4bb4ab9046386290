"""Joins of the pipeline broadcast what was measured, not what Spark takes for small."""

import functools
from collections import Counter

import odd
import pytest
from pyspark.sql import functions as F

from logloom.llm import common, components, minhash, mixing


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def docs(spark):
    """300 documents, 40 of them near copies of the first; small for Spark."""
    first = odd.words(1, 100)
    rows = [(i, f"{first} {odd.words(i, 2)}" if i < 41 else odd.words(i, 60), f"s{i % 3}") for i in range(300)]
    return common.materialise(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "test-docs")


def test_a_table_beyond_the_limit_is_not_broadcast(spark):
    rows = common.materialise(spark.range(1000).select("id", F.lit(1).alias("one")), "test-rows")
    for how in ("inner", "left_semi", "left_anti", "left"):
        beyond = rows.join(common.broadcast_below(rows, F.lit(8), 1000), "id", how)
        assert "Broadcast" not in plan(beyond) and beyond.count() == (0 if how == "left_anti" else 1000)
        assert "Broadcast" in plan(rows.join(common.broadcast_below(rows, F.lit(8)), "id", how))


def test_near_duplicates_broadcast_no_unmeasured_side(docs, monkeypatch):
    plans = []

    def written(df, label):
        plans.append((label, plan(df)))
        return common.materialise(df, label)

    for module in (minhash, components):
        monkeypatch.setattr(module, "materialise", written)
    # Whatever is measured is too much.
    monkeypatch.setattr(minhash, "broadcast_below", functools.partial(common.broadcast_below, limit=0))
    monkeypatch.setattr(components, "BROADCAST_ROWS", 0, raising=False)
    kept = minhash.dedupe(docs)
    plans.append(("kept", plan(kept)))
    assert {label for label, p in plans if "Broadcast" in p} == set()
    assert {"near-members", "near-wanted", "near-groups", "near-dropped", "edges"} <= {label for label, p in plans}
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, *range(41, 300)]


def test_sources_are_broadcast_by_their_bytes(docs, monkeypatch):
    few = Counter(mixing.mix(docs).collect())
    assert "Broadcast" in plan(mixing.mix(docs))
    monkeypatch.setattr(mixing, "broadcast_below", functools.partial(common.broadcast_below, limit=0), raising=False)
    mixed = mixing.mix(docs)
    assert "Broadcast" not in plan(mixed)
    assert Counter(mixed.collect()) == few
