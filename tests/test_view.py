import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import ids, view


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_sort_numbers_by_value_and_text_without_case(events):
    by_id = view.sort_rows(events, [{"column": "EventId", "dir": "asc"}, {"column": "nope"}])
    assert [r["rid"] for r in by_id.collect()] == [3, 4, 1, 2]
    by_user = view.sort_rows(events, [{"column": "User", "dir": "desc"}])
    assert [r["rid"] for r in by_user.collect()] == [2, 1, 3, 4]


def test_positions_are_dense_and_sorted_with_a_hot_value(spark):
    rng = random.Random(5)
    rows = [(1, i + 1, rng.choice(["hot", "hot", rng.choice("abc")])) for i in range(3000)]
    df = spark.createDataFrame(rows, "source_id int, rid bigint, v string").repartition(5)
    got = pairs(ids.with_position(df, [F.col("v").desc(), F.col("rid")]).orderBy("pos"), "pos", "rid")
    wanted = [r[1] for r in sorted(sorted(rows, key=lambda r: r[1]), key=lambda r: r[2], reverse=True)]
    assert got == list(enumerate(wanted, start=1))


def test_window_equals_slice_of_the_whole_view(spark):
    df = spark.range(1000).select(F.lit(1).alias("source_id"), (F.col("id") + 1).alias("rid"), (F.col("id") * 7919 % 1000).cast("string").alias("v"))
    ordered = view.build_view(df, {"sort": [{"column": "v", "dir": "asc"}]})
    every = sorted(pairs(ordered.frame, "pos", "rid"))
    assert ordered.count == 1000
    for start, count in [(1, 10), (250, 300), (990, 50), (1001, 5), (1, 1000), (500, 1)]:
        assert sorted(pairs(ordered.window(start, count), "pos", "rid")) == every[start - 1: start - 1 + count]


def test_empty_view(events):
    empty = view.build_view(events, {"filters": [{"column": "User", "op": "equals", "value": "nobody"}]})
    assert empty.count == 0 and empty.frame.count() == 0 and empty.window(1, 10).count() == 0


def test_page_carries_tags_and_notes(spark, events):
    tags = spark.createDataFrame([(1, 3, 2), (1, 3, 1)], "source_id int, rid bigint, tag_id int")
    notes = spark.createDataFrame([(1, 1, "look")], "source_id int, rid bigint, note string")
    ordered = view.build_view(events, {"sort": [{"column": "Timestamp", "dir": "desc"}]})
    rows = pairs(view.page(ordered, events, 1, 3, tags, notes), "pos", "rid", "tag_ids", "note")
    assert rows == [(1, 3, [1, 2], None), (2, 2, [], None), (3, 1, [], "look")]
    assert pairs(view.find_position(ordered, 1, 1), "pos") == [(3,)]
    assert pairs(view.tag_positions(ordered, tags), "pos", "tag_id") == [(1, 1), (1, 2)]
    assert pairs(view.page_unsorted(events, 1, 2, 2), "pos", "rid") == [(2, 2), (3, 3)]


def test_apply_spec_needs_tags_only_for_tag_filters(spark, events, rids):
    tags = spark.createDataFrame([(1, 1, 7), (2, 2, 7)], "source_id int, rid bigint, tag_id int")
    spec = {"search": "ALICE", "tags": ["7"], "time_range": {"enabled": False, "start": "2030-01-01"}}
    assert rids(view.apply_spec(events, spec, tags)) == [1]
    assert rids(view.apply_spec(events, {"tags": ["__none__"]}, tags)) == [2, 3, 4]
    with pytest.raises(ValueError):
        view.apply_spec(events, spec)


def test_nearest(events):
    assert pairs(view.nearest_timestamp(events, "2024-01-05 11:00:00"), "rid", "ts", "distance_seconds") == [(2, "2024-01-05 11:30:00", 1800)]
    assert pairs(view.nearest_timestamp(events, "2030-01-01"), "rid") == [(4,)]
    with pytest.raises(ValueError):
        view.nearest_timestamp(events, "whenever")
    with pytest.raises(ValueError):
        view.nearest_timestamp(events, "2024-01-05", column="User")


@pytest.mark.parametrize("block_rows", [1, 3, 10, 1000])
def test_count_drops_against_a_walk(spark, block_rows):
    rng = random.Random(block_rows)
    rows = [(s, i + 1, rng.choice([None, 1, 2, 3, 12])) for s in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "source_id int, rid bigint, mark int").repartition(3)
    got = {(r["source_id"], r["rid"]): r["n"] for r in ids.count_drops(df, "mark", "n", block_rows).collect() if r["mark"] is not None}
    wanted = {}
    for source in (1, 2):
        drops, last = 0, None
        for s, rid, mark in rows:
            if s == source and mark is not None:
                drops += last is not None and mark < last
                last = mark
                wanted[s, rid] = drops
    assert got == wanted


def test_row_ids_in_given_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "v string")
    assert pairs(ids.with_row_id(df, [F.col("v")]).orderBy("rid"), "rid", "v") == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(r["rid"] for r in ids.with_row_id(spark.range(50).repartition(4)).collect()) == list(range(1, 51))
