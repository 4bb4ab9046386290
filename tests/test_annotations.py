import random

import pytest

from logloom.operators import annotations as a

TAGS = "source_id int, rid bigint, tag_id int"
NOTES = "source_id int, rid bigint, note string"
DEFS = "id int, name string, color string, hotkey string"


def table(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("on", [True, False])
def test_revert_is_the_exact_inverse(spark, seed, on):
    rng = random.Random(seed)
    held = {(rng.randint(1, 2), rng.randint(1, 20), rng.randint(1, 3)) for _ in range(30)}
    target = [(rng.randint(1, 2), rng.randint(1, 20)) for _ in range(25)]
    tags = spark.createDataFrame(sorted(held), TAGS)
    change = a.tag_view(spark.createDataFrame(target, "source_id int, rid bigint"), tags, 2, on)
    touched = {(s, r, 2) for s, r in target}
    assert set(table(change.tags)) == (held | touched if on else held - touched)
    assert set(table(change.delta)) == (touched - held if on else touched & held)
    assert table(a.revert_delta(change.tags, change.delta, on)) == sorted(held)
    assert tuple(change.summary().head()) == (len(set(target)), change.delta.count())


def test_exclusion(spark):
    tags = spark.createDataFrame([], TAGS)
    view = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "source_id int, rid bigint")
    assert table(a.tag_view(view, tags, 5, exclude=[(1, 1)]).tags) == [(1, 2, 5)]


def test_notes(spark):
    notes = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], NOTES)
    changes = spark.createDataFrame([(1, 1, " \t"), (1, 2, "new"), (1, 3, "c"), (1, 4, None)], NOTES)
    assert table(a.upsert_notes(notes, changes)) == [(1, 2, "new"), (1, 3, "c")]


def test_merge_maps_tags_by_name(spark):
    local = a.Annotations(
        spark.createDataFrame([(1, "Bad", "#1", None), (4, "Odd", "#2", None)], DEFS),
        spark.createDataFrame([(1, 1, 1), (2, 1, 4)], TAGS),
        spark.createDataFrame([(1, 1, "mine"), (2, 2, "keep")], NOTES),
    )
    incoming = a.Annotations(
        spark.createDataFrame([(1, "ODD", "#3", None), (2, "New", "#4", "n"), (3, "new", "#5", None)], DEFS),
        spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 77)], TAGS),
        spark.createDataFrame([(1, 1, "theirs")], NOTES),
    )
    merged = a.merge_annotations(local, incoming)
    assert sorted((r["id"], r["name"]) for r in merged.tag_defs.collect()) == [(1, "Bad"), (4, "Odd"), (5, "New")]
    assert table(merged.tags) == [(1, 1, 1), (1, 1, 4), (1, 2, 5), (1, 3, 5), (1, 4, 77), (2, 1, 4)]
    assert table(merged.notes) == [(1, 1, "theirs"), (2, 2, "keep")]
    replaced = a.merge_annotations(local, incoming, merge=False)
    assert table(replaced.tags) == [(1, 1, 4), (1, 2, 5), (1, 3, 5), (1, 4, 77), (2, 1, 4)]
    again = a.merge_annotations(merged, incoming)
    assert table(again.tags) == table(merged.tags) and again.tag_defs.count() == 3


def test_case_reattach_and_warnings(spark):
    recorded = spark.createDataFrame([(7, "fp1"), (8, "gone")], "source_id int, fingerprint string")
    current = spark.createDataFrame([(1, "fp1"), (2, "fp2")], "source_id int, fingerprint string")
    assert sorted(tuple(r) for r in a.reattach_sources(recorded, current).collect()) == [(7, 1), (8, None)]
    assert a.session_warnings("a", "b") and not a.session_warnings("a", "a") and not a.session_warnings(None, "b")


def test_cascades_and_bounds(spark, events):
    tags = spark.createDataFrame([(1, 2, 1), (1, 4, 1), (2, 1, 2)], TAGS)
    defs = spark.createDataFrame([(1, "x", "", None), (2, "y", "", None)], DEFS)
    left, left_defs = a.drop_tag(tags, defs, 1)
    assert table(left) == [(2, 1, 2)] and left_defs.count() == 1
    assert table(a.remove_source({"tags": tags}, 2)["tags"]) == [(1, 2, 1), (1, 4, 1)]
    assert tuple(a.tag_time_bounds(events, tags).head()) == ("2024-01-05 11:30:00", "2024-01-07 20:00:00")
    assert tuple(a.tag_time_bounds(events, tags, [2]).head()) == (None, None)
