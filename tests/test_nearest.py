"""Nearest rows for many moments, against a plain program."""

import random
from datetime import datetime, timedelta

import pytest

from logloom.functions.columns import annotate
from logloom.operators import nearest, view

START = datetime(2024, 1, 5)


def stamp(seconds):
    return (START + timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S")


def table(spark, rows, partitions=4):
    df = spark.createDataFrame(rows, "source_id int, rid bigint, A string, B string, C string").repartition(partitions)
    return annotate(df, {"A": "datetime", "B": "datetime"})


def plain(rows, moment, columns=(2, 3)):
    """(source_id, rid, ts, distance) of the nearest row."""
    best = None
    for r in rows:
        for c in columns:
            try:
                at = datetime.strptime((r[c] or "")[:19], "%Y-%m-%d %H:%M:%S")
            except ValueError:
                continue
            found = (abs(int((at - moment).total_seconds())), r[0], r[1], r[c][:19])
            best = min(best, found) if best else found
    return best and (best[1], best[2], best[3], best[0])


@pytest.mark.parametrize("hot", [1, 10**6])
def test_against_plain(spark, hot):
    rng = random.Random(3)
    rows = [
        (s, i, stamp(rng.randrange(0, 9000, 3)) if rng.random() < 0.9 else rng.choice(["", None, "n/a", "2024-13-45 00:00:00"]),
         stamp(rng.randrange(5000)) + rng.choice(["", ".25"]), "x")
        for s in (1, 2) for i in range(1, 150)
    ]
    asked = [rng.randrange(-500, 12_000) for _ in range(200)] + [4000] * 60  # one moment is asked often
    probes = spark.createDataFrame([(i, stamp(a)) for i, a in enumerate(asked)], "id int, moment string").repartition(3)
    for column, places in ((None, (2, 3)), ("A", (2,))):
        got = nearest.nearest_timestamps(table(spark, rows), probes, column=column, hot_rows=hot).collect()
        assert len(got) == len(asked)
        for r in got:
            assert (r["source_id"], r["rid"], r["ts"], r["distance_seconds"]) == plain(rows, START + timedelta(seconds=asked[r["id"]]), places)


def test_far_borders(spark):
    """Entries and questions lie in ranges of their own, so answers cross
    several empty borders."""
    rows = [(1, i, stamp(i), None, "x") for i in range(1, 400)] + [(1, 1000, stamp(10**7), None, "x")]
    asked = [10**6 + i for i in range(400)] + [10**7 - 1 - i for i in range(400)]
    probes = spark.createDataFrame([(a, stamp(a)) for a in asked], "id bigint, moment string")
    got = {r["id"]: r["rid"] for r in nearest.nearest_timestamps(table(spark, rows), probes).collect()}
    assert got == {a: 399 if a - 399 <= 10**7 - a else 1000 for a in asked}


def test_ties_shapes_and_misses(spark):
    rows = [(1, 5, stamp(100), None, "x"), (1, 2, stamp(300), stamp(100), "x"), (2, 1, stamp(300), None, "x")]
    probes = spark.createDataFrame([(0, "1/5/2024 12:03:20 AM"), (1, "never"), (2, None), (3, "2024-01-05T00:05")], "id int, moment string")
    got = {r["id"]: tuple(r)[2:] for r in nearest.nearest_timestamps(table(spark, rows), probes).collect()}
    assert got == {0: (1, 2, stamp(100), 100), 1: (None,) * 4, 2: (None,) * 4, 3: (1, 2, stamp(300), 0)}
    none = nearest.nearest_timestamps(table(spark, rows).where("rid > 99"), probes).collect()
    assert [tuple(r)[2:] for r in none] == [(None,) * 4] * 4
    assert nearest.nearest_timestamps(table(spark, rows), probes.where("id > 9")).collect() == []
    for wrong in (lambda: nearest.nearest_timestamps(table(spark, rows), probes, column="C"),
                  lambda: nearest.nearest_timestamps(table(spark, rows).drop("A", "B"), probes),
                  lambda: nearest.nearest_timestamps(table(spark, rows), probes.withColumnRenamed("id", "rid"))):
        with pytest.raises(ValueError):
            wrong()


def test_position_in_view(spark, events):
    ordered = view.build_view(events, {"sort": [{"column": "Timestamp", "dir": "desc"}], "filters": [{"column": "User", "op": "not_empty"}]})
    probes = spark.createDataFrame([("2024-01-05 10:10:00",), ("2024-01-07 19:00:00",)], "moment string")
    got = {r["moment"]: (r["rid"], r["pos"]) for r in nearest.nearest_timestamps(events, probes, view=ordered).collect()}
    positions = {r["rid"]: r["pos"] for r in ordered.frame.collect()}
    assert got == {"2024-01-05 10:10:00": (1, positions[1]), "2024-01-07 19:00:00": (3, positions[3])}


def test_agrees_with_one_moment(spark, events):
    for moment in ("2024-01-05 10:45:00", "2024-01-06 23:00:00", "2030-01-01"):
        one = view.nearest_timestamp(events, moment).first()
        many = nearest.nearest_timestamps(events, spark.createDataFrame([(moment,)], "moment string")).first()
        assert (one["rid"], one["ts"], one["distance_seconds"]) == (many["rid"], many["ts"], many["distance_seconds"])


def test_no_cross_join(spark, events):
    probes = spark.createDataFrame([("2024-01-05 10:10:00",)], "moment string")
    plan = nearest.nearest_timestamps(events, probes)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
