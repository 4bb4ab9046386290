import pytest

from logloom.operators import grouping as g


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def hosts(spark):
    df = spark.createDataFrame([(1, i, f"H{i % 3}", "u") for i in range(1, 11)], "source_id int, rid bigint, Host string, User string")
    tags = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 3, 2), (1, 4, 2)], "source_id int, rid bigint, tag_id int")
    defs = spark.createDataFrame([(1, "zeta"), (2, "Alpha")], "id int, name string")
    return df, tags, defs


def test_counts_and_order(events):
    assert rows(g.group_summary(events, "Timestamp")) == [
        ("2024-01-05", 2, False), ("2024-01-06", 1, False), ("2024-01-07", 1, False),
    ]
    assert [r[0] for r in rows(g.group_summary(events, "EventId", order="value"))] == ["", "N/A", "4624", "4688"]
    assert [r[0] for r in rows(g.group_summary(events, "User", order="value", direction="desc"))] == ["Bob Smith", "ALICE", "alice", None]
    assert rows(g.group_summary(events, "User", limit=2))[0][2] is True
    assert len(rows(g.group_summary(events, "Timestamp", bucket_datetime=False))) == 4
    with pytest.raises(KeyError):
        g.group_summary(events, "nope")


def test_nested_sums_and_null_groups(events, rids):
    total = 0
    for day, count, _ in rows(g.group_summary(events, "Timestamp")):
        path = [{"column": "Timestamp", "value": day}]
        inner = rows(g.group_summary(events, "User", path=path))
        assert sum(r[1] for r in inner) == count
        total += count
    assert total == 4
    assert rids(g.expand_group(events, "User", None)) == [4]
    assert rids(g.expand_group(events, "User", "alice", path=[{"column": "Timestamp", "value": "2024-01-05"}])) == [1]


def test_group_by_tag(hosts, rids):
    df, tags, defs = hosts
    assert {r[0]: r[1] for r in rows(g.group_summary(df, g.TAG_COLUMN, tags=tags))} == {1: 3, 2: 2, None: 6}
    by_name = rows(g.group_summary(df, g.TAG_COLUMN, order="value", tags=tags, tag_defs=defs))
    assert [r[0] for r in by_name] == [None, 2, 1]
    assert rids(g.expand_group(df, g.TAG_COLUMN, None, tags=tags)) == [5, 6, 7, 8, 9, 10]
    below = rows(g.group_summary(df, "Host", path=[{"column": g.TAG_COLUMN, "value": 2}], tags=tags))
    assert sorted((r[0], r[1]) for r in below) == [("H0", 1), ("H1", 1)]
    everything = tags.unionByName(df.select("source_id", "rid").selectExpr("*", "9 AS tag_id"))
    assert None not in {r[0] for r in rows(g.group_summary(df, g.TAG_COLUMN, tags=everything))}


def test_values_and_lengths(events):
    assert rows(g.column_values(events, "Timestamp", limit=1)) == [("1/7/2024 8:00 PM", 1, True)]
    assert dict(rows(g.column_max_lengths(events)))["Cmd"] == len(r"C:\Windows\svchost.exe")
    assert rows(g.group_day(events, "User")) == [(None, 4)]
