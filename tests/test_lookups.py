"""Whole group trees, proven top values, long value lists, counts that stop."""

import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.functions.columns import annotate
from logloom.operators import grouping, predicates, search, view


@pytest.fixture(scope="module")
def hosts(spark):
    rng = random.Random(6)
    rows = [
        (1, i, rng.choice(["a", "B", "c", None, "d"]), rng.choice(["2024-01-05 10:00:00", "2024-01-06", "1/7/2024", "bad", None]), str(rng.choice([3, 20, 100, "x"])))
        for i in range(1, 700)
    ]
    df = spark.createDataFrame(rows, "source_id int, rid bigint, Host string, Seen string, Size string").repartition(5)
    return annotate(df, {"Seen": "datetime", "Size": "number"})


def tree_by_steps(df, columns, limit, order, tags=None):
    """The same tree, one ``group_summary`` per parent."""
    out = []

    def below(path):
        level = len(path)
        if level == len(columns):
            return
        for i, r in enumerate(grouping.group_summary(df, columns[level], order=order, limit=limit, path=path, tags=tags).collect(), start=1):
            cells = [p["value"] for p in path] + [r["value"]] + [None] * (len(columns) - level - 1)
            out.append((level + 1, *cells, r["count"], i, r["truncated"]))
            below([*path, {"column": columns[level], "value": r["value"]}])

    below([])
    return Counter(out)


@pytest.mark.parametrize("limit, order", [(2, "count"), (None, "count"), (3, "value")])
def test_tree_is_all_drill_downs(hosts, limit, order):
    columns = ["Host", "Seen", "Size"] if limit == 2 else ["Seen", "Host"]
    got = grouping.group_tree(hosts, columns, limit=limit, order=order)
    assert got.columns == ["level", *columns, "count", "position", "truncated"]
    assert Counter(map(tuple, got.collect())) == tree_by_steps(hosts, columns, limit, order)


def test_tree_with_tags(spark, hosts):
    tags = spark.createDataFrame([(1, r, t) for r in range(1, 300) for t in (1, 2) if r % (t + 2) == 0] + [(2, 5, 9)], "source_id int, rid bigint, tag_id int")
    for columns in (["Host", grouping.TAG_COLUMN, "Size"], [grouping.TAG_COLUMN, "Host"], [grouping.TAG_COLUMN]):
        got = grouping.group_tree(hosts, columns, limit=2, tags=tags)
        assert Counter(map(tuple, got.collect())) == tree_by_steps(hosts, columns, 2, "count", tags)
    with pytest.raises(ValueError):
        grouping.group_tree(hosts, [grouping.TAG_COLUMN])
    with pytest.raises(ValueError):
        grouping.group_tree(hosts, ["Host", "Host"])


def test_tree_scans_once(spark, hosts, tmp_path):
    hosts.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    keys = [F.col(c) for c in ("Host", "Size")]
    plan = grouping._grouped_levels(df, keys, ["_g0", "_g1"], 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def top(spark, values, kind="string", **how):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], f"source_id int, rid bigint, v {kind}").repartition(6)
    return df, grouping.top_values(df, "v", **how)


def test_top_values_equal_exact_counts(spark):
    rng = random.Random(2)
    skewed = [f"v{int(rng.paretovariate(0.8))}" for _ in range(20_000)] + [None] * 900 + ["v1"] * 7000
    for limit, tracked in ((1, 50), (5, 400), (40, 4000), (40, 20)):
        df, got = top(spark, skewed, limit=limit, tracked=tracked)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in grouping.column_values(df, "v", limit).collect()]
    for values, kind in (([3, 3, 5, None, 7], "int"), ([], "string"), ([None, None], "bigint"), ([1.5, 1.5, float("nan")], "double"), ([[1], [1], [2]], "array<int>")):
        df, got = top(spark, values, kind, limit=2)
        assert repr(got.collect()) == repr(grouping.column_values(df, "v", 2).collect())


def test_top_values_proof_avoids_the_full_count(spark, monkeypatch):
    monkeypatch.setattr(grouping, "column_values", lambda *a: pytest.fail("counted all values"))
    _, got = top(spark, ["often"] * 900 + ["second"] * 700 + [str(i) for i in range(9000)], limit=2, tracked=200)
    assert [tuple(r) for r in got.collect()] == [("often", 900, True), ("second", 700, True)]
    called = []
    monkeypatch.setattr(grouping, "column_values", lambda df, c, n: called.append(n) or df)
    top(spark, [str(i % 3000) for i in range(9000)], limit=2, tracked=100)
    assert called == [2]  # nothing stands out, so nothing is proven


def test_sketch_error():
    assert grouping._sketch_error(100) == 3.5 / 256 and grouping._sketch_error(96) == 3.5 / 128


def test_long_list(spark, hosts):
    listed = [str(i) for i in range(-50, 60_000, 7)] + ["", "no number", "3.0", "1e2", "4.5", str(2**70)]
    expected = sorted(r["rid"] for r in hosts.collect() if r["rid"] in {*range(-50, 60_000, 7), 3, 100})
    for value in (listed, "\n".join(listed)):
        assert sorted(r["rid"] for r in predicates.where_op(hosts.select("*", F.col("rid").alias("n")), "n", "in", value).collect()) == expected
    spec = {"filters": [{"column": "Host", "op": "in", "value": ["c", "a"] + [f"no{i}" for i in range(5000)]}, {"column": "Size", "op": "equals", "value": "3"}]}
    assert sorted(r["rid"] for r in view.apply_spec(hosts, spec).collect()) == sorted(
        r["rid"] for r in hosts.collect() if r["Host"] in ("a", "c") and r["Size"] == "3"
    )
    assert predicates.where_op(hosts.select("*", F.col("rid").alias("n")), "n", "in", ["x"] * 2000 + ["y"]).collect() == []


def test_long_list_types(spark):
    rows = [(1, 1, datetime(2024, 1, 5, 10), 1.5, True), (1, 2, datetime(2024, 1, 6), 2.0, None), (1, 3, None, None, False)]
    df = spark.createDataFrame(rows, "source_id int, rid bigint, t timestamp_ntz, d double, b boolean")
    pad = [f"nothing {i}" for i in range(1500)]
    for column, value, wanted in (("t", ["2024-01-05T10:00:00"], [1]), ("d", ["2", "1.50"], [1, 2])):
        assert sorted(r["rid"] for r in predicates.where_op(df, column, "in", value + pad).collect()) == wanted
    table = spark.createDataFrame([("2024-01-06",), (None,), ("junk",)], "x string")
    assert [r["rid"] for r in predicates.where_in(df, "t", table).collect()] == [2]
    assert predicates.where_in(df, "d", table.where("false")).collect() == []


def test_long_list_plan_does_not_grow(spark, tmp_path):
    spark.range(1000).selectExpr("1 AS source_id", "id AS rid", "id AS n").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plans = [predicates.where_op(df, "n", "in", list(map(str, range(1, size))))._jdf.queryExecution().executedPlan().toString() for size in (1100, 100_000)]
    assert abs(len(plans[0]) - len(plans[1])) < 300 and "GreaterThanOrEqual(n,1)" in plans[1] and "LeftSemi" in plans[1]


def rows_read(df) -> int:
    """Rows that the scans of an executed plan gave on."""
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves()
    for i in range(leaves.length()):
        metric = leaves.apply(i).metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total


def test_capped_sweep_reads_a_fraction(spark, tmp_path):
    n = 400_000
    spark.range(n).selectExpr("1 AS source_id", "id AS rid", "concat('row ', id, ' common') AS t").repartition(2).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        capped, whole = search.search_all({1: df}, "common", cap=150), search.search_all({1: df}, "common")
        assert [tuple(r) for r in capped.collect()] == [(1, 150, True)] and [tuple(r) for r in whole.collect()] == [(1, n, False)]
        assert rows_read(whole) == n and rows_read(capped) < n / 5
        rare = search.search_all({1: df, 2: df.where("rid < 9")}, "row 399999", cap=1)
        assert [tuple(r) for r in rare.collect()] == [(1, 1, False)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
