import pytest

from logloom.operators import predicates as p
from logloom.operators.derived import add_derived


@pytest.mark.parametrize("column,op,value,wanted", [
    ("User", "contains", "ali", [1, 3]), ("User", "not_contains", "ali", [2, 4]), ("User", "equals", "alice", [1]),
    ("User", "not_equals", "alice", [2, 3, 4]), ("User", "starts", "AL", [1, 3]), ("User", "regex", "^a.+e$", [1, 3]),
    ("User", "regex", "(", []), ("EventId", ">", "4624", [2]), ("EventId", ">=", "4624", [1, 2]), ("EventId", "<", 4688, [1]),
    ("User", ">", "B", [1, 2]), ("EventId", "empty", "", [4]), ("User", "not_empty", "", [1, 2, 3]),
    ("User", "in", ["alice", "ALICE", ""], [1, 3]), ("User", "in", "alice\nBob Smith\n", [1, 2]), ("User", "in", [], [1, 2, 3, 4]),
    ("Cmd", "contains", "\\Temp\\", [2]), ("Cmd", "contains", "%", []), ("Cmd", "contains", "_", []), ("Cmd", "contains", "", [1, 2, 3, 4]),
    ("nope", "equals", "x", [1, 2, 3, 4]), ("User", "no_such_op", "x", [1, 2, 3, 4]),
])
def test_conditions(events, rids, column, op, value, wanted):
    assert rids(p.where_op(events, column, op, value)) == wanted


def test_number_operand_must_be_a_number(events):
    with pytest.raises(ValueError):
        p.where_op(events, "EventId", ">", "abc")


def test_tree_drops_empty_parts(events, rids):
    tree = {"type": "group", "op": "OR", "children": [
        {"type": "cond", "column": "User", "op": "equals", "value": ""},
        {"type": "group", "op": "AND", "children": []},
        {"type": "cond", "column": "User", "op": "equals", "value": "alice"},
        {"type": "raw", "sql": "EventId = '4688'"},
    ]}
    assert rids(p.filter_tree(events, tree)) == [1, 2]
    assert rids(p.filter_tree(events, None)) == [1, 2, 3, 4]


@pytest.mark.parametrize("text", [
    "", "rid = 1; drop table x", "EXISTS (SELECT 1 FROM other)", "rid IN (TABLE other)", "nope = 1", "rid = 1 -- x", "rid +",
])
def test_raw_expression_refusals(events, text):
    with pytest.raises(ValueError):
        p.where_expr(events, text)


def test_raw_expression_ignores_words_in_quotes(events, rids):
    assert rids(p.where_expr(events, "Cmd <> 'select * from x; --' AND `User` LIKE 'a%'")) == [1]


@pytest.mark.parametrize("start,end,wanted", [
    ("2024-01-05 11:30:00", None, [2, 3, 4]), (None, "2024-01-05 11:30", [1, 2]), ("1/7/2024", "2024-01-07 20:00:00", [4]),
    ("garbage", None, [1, 2, 3, 4]), ("2024-01-05", "2024-01-05", []),
])
def test_time_range(events, rids, start, end, wanted):
    assert rids(p.time_range(events, start, end)) == wanted


def test_time_range_any_datetime_column(spark, rids):
    df = spark.createDataFrame(
        [(1, 1, "2024-01-01 00:00:00", "2020-01-01 00:00:00"), (1, 2, "bad", "2024-01-02 00:00:00"), (1, 3, "2019-01-01", "")],
        "source_id int, rid bigint, Created string, Modified string",
    )
    from logloom.functions.columns import annotate

    two = annotate(df, {"Created": "datetime", "Modified": "datetime"})
    assert rids(p.time_range(two, "2024-01-01", "2024-12-31")) == [1, 2]
    assert rids(p.time_range(two, "2024-01-01", "2024-12-31", column="Modified")) == [2]
    assert rids(p.time_range(df, "2024-01-01", "2024-12-31")) == [1, 2, 3]


def test_native_range_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = p.time_range(df, "2024-01-05", "2024-01-06")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_exclude_and_unparsed(events, rids):
    assert rids(p.exclude_rows(events, [(1, 2), (1, 2), (9, 1)])) == [1, 3, 4]
    assert rids(p.exclude_rows(events, [])) == [1, 2, 3, 4]
    parsed = add_derived(events, "When", "Timestamp", "iso8601")
    assert rids(p.unparsed_rows(parsed, "When", "Timestamp")) == [4]


def test_project_keeps_derived_columns_last(events):
    parsed = add_derived(events, "When", "Timestamp", "iso8601").select("When", "source_id", "rid", "User")
    assert p.project(parsed).columns == ["source_id", "rid", "User", "When"]
    assert p.project(parsed, base_only=True).columns == ["source_id", "rid", "User"]
