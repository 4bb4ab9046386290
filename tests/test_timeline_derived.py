import pytest
from pyspark.sql import functions as F

from logloom.operators import derived as d
from logloom.operators import detect
from logloom.operators.timeline import Source, merge_sources, timeline, timeline_view

TAGS = "source_id int, rid bigint, tag_id int"


def test_timeline_interleaves_formats_and_defaults(spark, events):
    from logloom.functions.columns import annotate

    history = annotate(
        spark.createDataFrame([(1, "1/5/2024 11:00 AM", "http://a"), (2, "never", None)], "rid bigint, VisitTime string, Url string"),
        {"VisitTime": "datetime"},
    )
    tags = spark.createDataFrame([(1, 2, 1), (1, 2, 3), (2, 1, 3), (2, 2, 1)], TAGS)
    sources = [Source(1, "evtx", events.drop("source_id")), Source(2, "history", history)]
    config = {1: {"body_columns": ["User", "gone"], "type_label": "Logon"}, 2: {"timestamp_column": "gone"}}
    rows = timeline_view(timeline(sources, tags, config)).frame.orderBy("pos").collect()
    assert [(r["pos"], r["source_id"], r["rid"], r["ts"], r["body"], r["type_label"], r["tag_ids"]) for r in rows] == [
        (1, 2, 1, "2024-01-05 11:00:00", "1/5/2024 11:00 AM | http://a", "history", [3]),
        (2, 1, 2, "2024-01-05 11:30:00", "Bob Smith", "Logon", [1, 3]),
        (3, 2, 2, None, "never | ", "history", [1]),
    ]
    assert timeline(sources, tags, tag_ids=[3]).count() == 2


def test_timeline_uses_derived_time_with_its_fraction(spark):
    df = spark.createDataFrame([(1, "1704460921.25")], "rid bigint, Epoch string").withColumn("source_id", F.lit(1))
    with_time = d.add_derived(df, "When", "Epoch", "unix_epoch")
    tags = spark.createDataFrame([(1, 1, 1)], TAGS)
    assert timeline([Source(1, "log", with_time.drop("source_id"))], tags).head()["ts"] == "2024-01-05 13:22:01.250000"


def test_merge_needs_equal_names(spark, events):
    a, b = Source(1, "a", events.drop("source_id")), Source(2, "b", events.drop("source_id").withColumnRenamed("User", "USER"))
    assert merge_sources([a, b]).columns == events.columns and merge_sources([a, b]).count() == 8
    with pytest.raises(ValueError):
        merge_sources([a])
    with pytest.raises(ValueError):
        merge_sources([a, Source(3, "c", events.drop("source_id", "User"))])


@pytest.fixture
def log(spark):
    rows = [(1, 1, "Dec 31 23:59:58", "1704460921"), (1, 2, "junk", "x"), (1, 3, "Jan  1 00:00:01", ""), (1, 4, "Feb 29 10:00:00", "1704460922"), (1, 5, "Jan 2 00:00:00", "5")]
    return spark.createDataFrame(rows, "source_id int, rid bigint, When string, Epoch string")


def values(df, name):
    return [r[name] for r in df.orderBy("rid").collect()]


def test_syslog_rollover(log):
    got = d.add_derived(log, "t", "When", "syslog_bsd", {"base_year": "2023"})
    assert values(got, "t") == ["2023-12-31 23:59:58", None, "2024-01-01 00:00:01", "2024-02-29 10:00:00", "2025-01-02 00:00:00"]
    later = d.rederive(got, "t", {"base_year": 2024, "utc_offset": "-01:00"})
    assert values(later, "t") == ["2025-01-01 00:59:58", None, "2025-01-01 01:00:01", None, "2026-01-02 01:00:00"]


def test_definitions_failures_and_rules(log):
    got = d.add_derived(log, "t", "epoch", "unix_epoch")
    assert d.definitions(got) == [{"name": "t", "input_column": "Epoch", "op_id": "unix_epoch", "params": {"unit": "auto"}}]
    assert d.parse_failures(got, "t", "Epoch").head()["failures"] == 2
    for bad in (
        {"name": ""}, {"name": "rid"}, {"name": "when"}, {"name": "x" * 201}, {"name": "n", "input_column": "gone"},
        {"name": "n", "op_id": "nope"}, {"name": "n", "params": {"unit": "years"}}, {"name": "n", "input_column": "t"},
    ):
        with pytest.raises(ValueError):
            d.add_derived_columns(got, [{"name": "ok", "input_column": "Epoch", "op_id": "unix_epoch", **bad}])
    with pytest.raises(ValueError):
        d.add_derived(log, "t", "When", "syslog_bsd")
    with pytest.raises(ValueError):
        d.add_derived(log, "t", "When", "iso8601", {"utc_offset": "+99"})


def test_duration_chains_and_blocks_removal(log):
    two = d.add_derived_columns(log, [
        {"name": "a", "input_column": "Epoch", "op_id": "unix_epoch"},
        {"name": "b", "input_column": "When", "op_id": "syslog_bsd", "params": {"base_year": 2024}},
    ])
    gap = d.add_derived(two, "gap", "b", "duration_delta", {"other_column": "a"})
    assert values(gap, "gap")[0] == "31228677.000000"
    with pytest.raises(ValueError):
        d.remove_derived(gap, "a")
    assert "a" not in d.remove_derived(d.remove_derived(gap, "gap"), "a").columns
    frame, warnings = d.replay_definitions(two, d.definitions(gap))
    assert len(warnings) == 2 and "gap" in frame.columns


def test_preview(log):
    rows = [(r["rid"], r["input"], r["output"]) for r in d.preview_derived(log, "Epoch", "unix_epoch", limit=2).collect()]
    assert rows == [(1, "1704460921", "2024-01-05 13:22:01"), (2, "x", None)]


def test_detection(spark, log):
    ranked = [(r["op_id"], round(r["confidence"], 3)) for r in detect.detect_format(log, "Epoch").collect()]
    assert ranked == [("mac_absolute", 0.75), ("unix_epoch", 0.5)]
    df = spark.createDataFrame([(1, "2024-01-05 10:00:00", "20240105132201", "text")] * 3, "rid bigint, d string, c string, t string")
    from logloom.functions.columns import annotate

    typed = annotate(df, {"d": "datetime"})
    assert [tuple(r) for r in detect.suggest_timestamp_columns(typed).collect()] == [("c", "compact_ymd", 1.0)]
    converted = d.add_derived(typed.withColumn("source_id", F.lit(1)), "when", "c", "compact_ymd")
    assert detect.suggest_timestamp_columns(converted).count() == 0


def test_infer_types(spark):
    cells = [("1", "2024-01-01 x", "a", ""), ("2.5", "1/2/2024", "1", ""), ("-3", "2024-01-03T", "2", None), ("", "2024-01-04 ", "3", ""), ("7", "odd", "4", "")]
    df = spark.createDataFrame([(i + 1, *c) for i, c in enumerate(cells)], "rid bigint, n string, d string, t string, e string")
    assert {r["column"]: r["type"] for r in detect.infer_types(df).collect()} == {"n": "number", "d": "datetime", "t": "text", "e": "text"}
