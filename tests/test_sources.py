import json
import os

import pytest
from pyspark.sql import functions as F

from logloom.functions.columns import logical_types
from logloom.operators import annotations as ann
from logloom.operators.derived import add_derived, definitions
from logloom.operators.timeline import Source
from logloom.sources import adhoc, delimited, files, json_records, schema, sinks, webkit
from logloom.streaming.directory import ingest_directory_stream


def put(folder, name, text):
    path = os.path.join(str(folder), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def cells(df):
    return [tuple(r)[1:] for r in df.orderBy("rid").collect()]


@pytest.mark.parametrize("raw,wanted", [
    (["A", "a", "", None, "rid", "Rank"], ["A", "a_1", "col_3", "col_4", "rid_1", "Rank_1"]),
    (["Name", "Name", "Name_1"], ["Name", "Name_1", "Name_1_1"]),
    (["\ufeffHead", " x "], ["Head", "x"]),
])
def test_names(raw, wanted):
    assert schema.clean_names(raw) == wanted


def test_ragged_rows_are_kept_and_counted(spark, tmp_path):
    path = put(tmp_path, "r.csv", "\ufeffA,B,C\n1,2,3\n4,5\n6,7,8,9\n")
    got = delimited.read_delimited(spark, path)
    assert got.ragged_rows == 2
    assert cells(got.frame) == [(1, "1", "2", "3"), (2, "4", "5", ""), (3, "6", "7", "8")]
    assert logical_types(got.frame) == {"A": "number", "B": "number", "C": "number"}


def test_quotes_empties_and_spaces_survive(spark, tmp_path):
    path = put(tmp_path, "q.csv", 'A,B\n"x,""y"""," keep "\n"",\nN/A,=1\n')
    got = delimited.read_delimited(spark, path)
    assert cells(got.frame) == [(1, 'x,"y"', " keep "), (2, "", ""), (3, "N/A", "=1")] and got.ragged_rows == 0


def test_headerless_multiline_and_delimiters(spark, tmp_path):
    path = put(tmp_path, "t.tsv", "\ufeffa\tb\nc\td\n")
    assert cells(delimited.read_delimited(spark, path, has_header=False).frame) == [(1, "a", "b"), (2, "c", "d")]
    multi = put(tmp_path, "m.csv", 'A;B\n"one\ntwo";2\n')
    assert cells(delimited.read_delimited(spark, multi, delimiter=";").frame) == [(1, "one\ntwo", "2")]


def test_line_breaks_inside_quotes_over_many_splits(spark, tmp_path):
    """As the csv module reads it, however the file is cut into splits."""
    import csv
    import io
    import random

    rng = random.Random(5)
    pieces = ["a", 'say ""hi""', "x\ny", "\n\n", "p;q", "", " ", '5" pipe', "long " * 30, "\n" * 40]
    lines = []
    for i in range(600):
        row = [rng.choice(pieces) for _ in range(3)]
        lines.append(";".join(c if c.endswith("pipe") else f'"{c}"' if "\n" in c or '"' in c or rng.random() < 0.3 else c.replace(";", ",") for c in row))
        if rng.random() < 0.05:
            lines.append("")
    text = "A;B;C\n" + "\n".join(lines) + "\n"
    path = put(tmp_path, "quoted.csv", text)
    wanted = list(csv.reader(io.StringIO(text), delimiter=";"))[1:]
    for size in ("300", "2000", "10000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = delimited.read_delimited(spark, path, delimiter=";")
            rows = got.frame.orderBy("rid").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [[r["A"], r["B"], r["C"]] for r in rows] == [(w + ["", "", ""])[:3] for w in wanted]
        assert [r["rid"] for r in rows] == list(range(1, len(wanted) + 1))
        assert got.ragged_rows == sum(len(w) != 3 for w in wanted)


def test_row_ids_follow_the_file_over_many_splits(spark, tmp_path):
    path = put(tmp_path, "big.csv", "n,t\n" + "".join(f"{i},{'x' * 50}\n" for i in range(1, 4001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        frame = delimited.read_delimited(spark, path).frame
        assert [(r["rid"], r["n"]) for r in frame.orderBy("rid").collect()] == [(i, str(i)) for i in range(1, 4001)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


RECORDS = [
    {"id": 1, "user": {"name": "a", "address": {"city": "x", "zip": 1}}, "tags": ["p", "q"], "ok": True},
    {"id": 2.5, "user": {"name": "b"}, "note": None}, {"id": 3, "tags": []},
]


def test_json_flatten_modes(spark, tmp_path):
    path = put(tmp_path, "r.jsonl", "\n".join(map(json.dumps, RECORDS)) + "\n\n")
    full = json_records.read_json_records(spark, path, "full").orderBy("rid").collect()
    assert [r["user.address.city"] for r in full] == ["x", "", ""]
    assert [r["id"] for r in full] == ["1", "2.5", "3"] and [r["ok"] for r in full] == ["true", "", ""]
    assert [r["tags"].replace(" ", "") for r in full] == ['["p","q"]', "", "[]"] and [r["note"] for r in full] == ["", "", ""]
    one = json_records.read_json_records(spark, path, "depth", 1).orderBy("rid").collect()
    assert json.loads(one[0]["user.address"]) == {"city": "x", "zip": 1}
    none = json_records.read_json_records(spark, path).orderBy("rid").collect()
    assert json.loads(none[1]["user"]) == {"name": "b"}


def test_json_documents_and_scalars(spark, tmp_path):
    array = put(tmp_path, "a.json", json.dumps(RECORDS, indent=1))
    assert [r["id"] for r in json_records.read_json_records(spark, array).orderBy("rid").collect()] == ["1", "2.5", "3"]
    single = put(tmp_path, "o.json", '{"a": {"b": 1}}')
    assert cells(json_records.read_json_records(spark, single, "full")) == [(1, "1")]
    mixed = put(tmp_path, "m.ndjson", '{"a":1}\n"text"\n7\nnull\n[1,2]\n')
    rows = json_records.read_json_records(spark, mixed).orderBy("rid").collect()
    assert [(r["a"], r["value"]) for r in rows] == [("1", ""), ("", "text"), ("", "7"), ("", ""), ("", "[1,2]")]
    scalars = put(tmp_path, "s.json", "[1, \"x\"]")
    assert cells(json_records.read_json_records(spark, scalars)) == [(1, "1"), (2, "x")]


def test_scan_reasons(spark, tmp_path):
    for name in ("a.csv", "b.bak", "sub/c.CSV", "sub/d.jsonl", "$MFT"):
        put(tmp_path, name, "x\n1\n")
    already = spark.createDataFrame([(str(tmp_path / "a.csv"),)], "path string")
    got = {r["rel_path"]: r for r in files.scan_files(
        spark, str(tmp_path), exclude=["sub/*.csv"], filename_patterns=["$mft"], already=already).collect()}
    assert got["b.bak"]["reason"] == "extension" and got["sub/c.CSV"]["reason"] == "excluded by pattern: sub/*.csv"
    assert got["a.csv"]["already_imported"] and not got["sub/d.jsonl"]["already_imported"]
    assert (got["$MFT"]["kind"], got["sub/d.jsonl"]["kind"], got["a.csv"]["kind"]) == ("plugin", "json", "csv")
    narrow = files.scan_files(spark, str(tmp_path), include=["a*"], recursive=False).where("status = 'matched'")
    assert [r["rel_path"] for r in narrow.collect()] == ["a.csv"]


@pytest.mark.parametrize("pattern,name,hit", [("*.csv", "a.csv", True), ("a?.csv", "ab.csv", True), ("[!a]*", "abc", False), ("[ab]*", "bcd", True), ("a.b", "axb", False)])
def test_globs(pattern, name, hit):
    import re

    assert bool(re.match(files.glob_regex(pattern), name)) is hit


def test_normalise_rows(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, ["a", "b", "c"]), (3, ["x", "y"])], "rid bigint, cells array<string>")
    got = schema.normalise_rows(df, "cells", ["P", "p"])
    assert [tuple(r) for r in got.orderBy("rid").collect()] == [(1, "a", "", False), (2, "a", "b", True), (3, "x", "y", False)]
    assert schema.ragged_count(got) == 1


def test_webkit(spark):
    rows = [(i, "13348934521123456" if i else "0", "13348934521123456") for i in range(10)]
    df = spark.createDataFrame(rows, "rid bigint, last_visit_time string, url string")
    assert [r[0] for r in webkit.detect_webkit(df).collect()] == ["last_visit_time"]
    got = webkit.convert_webkit(df, ["last_visit_time"]).orderBy("rid").collect()
    assert [r["last_visit_time"] for r in got[:2]] == ["0", "2024-01-05T13:22:01.123Z"] and got[1]["url"] == rows[1][2]


def test_fingerprint_counts_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "rid bigint, v string")
    other = spark.createDataFrame([(1, "b"), (2, "b")], "rid bigint, v string")
    assert schema.fingerprint_text(df) != schema.fingerprint_text(other)
    assert schema.fingerprint_text(df) == schema.fingerprint_text(df.repartition(2).withColumn("rid", F.col("rid") + 5))


def test_sql_is_read_only_and_capped(spark, events):
    got = adhoc.sql_query(spark, "SELECT ts_normalize(Timestamp) AS t FROM log WHERE regexp_match('ALI', User) ORDER BY 1", {"log": events}, limit=1)
    assert [r["t"] for r in got.frame.collect()] == ["2024-01-05 10:00:00"] and got.truncated()
    assert not adhoc.sql_query(spark, "SELECT 1 AS x", limit=1).truncated()
    for text in ("DROP VIEW log", "INSERT INTO log VALUES (1)", "CREATE TABLE t AS SELECT 1", "WITH a AS (SELECT 1) INSERT INTO log SELECT * FROM a"):
        with pytest.raises(ValueError):
            adhoc.sql_query(spark, text)


def test_export_and_session(spark, events, tmp_path):
    tags = spark.createDataFrame([(1, 3, 2), (1, 3, 1), (1, 1, 9), (5, 1, 1)], "source_id int, rid bigint, tag_id int")
    defs = spark.createDataFrame([(1, "Odd", "#1", None), (2, "Bad", "#2", "b")], "id int, name string, color string, hotkey string")
    notes = spark.createDataFrame([(1, 3, "=cmd")], "source_id int, rid bigint, note string")
    out = str(tmp_path / "csv")
    sinks.export_csv(events.withColumn("pos", 5 - F.col("rid")), out, tags, defs, notes)
    rows = spark.read.option("header", True).option("escape", '"').csv(out).select("Line", "Tags", "Note", "Cmd").collect()
    by_line = {r["Line"]: r for r in rows}
    assert by_line["3"]["Tags"] == "Odd; Bad" and by_line["3"]["Note"] == "'=cmd" and by_line["1"]["Tags"] == "9"
    source = Source(1, "log", events.drop("source_id"))
    assert sinks.export_tagged([source, Source(2, "empty", events.drop("source_id"))], str(tmp_path / "tagged"), tags, defs, notes) == [1]
    derived = add_derived(events, "t", "Timestamp", "iso8601")
    sinks.export_annotations(str(tmp_path / "s"), source, ann.Annotations(defs, tags, notes), definitions(derived), "fp")
    back, identity = sinks.read_annotations(spark, str(tmp_path / "s"))
    assert back.tags.count() == 3 and back.tag_defs.count() == 2 and identity["fingerprint"] == "fp"
    assert identity["derived_columns"] == definitions(derived)


def test_directory_stream_reads_each_file_once(spark, tmp_path):
    root, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    put(root, "a b+c.csv", "X,Y\n1,2\n3\n")
    put(root, "sub/d.csv", "X,Y\n5,6\n")
    put(root, "e.csv", "P\tQ\n7\t8\n")
    ingest_directory_stream(spark, root, out, mark).awaitTermination()
    ingest_directory_stream(spark, root, out, mark).awaitTermination()
    put(root, "late.csv", "X,Y\n9,9\n")
    ingest_directory_stream(spark, root, out, mark).awaitTermination()
    registry = spark.read.parquet(out + "/sources").collect()
    assert sorted(os.path.basename(r["path"]) for r in registry) == ["a b+c.csv", "d.csv", "e.csv", "late.csv"]
    label = next(r["layout"] for r in registry if r["columns"] == '["X", "Y"]')
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{out}/data/layout={label}").collect()
    assert sorted((r["rid"], r["X"], r["Y"], r["_ragged"]) for r in rows) == [(1, "1", "2", False), (1, "5", "6", False), (1, "9", "9", False), (2, "3", "", True)]
    assert len({r["source_id"] for r in rows}) == 3


def test_directory_stream_loses_no_file(spark, tmp_path):
    root, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    put(root, "blank first.csv", "\nA,B\n3,4\n")
    put(root, "x[1].csv", "A,B\n5,x\n")
    put(root, "j.jsonl", '{"a": 1, "b": {"c": "d"}}\n{"a": 2}\n')
    put(root, "whole.json", '[{"k": "v"}]')
    put(root, "empty.csv", " \n\n")
    put(root, "broken.json", "{")
    put(root, "quoted.csv", 'A,B\n"1\n2",y\n')
    ingest_directory_stream(spark, root, out, mark).awaitTermination()
    registry = {os.path.basename(r["path"]): r for r in spark.read.parquet(out + "/sources").collect()}
    assert len(registry) == 7 and sorted(r["source_id"] for r in registry.values()) == list(range(1, 8))
    assert registry["j.jsonl"]["kind"] == "json" and registry["j.jsonl"]["columns"] == '["a", "b"]'
    assert {n for n, r in registry.items() if r["reason"]} == {"empty.csv", "broken.json"}
    assert '"A": "text"' in registry["quoted.csv"]["types"]

    def rows(name):
        r = registry[name]
        data = spark.read.option("recursiveFileLookup", True).parquet(f"{out}/data/layout={r['layout']}")
        assert dict(data.dtypes)["source_id"] == "int"
        return sorted(tuple(x)[1:4] for x in data.where(f"source_id = {r['source_id']}").collect())

    assert rows("blank first.csv") == [(1, "3", "4")] and rows("x[1].csv") == [(1, "5", "x")] and rows("quoted.csv") == [(1, "1\n2", "y")]
    assert rows("j.jsonl") == [(1, "1", '{"c":"d"}'), (2, "2", "")] or rows("j.jsonl")[0][:2] == (1, "1")


def test_directory_stream_reads_json_files_of_one_shape_together(spark, tmp_path, monkeypatch):
    from logloom.streaming import directory

    root, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    for i in range(6):
        put(root, f"a {i}.jsonl", "".join(f'{{"id":{j},"host":"h{i}"}}\n' for j in range(i + 1)))
    put(root, "b.ndjson", '{"id":1,"in":{"x":2}}\n7\n')
    put(root, "bad.jsonl", '{"id":1,"host":"z"}\n{"id":\n')
    put(root, "bad2.jsonl", '{"id":1,"host":"z"}\n')
    put(root, "blank.jsonl", "\n\n")
    put(root, "one.json", '[{"id":1,"host":"q"},{"id":2,"host":"r"}]')
    single = []
    whole = directory.read_json_records
    monkeypatch.setattr(directory, "read_json_records", lambda s, p, *a, **k: single.append(os.path.basename(p)) or whole(s, p, *a, **k))
    ingest_directory_stream(spark, root, out, mark).awaitTermination()
    registry = {os.path.basename(r["path"]): r for r in spark.read.parquet(out + "/sources").collect()}
    assert len(registry) == 11 and registry["bad.jsonl"]["reason"] and registry["blank.jsonl"]["reason"]
    label = registry["a 0.jsonl"]["layout"]
    rows = spark.read.parquet(f"{out}/data/layout={label}").collect()
    by_file = {n: sorted((x["rid"], x["id"], x["host"]) for x in rows if x["source_id"] == r["source_id"]) for n, r in registry.items()}
    for i in range(6):
        assert by_file[f"a {i}.jsonl"] == [(j + 1, str(j), f"h{i}") for j in range(i + 1)]
    assert by_file["one.json"] == [(1, "1", "q"), (2, "2", "r")] and by_file["bad2.jsonl"] == [(1, "1", "z")] and by_file["bad.jsonl"] == []
    # A broken file sends its group to be read one by one.
    assert {"bad.jsonl", "one.json", "b.ndjson"} <= set(single)
    later = str(tmp_path / "later")
    for i in range(4):
        put(later, f"{i}.jsonl", f'{{"k":{i}}}\n')
    single.clear()
    ingest_directory_stream(spark, later, str(tmp_path / "out2"), str(tmp_path / "mark2")).awaitTermination()
    assert single == [] and spark.read.parquet(str(tmp_path / "out2") + "/sources").count() == 4


def test_custom_format(spark, tmp_path):
    import sys

    from pyspark import cloudpickle

    from logloom.sources.formats import read_format, register_format

    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def parse(path, options):
        def rows():
            with open(path, encoding="utf-8") as f:
                for line in f:
                    yield line.rstrip("\n").split(options["mark"])

        return {"columns": ["n", "N", "size"], "rows": rows(), "column_types": [None, "text", "number"]}

    register_format(spark, "marked", parse)
    a = put(tmp_path, "a.mk", "".join(f"{i}~x~{i}\n" for i in range(1, 10_001)))
    b = put(tmp_path, "b.mk", "7~y\n8~z~8~9\n")
    df = read_format(spark, "marked", [a, b], {"mark": "~"})
    assert logical_types(df)["size"] == "number" and df.columns == ["source_id", "rid", "n", "N_1", "size", "_ragged"]
    assert df.where("source_id = 1 AND n = rid AND NOT _ragged").count() == 10_000
    assert [tuple(r) for r in df.where("source_id = 2").orderBy("rid").collect()] == [(2, 1, "7", "y", "", True), (2, 2, "8", "z", "8", True)]


def test_custom_format_in_ranges(spark, tmp_path):
    import os
    import sys

    from pyspark import cloudpickle

    from logloom.sources.formats import even_ranges, read_format, register_format

    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def ranges(path, options):
        return even_ranges(os.path.getsize(path), 700)

    def parse(path, options):
        def rows():
            with open(path, "rb") as f:
                at = options["start"]
                if at:  # a line that began earlier belongs to the range before
                    f.seek(at - 1)
                    at += len(f.readline()) - 1
                while at < options["stop"] and (line := f.readline()):
                    at += len(line)
                    yield line.decode().rstrip("\n").split("~")

        return {"columns": ["n", "kind", "rest"], "rows": rows()}

    register_format(spark, "ranged", parse, ranges)
    a = put(tmp_path, "a.rg", "".join(f"{i}~{'even' if i % 2 == 0 else 'odd'}~{'x' * (i % 50)}\n" for i in range(1, 1001)))
    b = put(tmp_path, "b.rg", "1~even\n2~odd~y~z\n3~even~q")
    empty = put(tmp_path, "c.rg", "")
    raw = spark.read.format("ranged").options(paths=a).load()
    assert raw.rdd.getNumPartitions() > 30
    df = read_format(spark, "ranged", [a, b, empty])
    assert df.where("source_id = 1").count() == 1000 and df.where("source_id = 1 AND rid <> cast(n as int)").count() == 0
    assert [tuple(r)[1:] for r in df.where("source_id = 2").orderBy("rid").collect()] == [
        (1, "1", "even", "", True), (2, "2", "odd", "y", True), (3, "3", "even", "q", False)]
    assert df.where("source_id = 3").count() == 0
    some = read_format(spark, "ranged", [a, b], columns=["n"], where=[("kind", "equals", "even"), ("n", "in", ["4", "500", "3"])])
    assert some.columns == ["source_id", "rid", "n", "_ragged"]
    assert sorted(tuple(r) for r in some.collect()) == [(1, 4, "4", False), (1, 500, "500", False), (2, 3, "3", False)]
    for wrong in ({"columns": ["nope"]}, {"where": [("kind", "regex", "x")]}, {"where": [("nope", "equals", "x")]}):
        with pytest.raises(ValueError):
            read_format(spark, "ranged", [a], **wrong)


def test_tagged_export_in_files(spark, tmp_path):
    rows = [(i, f'cell "{i}", {"=1+1" if i % 2 else " b "}', None if i % 3 else i) for i in range(1, 301)]
    first = Source(1, "first", spark.createDataFrame(rows, "rid bigint, `a b` string, n int").repartition(3))
    other = Source(2, "other", spark.createDataFrame([(1, "x\ny"), (2, "z")], "rid bigint, other string"))
    none = Source(3, "none", spark.createDataFrame([(1, "x")], "rid bigint, q string"))
    tags = spark.createDataFrame([(1, r, t) for r in range(1, 301) for t in (1, 2) if r % t == 0 and r % 7] + [(2, 1, 1), (9, 1, 1)], "source_id int, rid bigint, tag_id int")
    defs = spark.createDataFrame([(1, "One", "#1", None)], "id int, name string, color string, hotkey string")
    notes = spark.createDataFrame([(1, 2, "look; here")], "source_id int, rid bigint, note string")
    path = str(tmp_path / "t")
    assert sinks.export_tagged([other, first, none], path, tags, defs, notes, rows_per_file=50) == [1, 2]
    files = sorted(os.listdir(path + "/source_id=1"))
    assert sum(f.startswith("part") for f in files) >= 5
    read = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    got = sorted(read.csv(path + "/source_id=1").collect(), key=lambda r: int(r["Line"]))
    kept = [r for r in range(1, 301) if r % 7]
    assert [int(r["Line"]) for r in got] == kept and got[0].asDict().keys() == {"Line", "Tags", "Note", "a b", "n"}
    assert got[1]["Tags"] == "One; 2" and got[1]["Note"] == "look; here" and got[0]["a b"] == 'cell "1", =1+1'
    assert [tuple(r) for r in read.csv(path + "/source_id=2").collect()] == [("1", "One", None, "x\ny")]
    for f in files:  # every file is in order below its header
        if f.startswith("part"):
            lines = open(f"{path}/source_id=1/{f}").read().splitlines()
            numbers = [int(x.split(",")[0]) for x in lines[1:]]
            assert lines[0] == "Line,Tags,Note,a b,n" and numbers == sorted(numbers)
    assert sinks.export_tagged([none], str(tmp_path / "u"), tags, defs, notes) == []


def test_tagged_export_in_very_many_files(spark, tmp_path, monkeypatch):
    defs = spark.createDataFrame([(1, "One", "#1", None)], "id int, name string, color string, hotkey string")
    notes = spark.createDataFrame([], "source_id int, rid bigint, note string")
    rows = spark.range(1, 1501).select(F.col("id").alias("rid"), F.concat(F.lit("v"), "id").alias("v")).repartition(4)
    tags = spark.range(1, 1501).selectExpr("int(id % 2 + 1) AS source_id", "id AS rid", "1 AS tag_id")
    for per_task, path in ((50_000, str(tmp_path / "one")), (100, str(tmp_path / "several"))):
        monkeypatch.setattr(sinks, "ROWS_PER_TASK", per_task, raising=False)
        assert sinks.export_tagged([Source(1, "a", rows), Source(2, "b", rows)], path, tags, defs, notes, rows_per_file=1) == [1, 2]
        for sid in (1, 2):
            files = [f for f in os.listdir(f"{path}/source_id={sid}") if f.startswith("part")]
            held = [open(f"{path}/source_id={sid}/{f}").read().splitlines() for f in sorted(files)]
            assert all(lines[0] == "Line,Tags,Note,v" and len(lines) == 2 for lines in held)
            assert [lines[1] for lines in held] == [f"{r},One,,v{r}" for r in range(1, 1501) if r % 2 + 1 == sid]


def test_quotes_that_are_never_closed(spark, tmp_path):
    lines = [f"{i};note {i}" for i in range(400)]
    lines[20] = '20;"left open'
    lines[150] = '150;"two\nlines"'
    lines[300] = '300;"open again'
    path = put(tmp_path, "open.csv", "N;Note\n" + "\n".join(lines) + "\n")
    got = delimited.read_delimited(spark, path, max_lines=50)
    rows = {r["N"]: r["Note"] for r in got.frame.collect()}
    assert got.frame.count() == 400 and got.ragged_rows == 2
    assert sorted(r["rid"] for r in got.frame.collect()) == list(range(1, 401))
    assert rows["150"] == "two\nlines" and rows["21"] == "note 21" and rows["399"] == "note 399" and "left open" in rows["20"]
    # Without a limit in reach the rest of the file is one cell, as quoting has it.
    whole = delimited.read_delimited(spark, put(tmp_path, "rest.csv", 'N;Note\n1;a\n2;"b\n3;c\n'))
    assert whole.frame.count() == 2


def test_many_blank_lines_before_the_header(spark, tmp_path):
    path = put(tmp_path, "blank.csv", "\n" * 25 + " \n\ufeffA;B\n1;2\n\n3;4\n")
    got = delimited.read_delimited(spark, path)
    assert got.frame.columns == ["source_id", "rid", "A", "B"]
    assert [tuple(r)[2:] for r in got.frame.orderBy("rid").collect()] == [("1", "2"), ("", ""), ("3", "4")]
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, put(tmp_path, "none.csv", "\n \n"))


def test_json_keys_that_differ_by_case_only(spark, tmp_path):
    path = put(tmp_path, "c.jsonl", '{"Id":1,"in":{"a":1}}\n{"id":2,"in":{"A":"x"}}\n')
    rows = json_records.read_json_records(spark, path, "full").orderBy("rid").collect()
    assert sorted(rows[0].asDict()) == sorted(["source_id", "rid", "Id", "id_1", "in.A", "in.a_1"])
    assert (rows[0]["Id"], rows[1]["id_1"], rows[0]["in.a_1"], rows[1]["in.A"]) == ("1", "2", "1", "x")
    assert spark.conf.get("spark.sql.caseSensitive") == "false"


def test_broken_json_is_not_swallowed(spark, tmp_path):
    path = put(tmp_path, "b.jsonl", '{"a":1}\n{"a":\n')
    with pytest.raises(Exception, match="MALFORMED"):
        json_records.read_json_records(spark, path)


def test_row_local_operators_run_on_a_stream(spark, tmp_path):
    from logloom.operators.derived import flatten_column
    from logloom.operators.view import apply_spec

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    keyed = ["1 AS source_id", "event_id + 1 AS rid", "CAST(ts AS STRING) AS raw", "event_type", "props"]
    spec = {"filters": [{"column": "event_type", "op": "contains", "value": "ERR"}], "search": "k", "time_range": {"start": "2024-01-10"}}

    def triage(df):
        rows = apply_spec(df.selectExpr("*", "ts AS seen").selectExpr(*keyed, "seen"), spec)
        return flatten_column(add_derived(rows, "moment", "raw", "iso8601"), "props", {"k": "$.k"}).select("rid", "moment", "k")

    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    out = str(tmp_path / "out")
    triage(stream).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "mark")
    ).trigger(availableNow=True).start().awaitTermination()
    wanted = triage(events)
    got = spark.read.parquet(out)
    assert got.count() == wanted.count() > 0 and got.exceptAll(wanted).isEmpty()
