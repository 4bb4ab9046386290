"""A JSON array in one file, read in many splits."""

import json
import random

import pytest

from logloom.sources.json_array import array_items, split_arrays
from logloom.sources.json_records import read_json_records


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes, several to a task or one each."""
    names = {"spark.sql.files.maxPartitionBytes": "151", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def write(tmp_path, text, name="a.json"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def items(spark, path):
    pieces, others = split_arrays(spark, [path])
    assert others == []
    rows = sorted(array_items(pieces).collect(), key=lambda r: (r["_block"], r["_seq"]))
    seen = {}
    for r in rows:  # numbers are dense in every split
        seen[r["_block"]] = seen.get(r["_block"], 0) + 1
        assert r["_seq"] == seen[r["_block"]]
    return [json.loads(r["text"]) for r in rows], len(seen)


def value(rng, depth=0):
    kind = rng.random()
    if kind < 0.3 and depth < 4:
        return {rng.choice(["a", "b", "}", '"', "k]"]): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    if kind < 0.45 and depth < 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, 1, -2.5, "", "plain", 'a "quoted" }{][, text', "\\", "\\\\\"}", "ünï 漢 😀", "},{", "line\nbreak", "x" * 90])


@pytest.mark.parametrize("seed", range(2))
def test_any_array(small_splits, tmp_path, seed):
    rng = random.Random(seed)
    data = [{"n": i, "v": value(rng)} if rng.random() < 0.8 else value(rng) for i in range(50)]
    text = json.dumps(data, indent=rng.choice([None, 2]), ensure_ascii=seed % 2 == 0, separators=rng.choice([None, (",", ":")]))
    got, splits = items(small_splits, write(tmp_path, rng.choice(["", "﻿", " \n"]) + text + rng.choice(["", "\n ", "\r\n"])))
    assert got == data and splits > 5


@pytest.mark.parametrize("data", [[], [1], ["}"], [[]], [{}], [{}, {}], [[{"a": 1}], {"b": [2]}], [1, {"a": "]"}, 2, "x", {"b": {"c": {}}}, [3]], [{"long": "y" * 1500}, 7]])
def test_edges(small_splits, tmp_path, data):
    assert items(small_splits, write(tmp_path, json.dumps(data)))[0] == data


@pytest.mark.parametrize("text", ['[{"a":1},{"b":2}', '[{"a":1}}]', '[{"a":"1}]', '[{"a":1},{"b":[2}]', '[{"a":1}]]'])
def test_broken(small_splits, tmp_path, text):
    with pytest.raises(Exception):
        read_json_records(small_splits, write(tmp_path, text)).collect()


def test_records_equal_the_lines_form(small_splits, tmp_path):
    rng = random.Random(5)
    data = [{"id": i, "user": {"name": f"u{i % 7}", "admin": i % 2 == 0}, "tags": ["a", {"b": i}], "note": value(rng)} for i in range(12)]
    array = write(tmp_path, json.dumps(data, indent=1))
    lines = write(tmp_path, "\n".join(json.dumps(d) for d in data), "a.jsonl")
    for flatten, depth in (("none", 0), ("full", 0)):
        one, two = (read_json_records(small_splits, p, flatten, depth) for p in (array, lines))
        assert one.columns == two.columns and one.select("rid").orderBy("rid").collect() == [(i,) for i in range(1, 13)]
        plain = [c for c in one.columns if c not in ("tags", "user", "note") and not c.startswith("note.")]  # raw text keeps its own blanks
        assert sorted(map(tuple, one.select(*[f"`{c}`" for c in plain]).collect())) == sorted(map(tuple, two.select(*[f"`{c}`" for c in plain]).collect()))
        for a, b in zip(one.orderBy("rid").collect(), two.orderBy("rid").collect()):
            for c in set(one.columns) - set(plain):
                assert a[c] == b[c] or json.loads(a[c]) == json.loads(b[c])


def test_many_tasks(spark, tmp_path):
    spark.range(60_000).selectExpr("to_json(struct(id, repeat('z', 20) AS z)) AS j").coalesce(1).write.text(str(tmp_path / "l"))
    lines = [p for p in (tmp_path / "l").iterdir() if p.name.startswith("part")][0].read_text().splitlines()
    path = write(tmp_path, "[" + ",".join(lines) + "]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        pieces, _ = split_arrays(spark, [path])
        assert pieces.rdd.getNumPartitions() > 8
        got = read_json_records(spark, path)
        assert got.count() == 60_000 and got.where("rid <> cast(id as bigint) + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
