import random

import pytest

from logloom.operators import graph
from logloom.operators.hierarchy import join_hot_keys, resolve_paths
from logloom.session import materialise


def test_edges_and_degrees(spark):
    rows = [("WS1", "SRV1", "a"), ("WS1", "SRV1", "b"), ("WS2", "SRV1", "a"), ("WS1", "WS1", "a"), ("-", "SRV1", "a"), ("", "X", "a"), (None, "X", "a")]
    df = spark.createDataFrame(rows, "Src string, Dst string, User string")
    assert [tuple(r) for r in graph.edges(df, "Src", "Dst", "User").collect()] == [("WS1", "SRV1", 2, 2, False), ("WS2", "SRV1", 1, 1, False)]
    assert [tuple(r) for r in graph.edges(df, "Src", "Dst", limit=1).collect()] == [("WS1", "SRV1", 2, True)]
    degrees = {r["node"]: (r["degree"], r["out_degree"]) for r in graph.node_degrees(graph.edges(df, "Src", "Dst", limit=None)).collect()}
    assert degrees == {"WS1": (2, 2), "WS2": (1, 1), "SRV1": (3, 0)}
    with pytest.raises(ValueError):
        graph.edges(df, "Src", "Src")
    with pytest.raises(ValueError):
        graph.edges(df, "Src", "gone")


def walk(nodes, entry):
    """The path rules, one parent at a time."""
    seq, parent, parent_seq, name = nodes[entry]
    names, seen = [name], set()
    while True:
        if parent == 5:
            return "\\".join([".", *reversed(names)])
        if parent not in nodes or nodes[parent][0] != parent_seq:
            return "\\".join([".\\<orphan>", *reversed(names)])
        if parent in seen:
            return ".\\<cycle>\\" + name
        seen.add(parent)
        _, up, up_seq, above = nodes[parent]
        names.append(above)
        parent, parent_seq = up, up_seq


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_paths_against_a_walk(spark, seed, hot_rows):
    rng = random.Random(seed)
    nodes = {5: (5, 5, 5, ".")}
    for entry in range(10, 130):
        parent = rng.choice([5, 10, 10, rng.randint(10, 129), max(10, entry - 1), 999])
        nodes[entry] = (rng.choice([1, 1, 1, 2]), parent, 1, f"n{entry}")
    df = spark.createDataFrame([(e, *v) for e, v in nodes.items()], "entry bigint, seq int, parent_entry bigint, parent_seq int, name string")
    got = {r["entry"]: r["full_path"] for r in resolve_paths(df, hot_rows=hot_rows).collect()}
    assert got == {e: walk(nodes, e) for e in nodes}


def test_long_chain_and_cycle_stay_short(spark):
    chain = [(10 + i, 1, 5 if i == 0 else 9 + i, 1, f"d{i}") for i in range(70)]
    loop = [(500, 1, 501, 1, "a"), (501, 1, 500, 1, "b"), (502, 1, 502, 1, "self"), (503, 1, 500, 1, "below")]
    df = spark.createDataFrame(chain + loop, "entry bigint, seq int, parent_entry bigint, parent_seq int, name string")
    got = {r["entry"]: r["full_path"] for r in resolve_paths(df).collect()}
    assert got[79] == ".\\" + "\\".join(f"d{i}" for i in range(70))
    assert {got[e] for e in (500, 501, 502, 503)} == {".\\<cycle>\\a", ".\\<cycle>\\b", ".\\<cycle>\\self", ".\\<cycle>\\below"}


def test_hot_keys_join_like_any_left_join(spark):
    big = materialise(spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(60)] + [(99, None)], "i int, k int"), "big")
    lookup = spark.createDataFrame([(1, "one"), (3, "three")], "k int, v string")
    plain = sorted((r["i"], r["v"]) for r in big.join(lookup, "k", "left").collect())
    assert sorted((r["i"], r["v"]) for r in join_hot_keys(big, lookup, ["k"], hot_rows=5).collect()) == plain
