"""The prefix trie against a plain program."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import odd
import pytest

from logloom.llm import prefix_trie as trie
from logloom.llm.queries import QUERIES
from logloom.llm.radix import Few, Full, Indexed, RadixTree


def tie(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, tie(role, text), (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        s = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return Counter(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())
        for p, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_query(spark, odd_tables):
    rows = QUERIES["op11_prefix_trie"](spark, odd_tables).select(*COLUMNS).collect()
    assert Counter(map(tuple, rows)) == plain(odd.conversations())


@pytest.mark.parametrize("segment, tree", [(1, 1 << 20), (7, 400), (60, 3000), (75, 1 << 20)])
def test_segments_and_small_trees(spark, monkeypatch, segment, tree):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "TREE_BYTES", tree)
    monkeypatch.setattr(trie, "HOT_ROWS", 3)
    rows = odd.conversations()
    df = spark.createDataFrame([r for r in rows], "conv_id bigint, turn bigint, role string, text string").repartition(5)
    assert Counter(map(tuple, trie.prefix_trie(df).select(*COLUMNS).collect())) == plain(rows)


def test_radix_tree():
    rng = random.Random(1)
    for width, header, spread in ((1, 0, 256), (2, 0, 40), (3, 2, 5), (2, 0, 300)):
        keys = []
        for _ in range(900):
            parts = [rng.randrange(spread) for _ in range(rng.randint(0, 4))]
            keys.append(b"hd"[:header] + b"".join(p.to_bytes(width, "big") if width > 1 else bytes([p]) for p in parts))
        tree = RadixTree(width, lambda a, b: a + b, header)
        for k in keys:
            tree.insert(k, 1)
        wanted = Counter(k[: header + d * width] for k in keys for d in range((len(k) - header) // width + 1))
        got = Counter()
        for key, first, last, n in tree.walk():
            for d in range(first, last + 1):
                assert key[: header + d * width] not in got
                got[key[: header + d * width]] = n
        assert got == wanted


def test_layouts_grow():
    layout, kinds = Few(), []
    for byte in random.Random(2).sample(range(256), 256):
        if not layout.put(byte, str(byte)):
            layout = layout.grown()
            assert layout.put(byte, str(byte))
        kinds.append((type(layout), layout.room))
    assert list(dict.fromkeys(kinds)) == [(Few, 4), (Few, 16), (Indexed, 48), (Full, 256)]
    assert layout.items() == [(b, str(b)) for b in range(256)] and layout.get(7) == "7"
