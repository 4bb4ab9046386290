"""Cross-tokenizer alignment against a plain program."""

import hashlib
import json
from collections import Counter

import numpy as np
import odd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from logloom.llm import alignment
from logloom.llm.queries import QUERIES

EXTRA = [
    (900, "<|endoftext|> as plain text <s> </s> <unk> <0x41>"), (901, "a▁b"), (902, "two  spaces   and\ttabs\n\nlines "), (903, " leading"),
    (904, "ﬁ ligature ½ Å"), (905, "漢字かな交じり文 😀😀 \x00 end"), (906, "a"), (907, "1234567890 " * 300), (908, "�"),
]


def byte_letters():
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Plain:
    def __init__(self):
        path = public_tokenizers.path("byte_bpe_50k.json")
        self.a = Tokenizer.from_file(path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            self.a_bytes = {i: bytes(letters[c] for c in t) for t, i in json.load(f)["model"]["vocab"].items() if t != "<|endoftext|>"}
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, self.a_bytes[i]) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if all(b"".join(t for _, t in side) == whole for side in (a, b)) else ([], [])

    def aligned(self, text):
        """ids of both sides, links, groups' text"""
        sides = []
        for side in self.tokens(text):
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            sides.append(out)
        a, b = sides
        linked, low = [], 0
        for i, s, e in a:
            while low < len(b) and b[low][2] <= s:
                low += 1
            j = low
            while j < len(b) and b[j][1] < e:
                linked.append((i, b[j][0]))
                j += 1
        groups, x, y = [], 0, 0
        for end in sorted({t[2] for t in a} & {t[2] for t in b}):
            left, right = [], []
            while x < len(a) and a[x][2] <= end:
                left.append(str(a[x][0]))
                x += 1
            while y < len(b) and b[y][2] <= end:
                right.append(str(b[y][0]))
                y += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        return len(a), len(b), linked, groups


def wanted(rows):
    plain = Plain()
    known = {t: plain.aligned(t) for _, t in rows}
    total = Counter()
    for _, t in rows:
        total.update(known[t][2])
    most = {}
    for (_, b), n in total.items():
        most[b] = max(most.get(b, 0), n)
    out = Counter()
    for d, t in rows:
        n_a, n_b, linked, groups = known[t]
        out[
            d, n_a, n_b, len(groups), len(linked), sum(total[p] == most[p[1]] for p in linked), sum(total[p] for p in linked),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        ] += 1
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query(spark, odd_tables):
    rows = [(d, t) for d, t, _ in odd.texts()]
    assert Counter(map(tuple, QUERIES["op12_token_alignment"](spark, odd_tables).select(*COLUMNS).collect())) == wanted(rows)


@pytest.mark.parametrize("part, cut", [(1, 50), (3000, 5), (1 << 20, 700)])
def test_parts_and_slices(spark, monkeypatch, part, cut):
    monkeypatch.setattr(alignment, "PART", part)
    monkeypatch.setattr(alignment, "SLICE", cut)
    rows = EXTRA + [(i, odd.words(i, 30)) for i in range(20)] + [(50, odd.words(77, 900)), (51, None), (None, odd.words(3, 30))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert Counter(map(tuple, alignment.align(df).select(*COLUMNS).collect())) == wanted(rows)


def test_links_are_all_overlaps():
    rng = np.random.default_rng(5)
    for _ in range(50):
        ends = [np.append(np.sort(rng.choice(np.arange(1, 60), rng.integers(0, 40), False)), 60) for _ in range(2)]
        starts = [np.concatenate([[0], e[:-1]]) for e in ends]
        doc = [np.zeros(len(e), np.int64) for e in ends]
        got = set(zip(*(x.tolist() for x in alignment.links(starts[0], doc[0], starts[1], doc[1]))))
        assert got == {
            (i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]
        }
