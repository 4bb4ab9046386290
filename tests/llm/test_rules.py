"""The quality rules against a plain program."""

import random
import re
from collections import Counter

import odd
import pytest

from logloom.llm import rules
from logloom.llm.queries import QUERIES

WORD = r"[^\x20\x09-\x0D]+"


def plain(t):
    t = t or ""
    w = re.findall(WORD, t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_stop_words": sum(x.lower() in rules.STOP_WORDS for x in w), "n_repeat_words": len(covered),
    }


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "a", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 400, "one\n\none\n one\none\r\n", "## | <b> 漢字 😀 \x85 é"]
    for n in (7, 8, 9, 17, 200, 3000):
        for letters in ("ab", "abcdefgh"):
            out.append(" ".join(rng.choice(letters) for _ in range(n)))
    phrase = odd.words(5, 11)
    return out + [f"{odd.words(6, 40)} {phrase}\n{odd.words(7, 9)} {phrase} tail", odd.words(8, 5000)]


def test_measures(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    got = {r["doc_id"]: r.asDict() for r in docs.select("doc_id", rules.measures(docs["text"]).alias("m")).select("doc_id", "m.*").collect()}
    for i, t in rows:
        assert {k: v for k, v in got[i].items() if k != "doc_id"} == plain(t), t


def test_query(spark, odd_tables):
    rows = QUERIES["op13_quality_rules"](spark, odd_tables).collect()
    wanted = Counter()
    for d, t, _ in odd.texts():
        m = plain(t)
        base = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
        wanted[(d, *(m[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base)] += 1
        assert not base or not any(r["kept"] for r in rows if r["doc_id"] == d and r["n_words"] == m["n_words"])
    assert Counter(tuple(r)[:7] for r in rows) == wanted


def test_rules_pick_what_fails(spark):
    prose = "the cat of the house and that dog is in a garden for it was on the way "
    noisy = " ".join(f"{w}%%%" for w in odd.words(9, 60).split())
    menu = " | ".join(odd.words(10, 80).split())
    rows = [(0, prose + odd.words(11, 30)), (1, noisy), (2, menu), (3, "too few words"), (4, "buy now " * 30)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    failed = {r["doc_id"]: r["quality"]["failed"] for r in rules.judge(docs).collect()}
    assert failed[0] == [] and failed[3] == ["few_words"] and failed[4][0] == "repeated_windows"
    assert {"symbols", "stop_words"} <= set(failed[1]) and "stop_words" in failed[2]
    only = rules.judge(docs, rules=(rules.Rule("long", "n_words", high=45),), into="q")
    assert {r["doc_id"]: r["q"]["failed"] for r in only.collect()} == {0: ["long"], 1: ["long"], 2: ["long"], 3: [], 4: ["long"]}
    with pytest.raises(ValueError):
        rules.judge(docs, into="text")


def test_one_projection_without_python(spark, odd_tables):
    plan = QUERIES["op13_quality_rules"](spark, odd_tables)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
