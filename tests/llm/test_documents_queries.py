"""The queries over documents against plain programs, on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import odd
import pytest

from logloom.llm.queries import QUERIES

DOC_QUERIES = [n for n in QUERIES if n not in ("op4_kdtree_topk", "op5_multi_index")]


def collect(spark, name, folder):
    return QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_tables, name):
    assert collect(spark, name, empty_tables) == []


def test_mix(spark, odd_tables):
    rows = collect(spark, "op1_mix_sources", odd_tables)
    docs = odd.texts()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, size(t)) for d, t, _ in docs)
    total = Counter()
    for _, t, s in docs:
        total[s] += size(t)
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, clamped = 1.5 * sum(total.values()), set()
    while True:  # deal out what is left by weight, clamp, again
        free = [s for s in names if s not in clamped]
        left = budget - sum(2 * total[s] for s in clamped)
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] >= 2 * total[s]}
        if not over:
            break
        clamped |= over
    target |= {s: 2 * total[s] for s in clamped}
    by_size = defaultdict(list)
    for s in names:
        by_size[total[s]].append(target[s])
    taken, largest = Counter(), max(size(t) for _, t, _ in docs)
    for r in rows:
        assert any(abs(r["target"] - t) < 1e-6 for t in by_size[r["source_size"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source_size"], r["target"]] += r["taken"]
    for (_, t), words in taken.items():
        assert abs(words - t) <= largest / 2 + 1
    again = collect(spark, "op1_mix_sources", odd_tables)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def removed_spans(texts, window=400):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    for t in texts:
        mark = np.zeros(len(t) + 2, int)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                mark[i + 1] += 1
                mark[i + window + 1] -= 1
        covered = np.cumsum(mark)[1:-1] > 0
        yield covered, int(np.count_nonzero(np.diff(np.concatenate(([0], covered.view(np.int8)))) == 1))


def shared_words(texts, window=51):
    """Per text the words in windows that another row holds too."""
    words = [re.findall(rb"[^\x20\x09-\x0D]+", t.lower()) for t in texts]  # bytes: only A-Z fold
    held = defaultdict(set)
    for k, w in enumerate(words):
        for i in range(len(w) - window + 1):
            held[tuple(w[i : i + window])].add(k)
    out = []
    for w in words:
        inside = set()
        for i in range(len(w) - window + 1):
            if len(held[tuple(w[i : i + window])]) > 1:
                inside.update(range(i, i + window))
        out.append(len(inside))
    return out


def test_suffix(spark, odd_tables):
    texts = [(d, (t or "").encode()) for d, t, _ in odd.texts()]
    shared = shared_words([t for _, t in texts])
    wanted = Counter()
    for (d, t), (covered, runs), n in zip(texts, removed_spans([t for _, t in texts]), shared):
        kept = bytes(np.frombuffer(t, np.uint8)[~covered]) if t else b""
        wanted[d, len(t), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest(), n] += 1
    assert Counter(map(tuple, collect(spark, "op2_suffix_dedup", odd_tables))) == wanted


def test_suffix_long_text_in_parts(spark, monkeypatch):
    from logloom.llm import suffix

    monkeypatch.setattr(suffix, "PART", 5000)
    monkeypatch.setattr(suffix, "SAMPLE_BUCKET", 4000)
    monkeypatch.setattr(suffix, "SUFFIX_BUCKET", 1000)
    one, two = odd.words(21, 3000), odd.words(22, 2500)
    texts = [one + two, two[50:9000] + one[4000:4700], one[100:499], one[100:500], two, "y" * 12_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (bytes(r["kept"]), len(r["spans"]), r["n_shared_words"]) for r in suffix.repeated_spans(docs).collect()}
    raw = [t.encode() for t in texts]
    for i, (t, (covered, runs), n) in enumerate(zip(raw, removed_spans(raw), shared_words(raw))):
        assert got[i] == (bytes(np.frombuffer(t, np.uint8)[~covered]), runs, n)


def test_shared_passages(spark):
    """A passage counts where another document holds it, however short it is in
    bytes, and not where a text repeats itself."""
    from logloom.llm import suffix

    passage, other = " ".join("ab" for _ in range(3)) + " " + odd.words(31, 52), odd.words(32, 60)
    texts = [
        "x " + " ".join(passage.split()[:51]), passage.upper() + " end", " ".join(passage.split()[:50]), other + " | " + other, "a b " * 26, None, "",
        *[odd.words(40 + i, 200) for i in range(20)],
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["n_shared_words"] for r in suffix.repeated_spans(docs).collect()}
    assert got == dict(enumerate(shared_words([(t or "").encode() for t in texts]))) and got[0] == got[1] == 51 and got[3] == 0


def test_quality(spark, odd_tables):
    rows = collect(spark, "op3_quality", odd_tables)
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _, _ in odd.texts())
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1)}) == 1  # null and empty are alike


def plain_statistics(text):
    """The classifier's statistics of one text, counted one by one."""
    import math

    b = (text or "").encode()
    marks, space = b".,;:'\"!?()-", b" \t\n\x0b\x0c\r"
    words = [m.group() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
    folded = [w.lower() for w in words]
    n, pairs = len(words), Counter(zip(folded, folded[1:]))
    solid = sum(c not in space for c in b)
    lines = [(m.start(), m.group().lower()) for m in re.finditer(rb"[^\n\r]+", b)]
    repeated, seen = 0, set()
    for (start, line), stop in zip(lines, [s for s, _ in lines[1:]] + [len(b)]):
        repeated += stop - start if line in seen else 0
        seen.add(line)
    symbol = lambda c: 33 <= c < 127 and not chr(c).isalnum() and c not in marks
    rate = lambda part, whole, usual, weight: math.log((part + usual * weight) / (whole + weight))
    columns = [
        math.log(n + 20), rate(solid, n, 5.0, 20), rate(sum(65 <= c <= 90 for c in b), solid, 0.02, 100),
        rate(sum(48 <= c <= 57 for c in b), solid, 0.002, 100), rate(sum(c in marks for c in b), solid, 0.03, 100),
        rate(sum(map(symbol, b)), solid, 0.002, 100), rate(sum(c >= 192 for c in b), solid, 0.02, 100),
        rate(len(set(folded)), n, 1.0, 20), rate(max(Counter(folded).values(), default=0), n, 0.06, 20),
        rate(len(pairs), max(n - 1, 0), 1.0, 20), rate(repeated, len(b), 0.002, 500), rate(len(b), len(lines), 200.0, 3),
        rate(sum(65 <= w[0] <= 90 for w in words), n, 0.1, 20),
        rate(sum((symbol(x) + (x == 33)) for x, y in zip(b, b[1:]) if y in space), n, 0.002, 20),
    ]
    return [int(np.rint(c * 4096)) for c in columns]


def plain_scores(docs, labels):
    """Regularised quadratic discriminant analysis with numpy's own covariance."""
    from logloom.llm.quality import OWN, SHARED

    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1
    said = defaultdict(set)
    for d, q, *_ in labels:
        if d is not None and q in (0, 1) and not held(d):
            said[d].add(q)
    x = np.array([plain_statistics(t) for _, t in docs]) / 4096
    of = [[i for i, (d, _) in enumerate(docs) if said.get(d) == {c}] for c in (0, 1)]
    if min(map(len, of)) < 2:
        return [0.5] * len(docs)
    own = [np.cov(x[at].T, bias=True) for at in of]
    pooled = sum(c * len(at) for c, at in zip(own, of)) / sum(map(len, of))
    density = []
    for c, at in zip(own, of):
        s = SHARED * (OWN * c + (1 - OWN) * pooled) + (1 - SHARED) * np.diag(np.maximum(np.diag(pooled), 1e-6))
        gap = x - x[at].mean(0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s), gap) - 0.5 * np.linalg.slogdet(s)[1])
    z = (density[1] - density[0] + np.log(len(of[1]) / len(of[0]))) / x.shape[1]
    return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def test_quality_against_a_plain_fit(spark, odd_tables):
    labels = [tuple(r) for r in spark.read.parquet(f"{odd_tables}/labels.parquet").collect()]
    docs = [(d, t) for d, t, _ in odd.texts()]
    wanted = sorted(((d is not None, d or 0, round(s, 6)) for (d, _), s in zip(docs, plain_scores(docs, labels))))
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, round(r["score"], 6)) for r in collect(spark, "op3_quality", odd_tables))
    assert len({s for _, _, s in wanted}) > 20
    for a, b in zip(got, wanted):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    scores = {r["doc_id"]: r for r in collect(spark, "op3_quality", folder)}
    held = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if scores[r["doc_id"]]["held_out"]]
    for wanted in (0, 1):
        right = [scores[r["doc_id"]]["predicted"] == wanted for r in held if r["quality"] == wanted]
        assert sum(right) >= 0.95 * len(right)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_groups(texts, k, percent):
    """Number of each text's group, by comparing all pairs."""
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return sets, root


def test_minhash(spark, odd_tables):
    docs = odd.texts()
    sets, root = near_groups([t for _, t, _ in docs], 3, 85)
    lowest = {}
    for (d, _, _), r in zip(docs, root):
        if d is not None:
            lowest[r] = min(d, lowest.get(r, d))
    wanted = Counter()
    for (d, _, _), s, r in zip(docs, sets, root):
        c = lowest.get(r) if s else d
        wanted[d, len(s), c, d == c] += 1
    assert Counter(map(tuple, collect(spark, "op6_minhash", odd_tables))) == wanted


def test_minhash_blocks(spark):
    """A bucket of several blocks gives the groups of one block."""
    from logloom.llm import minhash

    base = odd.words(31, 60).split()
    texts = [" ".join(base[:i] + [f"w{i}"] + base[i + 1 :]) for i in range(60)] + [" ".join(base[:30] + odd.words(i, 30).split()) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sketched = minhash.sketch(docs, 3, 0.85)
    _, root = near_groups(texts, 3, 85)
    for block in (7, 512):
        linked = {r["node"]: r["component"] for r in minhash.link_classes(sketched, "text", 3, 85, block).collect()}
        low = {r["low"]: r["node"] for r in sketched.classes.select("low", "node").collect()}
        group = [linked.get(low[i], low[i]) for i in range(len(texts))]
        assert len(set(zip(group, root))) == len(set(group)) == len(set(root))


def test_reshard(spark, odd_tables):
    rows = collect(spark, "op7_reshard", odd_tables)
    raw = [(d, (t or "").encode()) for d, t, _ in odd.texts()]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, len(t) + 1, zlib.crc32(t)) for d, t in raw)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))


def test_reshard_is_even_and_moves_little(spark):
    from logloom.llm.resharding import OLD_SHARDS, Block, assign_blocks, shortest_flow

    rows = collect(spark, "op7_reshard", "/root/testdata/sf0.01")
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) < 0.01 * sum(load.values())
    flow = shortest_flow([50, 30, 0], [20, 30, 30], [[i != j for j in range(3)] for i in range(3)])
    assert [sum(f) for f in flow] == [50, 30, 0] and sum(f for i, r in enumerate(flow) for j, f in enumerate(r) if i != j) == 30
    blocks = [Block(i % OLD_SHARDS, i, 10) for i in range(600)]
    place = assign_blocks(blocks, OLD_SHARDS, 8)
    assert sum(place[b.old, b.block] != b.old for b in blocks) == 600 * 2 // 8


def test_reshard_rewrites_changed_shards_only(spark, tmp_path):
    from pyspark.sql import functions as F

    from logloom.llm.resharding import rewrite

    docs = spark.createDataFrame([(i, "x" * 99, str(i), i % 3) for i in range(300)], "doc_id bigint, text string, shard string, old int")
    even = rewrite(docs, F.col("old"), 3, 3, str(tmp_path / "a"))
    assert even.changed == ()
    plan = rewrite(docs, F.when(F.col("old") == 0, 0).otherwise(1), 2, 2, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert plan.changed == (0, 1) and back.count() == 300 and "shard_" in back.columns


def test_pack(spark, odd_tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = collect(spark, "op8_pack", odd_tables)
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted, total = Counter(), 0
    for d, t, _ in odd.texts():
        ids = np.array(encode.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        total += len(ids)
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == wanted
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= 1.02 * -(-total // 1024) + 1


def test_packed_sequences(spark):
    from logloom.llm.packing import sequences

    docs = spark.createDataFrame([(i, odd.words(i, 20 + 7 * i)) for i in range(40)], "doc_id bigint, text string")
    rows = sequences(docs, places=128).collect()
    assert all(len(r["ids"]) == 4 * sum(p["length"] for p in r["pieces"]) <= 512 for r in rows)


@pytest.mark.parametrize("histogram", [{}, {1: 5}, {1024: 3}, {512: 3, 513: 1}, {600: 10, 424: 9, 1: 4}, {n: n % 7 for n in range(1, 1025)}])
def test_fillings_cover_exactly(histogram):
    from logloom.llm.packing import fillings

    used = Counter()
    for lengths, times in fillings({k: v for k, v in histogram.items() if v}):
        assert sum(lengths) <= 1024
        for n in lengths:
            used[n] += times
    assert used == Counter({k: v for k, v in histogram.items() if v})


def test_training_order(spark, odd_tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    from logloom.llm.training_order import LENGTH, PER_SHARD

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = collect(spark, "op9_training_order", odd_tables)
    assert sorted(r["slot"] for r in rows) == sorted(r["number"] for r in rows) == list(range(len(rows)))
    wanted = Counter()
    for d, t in [(d, t or "") for d, t, _ in odd.texts()]:  # rows that repeat id and text are written each
        ids = encode.encode(t, add_special_tokens=False).ids
        for i in range(max(1, -(-len(ids) // (LENGTH - 1)))):
            part = ids[i * (LENGTH - 1) : (i + 1) * (LENGTH - 1)]
            wanted[d, i, len(part), zlib.crc32(np.array(part + [2] * (LENGTH - len(part)), "<u2").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["n_ids"], r["ids_crc32"]) for r in rows) == wanted
    assert all(divmod(r["slot"], PER_SHARD) == (r["shard"], r["byte_offset"] // (2 * LENGTH)) for r in rows)


def test_training_order_resumes(spark, tmp_path):
    from logloom.llm.tokens import Encoder, vocabulary
    from logloom.llm.training_order import write_order

    texts = {i: odd.words(i, 11 * i) for i in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    order = write_order(docs, str(tmp_path / "o"), length=32, per_shard=10)
    whole = {r["slot"]: bytes(r["record"]) for r in order.read(spark).collect()}
    assert sorted(whole) == list(range(order.permutation.size))
    part = {r["slot"]: bytes(r["record"]) for r in order.read(spark, 17, 40).collect()}
    assert part == {s: whole[s] for s in range(17, 57)}
    encoder = Encoder(vocabulary())
    pieces = defaultdict(dict)
    for r in order.index.collect():
        pieces[r["doc_id"]][r["piece"]] = np.frombuffer(whole[r["slot"]], "<u2")[: r["n_ids"]]
    for d, t in texts.items():
        assert np.concatenate([pieces[d][i] for i in sorted(pieces[d])]).tolist() == encoder.ids(t).tolist()


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(size):
    from logloom.llm.training_order import Permutation

    p = Permutation(size)
    slots = p.slot(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size)) and p.number(slots).tolist() == list(range(size))
    assert size < 64 or slots.tolist() != Permutation(size, key=5).slot(np.arange(size)).tolist()


BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    ("access", re.compile(r"(AKIA[A-Z0-9]+)"), 1, 20), ("hex", re.compile("([0-9a-f]+)"), 1, 24),
]


def test_secrets(spark, odd_tables):
    wanted = Counter()
    for d, t, _ in odd.texts():
        found = sorted((m.start(), i, m.end()) for i, (_, p, g, n) in enumerate(BASE) for m in p.finditer(t or "") if len(m.group(g)) >= n)
        text = ",".join(f"{BASE[i][0]}:{s}:{e}" for s, i, e in found)
        wanted[(d, *(sum(i == k for _, i, _ in found) for k in range(3)), hashlib.sha256(text.encode()).hexdigest(), text)] += 1
    assert Counter(map(tuple, collect(spark, "op10_secret_scan", odd_tables))) == wanted


def test_random_strings_are_found(spark):
    """Random strings without a name are secrets, long words are not."""
    import random

    from logloom.llm.secret_scan import scan

    rng = random.Random(3)
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    secret = ["".join(rng.choice(symbols) for _ in range(40)) for _ in range(200)]
    plain = ["".join(rng.choice(["keit", "lich", "ung", "er", "heit", "be"]) for _ in range(10)) for _ in range(400)]
    rows = [(i, f"see {s} there") for i, s in enumerate(secret)] + [(1000 + i, f"see {s} there") for i, s in enumerate(plain)]
    scanned, _ = scan(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = {r["row"]["doc_id"] for r in scanned.where("size(spans) > 0").collect()}
    assert sum(d < 1000 for d in found) > 190 and sum(d >= 1000 for d in found) <= 5


def plain_tests(token):
    """(encoding, length, half nats, nats) of a token by the textbook formulas."""
    import math

    from logloom.llm.secret_scan import ALPHABETS, HALVES, NATS
    from logloom.llm.words import SYMBOLS, log_steps

    s = token.rstrip("=")
    encoding, alphabet = next((i, a) for i, a in enumerate(ALPHABETS.values()) if set(s) <= set(a))
    n, k = len(s), len(alphabet)
    at = [alphabet.index(c) for c in s]
    counts = Counter(s)
    chi2 = sum((counts[c] - n / k) ** 2 / (n / k) for c in alphabet)
    chi = (chi2 - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    turns = sum((2 * a >= k) != (2 * b >= k) for a, b in zip(at, at[1:]))
    runs = (turns - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    mean = (k - 1) / 2
    serial = sum((a - mean) * (b - mean) for a, b in zip(at, at[1:])) / ((k * k - 1) / 12) / math.sqrt(n - 1)
    q = max(chi, 0) ** 2 + runs**2 + serial**2
    tail3 = math.erfc(math.sqrt(q / 2)) + math.sqrt(2 * q / math.pi) * math.exp(-q / 2)
    p = (math.exp(-q / 2) + tail3) / 2  # of two squares, or of three, half of the time each
    steps, before, words = log_steps(), 0, 0.0
    for c in s:
        words += steps[before * len(SYMBOLS) + SYMBOLS.index(c)]
        before = SYMBOLS.index(c) + 1
    return encoding, n, min(HALVES, -2 * math.log(max(min(p, 1.0), 1e-300))), max(0.0, min(NATS, -words - n * math.log(k)))


def plain_random(tokens):
    """Which tokens are reported, by sorted p-values in place of counts."""
    import math

    from logloom.llm.secret_scan import KEEP, LENGTHS, RATE

    tested = [plain_tests(t) for t in tokens]
    classes = defaultdict(list)
    for i, (e, n, odd, far) in enumerate(tested):
        classes[e, sum(n >= low for low in LENGTHS)].append(i)
    out = set()
    for members in classes.values():
        def stepped(values, rate):
            """Benjamini-Hochberg: the largest value that is rejected."""
            ordered = sorted(values)
            good = [v for i, v in enumerate(ordered) if v <= rate * sum(x <= v for x in ordered) / len(ordered)]
            return max(good, default=-1)

        odd = {i: math.exp(-math.floor(tested[i][2]) / 2) for i in members}  # as they are counted
        limit = stepped([p if p < 1 else 2 for p in odd.values()], KEEP)
        word = {i: math.exp(-math.floor(tested[i][3])) if odd[i] > limit else 2 for i in members}
        reject = stepped([w if w < 1 else 2 for w in word.values()], RATE)
        out |= {i for i in members if word[i] <= reject}
    return out


def test_random_spans_against_a_plain_program(spark):
    import random

    from logloom.llm.secret_scan import ALPHABETS, scan

    rng = random.Random(12)
    tokens = ["".join(rng.choice(a) for _ in range(n)) for a in ALPHABETS.values() for n in (20, 23, 33, 64, 130) for _ in range(4)]
    parts = ["keit", "lich", "ung", "heit", "tion", "elle", "ing", "The", "Order", "docs/", "file-", "max_", "2024"]
    tokens += ["".join(rng.choice(parts) for _ in range(rng.randint(6, 30))) for _ in range(150)] + ["ab" * 15, "0" * 40, "abcdefghijklmnopqrstuvwxyz"]
    tokens = [t for t in tokens if len(t) >= 20 and not re.search("[0-9a-f]{24}", t)]
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(tokens)], "doc_id bigint, text string").repartition(3)
    scanned, _ = scan(docs)
    got = {r["row"]["doc_id"] for r in scanned.where("exists(spans, s -> s.kind = 3)").collect()}
    wanted = plain_random(tokens)
    assert got == wanted and 100 < len(wanted) < len(tokens) - 100


@pytest.mark.parametrize("times", [1, 10, 100])
def test_lone_random_key_among_words(spark, times):
    """What is reported depends on the string, not on how often others occur."""
    import random

    from logloom.llm.secret_scan import redact, scan

    rng = random.Random(20)
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = "".join(rng.choice(symbols) for _ in range(20))
    parts = ["keit", "lich", "ung", "heit", "tion", "elle", "aux", "ing", "the", "Order", "Get", "docs/", "file-", "max_"]
    words = ["".join(rng.choice(parts) for _ in range(12))[:20] for _ in range(50)] + ["0123456789" * 3, "ab" * 20]
    rows = [(0, f"see {key} there")] + [(1 + i, f"see {w} there") for i, w in enumerate(words * times)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    scanned = scan(docs)[0].where("exists(spans, s -> s.kind = 3)")
    assert {r["row"]["doc_id"] for r in scanned.collect()} == {0}
    if times == 1:
        assert redact(docs.where("doc_id = 0")).first()["text"] == "see [SECRET] there"


def test_training_order_repeats_rows(spark, tmp_path, monkeypatch):
    """Every row has slots of its own, also one that repeats id and text."""
    from logloom.llm import training_order
    from logloom.llm.tokens import Encoder, vocabulary

    monkeypatch.setattr(training_order, "REPEATED", 4)
    monkeypatch.setattr(training_order, "HELD", 5)
    rows = [(1, odd.words(1, 60))] * 3 + [(2, "two")] * 11 + [(2, "other"), (3, "two")] + [(None, None), (None, "")] + [(4, odd.words(4, 90))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    order = training_order.write_order(docs, str(tmp_path / "o"), length=32, per_shard=10)
    held = [(r["slot"], bytes(r["record"])) for r in order.read(spark).collect()]
    index = order.index.collect()
    assert sorted(s for s, _ in held) == sorted(r["slot"] for r in index) == list(range(order.permutation.size))
    encoder, wanted, whole = Encoder(vocabulary()), Counter(), dict(held)
    for d, t in rows:
        for i, r in enumerate(training_order.records(encoder.ids(t or ""), 32, "<u2")):
            wanted[d, i, r.tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], whole[r["slot"]]) for r in index) == wanted


def test_reshard_keeps_unchanged_shards_of_a_table(spark, tmp_path):
    """On a table that holds all shards; one stays, one is left by all rows."""
    from pyspark.sql import functions as F

    from logloom.llm.resharding import rewrite

    path = str(tmp_path / "t")
    # Cells are cut by the document, so 1 and 2 even out and 0 stays.
    docs = spark.createDataFrame(
        [(i, "x" * 99, 0 if i < 100 else 1 if i < 250 else 2) for i in range(300)], "doc_id bigint, text string, old int"
    )
    docs.withColumn("shard", F.col("old")).write.partitionBy("shard").parquet(path)
    files = lambda n: sorted(p.name for p in (tmp_path / "t" / f"shard={n}").glob("*.parquet"))
    before = {n: files(n) for n in range(3)}
    plan = rewrite(docs, F.col("old"), 3, 3, path)
    assert plan.changed == (1, 2) and files(0) == before[0] and files(1) != before[1]
    assert sorted(r["doc_id"] for r in spark.read.parquet(path).collect()) == list(range(300))

    even = spark.read.parquet(path).select("doc_id", "text", F.col("shard").alias("old"))
    even = spark.createDataFrame(even.collect(), even.schema)
    before = {n: files(n) for n in range(3)}
    if rewrite(even, F.col("old"), 3, 3, path).changed == ():
        assert {n: files(n) for n in range(3)} == before
    assert spark.read.parquet(path).count() == 300

    rewrite(even, F.col("old"), 3, 2, path)
    assert not files(2) and sorted(r["doc_id"] for r in spark.read.parquet(path).collect()) == list(range(300))

    one = spark.createDataFrame([(7, "x" * 99, 0)], docs.schema)
    left = str(tmp_path / "left")
    one.withColumn("shard", F.lit(0)).write.partitionBy("shard").parquet(left)
    plan = rewrite(one, F.col("old"), 1, 2, left)
    assert [r["doc_id"] for r in spark.read.parquet(left).collect()] == [7]
