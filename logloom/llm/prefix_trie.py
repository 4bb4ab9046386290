"""The prefix trie of conversations: what conversations share from their start.

Every conversation is rebuilt from the opening turns of its hundred's first
conversation and its own later turns.  Each distinct sequence of first turns is
a node; the result says for every node who its smallest member is, how many
members, children and leaves it has, and what sharing saves below it.

A turn becomes a fixed-width big-endian id, ``WIDTH`` bytes: a digest of role
and text, and the text's length.  A conversation is a byte string of such ids,
and tasks build adaptive radix trees over them (``radix``) that emit nodes only
at depths of whole turns.  Texts never move: only ids are shuffled.

* Turns are numbered by one range sort over all of them, so a conversation of
  any length is ordered by many tasks.  It is then cut into segments of
  ``SEGMENT`` turns; a segment's key starts with the digest of all that comes
  before it, so long conversations are many short keys of many trees.
* Keys are dealt by range of (key, conversation), which keeps common starts
  together and still splits a first turn, or a whole conversation, that a third
  of the rows share.  A tree is emptied when its keys reach ``TREE_BYTES``.
  What tasks emit for the same node is added up afterwards: one row a task.
* Sums over subtrees need no walk over levels.  A conversation *owns* the nodes
  whose smallest member it is, a run of depths that ends at its last turn.  A
  node's members' characters from its depth on are additive, and so are, over
  owners, the characters that they alone add; their difference is what is saved.
* The ids that end at a node are hashed in order as they stream by, sorted; only
  the running hash is held.  SHA-256 is sequential, so the ids that end at one
  node (8 bytes each) pass through one task.

Defined results: rows without a conversation id belong to none and are left out;
turns of one number come in the order of their ids (rows that repeat a turn are
turns of their own); a null role or text is an empty one; an empty table has no
conversation and so no node, not even a root; a very long text costs its id;
other columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import join_hot_keys
from ..operators.ids import order_rows
from .common import broadcast_below, materialise, prepare, query, table
from .radix import RadixTree

WIDTH = 20  # bytes of a turn id: 16 of a digest, 4 of a length
SEGMENT = 1024  # turns of a key
HEADER = 16 + 8 + 8  # digest, characters and depth of what comes before a segment
TREE_BYTES = 32 << 20
HOT_ROWS = 100_000


def _big_endian(number: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(number.cast("bigint")), 2 * width, "0"))


def turn_id(role: Column, text: Column) -> Column:
    """``WIDTH`` bytes that tell (role, text) apart and hold the text's length."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.unhex(F.md5(whole)), _big_endian(F.length(text), 4))


def opening(conv_id: Column) -> Column:
    """How many turns a conversation takes from its hundred's first one."""
    return (F.crc32(conv_id.cast("string")) % 6).cast("int")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, id) of the rebuilt turns, places from 0, and (conv_id,
    turns) of every conversation."""
    known = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), turn_id(F.col("role"), F.col("text")).alias("id")
    )
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("id").asc()]
    rows = order_rows(known, order, "turns").frame.select("conv_id", "pos", "id")
    per = materialise(rows.groupBy("conv_id").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")), "conversations")
    placed = rows.join(broadcast_below(per, F.lit(24)), "conv_id").withColumn("own", F.col("pos") - F.col("first"))
    heads = (
        placed.where((F.col("conv_id") % 100 == 0) & (F.col("own") < 5))
        .groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("own", "id"))).alias("head"))
    )
    h = opening(F.col("conv_id"))
    lent = F.coalesce(F.slice("head", F.lit(1), F.least(h, F.size("head"))), F.array().cast("array<struct<own:bigint,id:binary>>"))
    convs = materialise(
        per.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base", "left")
        .select("conv_id", "first", "n", h.alias("h"), lent.alias("head")), "openings"
    )
    lent_rows = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.own").alias("place"), "t.id")
    short = convs.select("conv_id", "first", "h", F.size("head").alias("m"))
    own = rows.join(broadcast_below(short, F.lit(32)), "conv_id").where(F.col("pos") - F.col("first") >= F.col("h"))
    own = own.select("conv_id", (F.col("pos") - F.col("first") - F.col("h") + F.col("m")).alias("place"), "id")
    turns = F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return own.unionByName(lent_rows), convs.select("conv_id", turns.alias("turns"))


def segments(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Keys: conv_id, seg, last, header, ids (at most ``SEGMENT``) and total, the
    conversation's characters."""
    length = F.conv(F.hex(F.substring(F.col("t.id"), 17, 4)), 16, 10).cast("bigint")
    cut = (
        turns.withColumn("seg", F.call_function("div", F.col("place"), F.lit(SEGMENT)))
        .groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("t"))
        .select("conv_id", "seg", F.col("t.id").alias("ids"))
    )
    cut = cut.unionByName(convs.where("turns = 0").select(
        "conv_id", F.lit(0).cast("bigint").alias("seg"), F.array().cast("array<binary>").alias("ids")
    ))
    size = F.aggregate(
        F.transform("ids", lambda i: F.conv(F.hex(F.substring(i, 17, 4)), 16, 10).cast("bigint")),
        F.lit(0).cast("bigint"), lambda a, b: a + b,
    )
    digest = F.md5(F.array_join(F.transform("ids", lambda i: F.hex(i)), ""))
    cut = materialise(cut.withColumns({"chars": size, "digest": digest}), "segments")
    chains = cut.groupBy("conv_id").agg(
        F.sum("chars").alias("total"), F.sort_array(F.collect_list(F.struct("seg", "chars", "digest"))).alias("chain")
    )
    start = F.struct(F.lit("0" * 32).alias("link"), F.lit(0).cast("bigint").alias("chars"))
    before = F.aggregate(
        F.filter("chain", lambda c: c["seg"] < F.col("seg")), start,
        lambda a, c: F.struct(F.md5(F.concat(a["link"], c["digest"])).alias("link"), (a["chars"] + c["chars"]).alias("chars")),
    )
    joined = cut.join(chains, "conv_id").withColumn("before", before)
    header = F.concat(
        F.unhex("before.link"), _big_endian(F.col("before.chars"), 8), _big_endian(F.col("seg") * SEGMENT, 8)
    )
    return materialise(
        joined.select("conv_id", "seg", (F.col("seg") == F.size("chain") - 1).alias("last"), header.alias("header"), "ids", "total"),
        "keys",
    )


def _path(key: bytes, depth: int) -> list[tuple[bytes, int]]:
    """(node, characters before its last turn) of the first ``depth`` nodes of a
    key, from the one where the segment starts."""
    link, chars = key[:16], int.from_bytes(key[16:24], "big")
    out, state = [(link, chars)], hashlib.md5(link, usedforsecurity=False)
    for i in range(depth):
        part = key[HEADER + i * WIDTH : HEADER + (i + 1) * WIDTH]
        state.update(part)
        if i + 1 == SEGMENT:  # where the next segment starts
            ids = hashlib.md5(key[HEADER : HEADER + SEGMENT * WIDTH].hex().upper().encode(), usedforsecurity=False).hexdigest()
            node = hashlib.md5((link.hex() + ids).encode(), usedforsecurity=False).digest()
        else:
            node = state.copy().digest()
        out.append((node, chars))
        chars += int.from_bytes(part[16:], "big")
    return out


def _add(a: tuple, b: tuple) -> tuple:
    return min(a[0], b[0]), a[1] + b[1], a[2] + b[2]


NODE = "node binary, parent binary, depth bigint, before bigint, low bigint, x bigint, y bigint"


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the trees over (conv_id, header, ids, x, y): the smallest
    conv_id and the sums of x and y over members."""
    names = ["node", "parent", "depth", "before", "low", "x", "y"]
    types = [pa.binary(), pa.binary(), *[pa.int64()] * 5]

    def nodes(tree: RadixTree) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for key, first, last, (low, x, y) in tree.walk():
            path, base = _path(key, last), int.from_bytes(key[24:HEADER], "big")
            for d in range(first, last + 1):
                if d:
                    rows.append((path[d][0], path[d - 1][0], base + d, path[d][1], low, x, y))
                elif not base:
                    rows.append((path[0][0], None, 0, 0, low, x, y))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    tree, held = RadixTree(WIDTH, _add, HEADER), 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "header", "ids", "x", "y")]
        for conv_id, header, ids, x, y in zip(*columns):
            key = header + b"".join(ids)
            tree.insert(key, (conv_id, x, y))
            held += len(key) + 100
            if held > TREE_BYTES:
                yield from nodes(tree)
                tree, held = RadixTree(WIDTH, _add, HEADER), 0
    yield from nodes(tree)


def trie_nodes(keys: DataFrame, x: Column, y: Column) -> DataFrame:
    """Every node once: parent, depth, characters before its last turn, smallest
    member, sums of ``x`` and ``y`` over the members."""
    dealt = keys.select("conv_id", "header", "ids", x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    start = [F.col("header"), F.slice("ids", 1, 8), F.col("conv_id")]
    parts = dealt.repartitionByRange(*start).mapInArrow(_emit, NODE)
    same = [F.min(c).alias(c) for c in ("parent", "depth", "before", "low")]
    return parts.groupBy("node").agg(*same, F.sum("x").alias("x"), F.sum("y").alias("y"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = []
        for header, ids in zip(batch.column("header").to_pylist(), batch.column("ids").to_pylist()):
            nodes.append(_path(header + b"".join(ids), len(ids))[-1][0])
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column("conv_id")], ["node", "conv_id"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per node over sorted (node, conv_id) rows."""
    names, node, state = ["node", "ends_sha256"], None, None
    for batch in batches:
        done = []
        for at, conv_id in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if at == node:
                state.update(b",%d" % conv_id)
                continue
            if node is not None:
                done.append((node, state.hexdigest()))
            node, state = at, hashlib.sha256(b"%d" % conv_id)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.binary()), pa.array([r[1] for r in done], pa.string())], names)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names)


def end_hashes(keys: DataFrame) -> DataFrame:
    ends = keys.where("last").select("conv_id", "header", "ids").mapInArrow(_ends, "node binary, conv_id bigint")
    return ends.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_hashed, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie, with its key ``node`` and ``parent``."""
    prepare(conversations.sparkSession)
    keys = segments(*rebuilt_turns(conversations))
    nodes = materialise(trie_nodes(keys, F.lit(1), F.col("total")), "trie-nodes")
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(nodes.join(children, "node", "left").fillna(0, ["n_children"]), "trie-children")
    # The run of nodes that a conversation owns, and the characters that it alone adds.
    runs = nodes.groupBy(F.col("low").alias("conv_id")).agg(
        F.min("depth").alias("top"), F.min_by("before", "depth").alias("shared"), F.max_by("n_children", "depth").alias("on")
    )
    owners = materialise(
        runs.join(keys.where("seg = 0").select("conv_id", "total"), "conv_id")
        .select("conv_id", "top", "total", (F.col("total") - F.col("shared")).alias("adds"), (F.col("on") == 0).cast("int").alias("leaf")),
        "trie-owners",
    )
    owned = keys.join(owners.select("conv_id", "adds", "leaf"), "conv_id")
    below = trie_nodes(owned, F.col("adds"), F.col("leaf")).select("node", F.col("x").alias("added"), F.col("y").alias("n_leaves"))
    rows = (
        nodes.join(below, "node").join(end_hashes(keys), "node", "left")
        .join(owners.select(F.col("conv_id").alias("low"), "top", F.col("total").alias("owner_total"), "adds"), "low")
    )
    rows = materialise(rows, "trie-rows")
    # Below the top of a run the parent has the same owner; tops look it up.
    tops = rows.where("depth > 0 AND depth = top")
    above = nodes.select(F.col("node").alias("parent"), F.col("low").alias("parent_conv_id"))
    found = join_hot_keys(tops, above, ["parent"], HOT_ROWS, tops.limit(HOT_ROWS + 1).count())
    rest = rows.where("depth = 0 OR depth > top").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("low")))
    every = found.select(*rest.columns).unionByName(rest)
    alone = F.col("added") - F.col("adds") + F.col("owner_total") - F.col("before")  # of distinct nodes
    return every.select(
        "node", "parent", F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("x").alias("n_convs"), "n_children",
        "n_leaves", (F.col("y") - F.col("x") * F.col("before") - alone).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


_CRC_IN = "CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(s, CAST(i // 8 + 1 AS BIGINT), 1))::BIGINT) ELSE c END"
SQL = f"""
WITH turns AS (
    SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS x, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, list(x ORDER BY k) AS w FROM turns GROUP BY conv_id
), opened AS (
    SELECT conv_id, w, xor(list_reduce(list_prepend(4294967295::BIGINT, range(len(s) * 8)),
        lambda c, i: CASE WHEN ({_CRC_IN}) % 2 = 1 THEN xor(({_CRC_IN}) // 2, 3988292384::BIGINT) ELSE ({_CRC_IN}) // 2 END
    ), 4294967295::BIGINT) % 6 AS h
    FROM own
), rebuilt AS (
    SELECT o.conv_id, list_concat(coalesce(b.w[1:o.h], []), o.w[o.h + 1:]) AS s
    FROM opened o LEFT JOIN opened b ON b.conv_id = o.conv_id - o.conv_id % 100
), paths AS (
    SELECT conv_id, d, s[1:d] AS p, len(s) = d AS ends FROM rebuilt, LATERAL (SELECT unnest(range(0, len(s) + 1)) AS d)
), nodes AS (
    SELECT p, d, min(conv_id) AS low, count(*) AS n, coalesce(length(p[d].t), 0) AS chars,
           coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended
    FROM paths GROUP BY p, d
), kids AS (
    SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), counted AS (
    SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)
), below AS (
    SELECT v.p, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, sum((u.n - 1) * u.chars) AS saved_tokens
    FROM counted v JOIN counted u ON u.d >= v.d AND u.p[1:v.d] = v.p GROUP BY v.p
)
SELECT c.low AS conv_id, c.d AS depth, a.low AS parent_conv_id, c.n AS n_convs, c.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(c.ended) AS ends_sha256
FROM counted c JOIN below ON below.p = c.p LEFT JOIN counted a ON c.d > 0 AND a.d = c.d - 1 AND a.p = c.p[1:c.d - 1]"""


@query("op11_prefix_trie", SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("node", "parent")
