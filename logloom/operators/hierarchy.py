"""Parent references to full paths, and the journal-to-file join.

Frames use ``entry, seq, parent_entry, parent_seq, name``; ``entry`` is unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ref
from ..session import broadcast_if_small, materialise

ROOT_ENTRY = 5
ROOT, ORPHAN, CYCLE = ".", ".\\<orphan>", ".\\<cycle>"
HOT_ROWS = 1_000_000


def join_hot_keys(
    big: DataFrame, lookup: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, big_rows: int | None = None
) -> DataFrame:
    """``big`` left-joined to a lookup that is unique on ``keys``, when single
    keys may hold much of ``big``.

    Keys with more than ``hot_rows`` rows (at most rows / hot_rows of them) are
    joined by broadcasting their few lookup rows; the rest shuffles as usual.
    Pass written frames: ``big`` is read twice.  ``big_rows``, when known to be
    small, rules hot keys out."""
    if big_rows is not None and big_rows <= hot_rows:
        return big.join(lookup, keys, "left")
    hot = materialise(
        big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*keys), "hot"
    )
    if hot.isEmpty():
        return big.join(lookup, keys, "left")
    hot = broadcast_if_small(hot)
    few = broadcast_if_small(materialise(lookup.join(hot, keys, "left_semi"), "hot-lookup"))
    warm = big.join(hot, keys, "left_semi").join(few, keys, "left")
    # The anti-join keeps rows whose key is NULL: they are cold.
    cold = big.join(hot, keys, "left_anti").join(lookup, keys, "left")
    return warm.unionByName(cold)


def _directory_paths(nodes: DataFrame, root_entry: int, hot_rows: int) -> DataFrame:
    """``(entry, seq, path)`` of every node that is some node's parent.

    Pointer jumping: each round doubles the distance a pointer spans, so the
    rounds grow with the logarithm of the depth.  A round that closes no chain
    proves that all open ones hang on a cycle, since the ancestors of a deeper
    node would have closed; names are never joined beyond about four times the
    deepest path."""
    parents = nodes.select(F.col("parent_entry").alias("entry")).where(F.col("entry") != root_entry).dropDuplicates()
    dirs = materialise(nodes.join(parents, "entry", "left_semi"), "dirs")
    seqs = dirs.select(F.col("entry").alias("parent_entry"), F.col("seq").alias("_held"))
    linked = join_hot_keys(dirs, seqs, ["parent_entry"], hot_rows, dirs.count())
    at_root = F.col("parent_entry") == root_entry
    alive = F.col("_held").eqNullSafe(F.col("parent_seq"))
    state = materialise(
        linked.select(
            "entry", "seq",
            F.when(~at_root & alive, F.col("parent_entry")).alias("ptr"),
            F.when(at_root, F.lit(ROOT)).when(~alive, F.lit(ORPHAN)).alias("base"),
            F.col("name").alias("tail"),
        ),
        "jump",
    )
    left = state.where(F.col("ptr").isNotNull()).count()
    while left:
        hop = state.select(
            F.col("entry").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("base").alias("_base"),
            F.col("tail").alias("_tail"),
        )
        open_rows = state.where(F.col("ptr").isNotNull())
        moved = join_hot_keys(open_rows, hop, ["ptr"], hot_rows, left).select(
            "entry", "seq", F.col("_ptr").alias("ptr"), F.col("_base").alias("base"),
            F.concat("_tail", F.lit("\\"), "tail").alias("tail"),
        )
        state = materialise(state.where(F.col("ptr").isNull()).unionByName(moved), "jump")
        still = state.where(F.col("ptr").isNotNull()).count()
        if still == left:
            break
        left = still
    path = F.when(F.col("ptr").isNull(), F.concat("base", F.lit("\\"), "tail")).otherwise(F.lit(CYCLE))
    return state.select("entry", "seq", path.alias("_dir"))


def resolve_paths(files: DataFrame, root_entry: int = ROOT_ENTRY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``files`` with ``full_path``.

    The root is ``.``; a missing or re-used parent is ``.\\<orphan>``; a node
    that cannot reach the root is put directly under ``.\\<cycle>``."""
    columns = ["entry", "seq", "parent_entry", "parent_seq", "name"]
    nodes = materialise(files.select(*columns), "nodes")
    paths = _directory_paths(nodes, root_entry, hot_rows)
    lookup = paths.select(
        F.col("entry").alias("parent_entry"), F.col("seq").alias("parent_seq"), "_dir"
    )
    below = nodes.where(F.col("parent_entry").isNotNull() & (F.col("parent_entry") != root_entry))
    named = join_hot_keys(below, lookup, ["parent_entry", "parent_seq"], hot_rows, nodes.count())
    parent = F.coalesce("_dir", F.lit(ORPHAN))
    deep = named.select(*columns, F.concat(parent, F.lit("\\"), "name").alias("full_path"))
    top = nodes.where(F.col("parent_entry") == root_entry).select(
        *columns, F.concat(F.lit(ROOT + "\\"), F.col("name")).alias("full_path")
    )
    bare = nodes.where(F.col("parent_entry").isNull()).select(*columns, F.lit("").alias("full_path"))
    out = top.unionByName(deep).unionByName(bare)
    rest = [c for c in files.columns if c not in columns]
    if not rest:
        return out
    return files.join(out.select("entry", "full_path"), "entry").select(
        *[ref(c) for c in files.columns], "full_path"
    )


def join_journal(journal: DataFrame, files: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Journal records with the file they speak about, matched on entry and
    sequence number; a file changed all the time is a hot key.

    A journal with too few rows for a hot key is joined as it is; a longer one
    is written, since the search for hot keys reads it again."""
    if journal.limit(hot_rows + 1).count() <= hot_rows:
        return journal.join(files, ["entry", "seq"], "left")
    return join_hot_keys(materialise(journal, "journal"), files, ["entry", "seq"], hot_rows)
