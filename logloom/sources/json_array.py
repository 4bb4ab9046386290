"""The items of one large JSON array, read in many tasks.

The text reader cuts a file at every ``}``, wherever its splits fall; so a piece
may begin inside a string and at any depth.  Each piece says what it does to
both for either quote state it may begin in, each split adds its pieces up, and
one row per split then tells the state and the depth that the split begins with.
With these known, items end where a ``}`` leads back into the array; inside a
split they are put together where they lie, and only the at most two that cross
its borders are stitched from fragments.  Texts move once, by split.

An array without any object has no ``}`` to be cut at and is one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise

BLANK = " \t\r\n﻿"
SPLIT = ["_file", "_block"]


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "}").text(paths).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"),
    )


def split_arrays(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """Pieces of the files that begin with ``[``, or None without such files,
    and the names of the other files."""
    pieces = _pieces(spark, paths)
    heads = pieces.where("_block = 0").groupBy("_file").agg(F.min_by("text", "_seq").alias("head"))
    rows = heads.select("_file", F.startswith(F.btrim("head", F.lit(BLANK)), F.lit("[")).alias("a")).collect()
    others = [r["_file"] for r in rows if not r["a"]]
    if len(others) == len(rows):
        return None, others
    return (pieces.where(~F.col("_file").isin(others)) if others else pieces), others


def _rise(text: Column) -> Column:
    """Brackets opened less brackets closed; a piece holds no ``}``."""
    return F.length(F.translate(text, "]", "")) - F.length(F.translate(text, "{[", ""))


def _effects(pieces: DataFrame) -> DataFrame:
    """``flips``: whether a piece turns the quote state; ``out`` and ``in``: what
    it and the ``}`` behind it add to the depth, begun outside or inside quotes."""
    bare = F.split(F.regexp_replace("text", r"(?s)\\.", ""), '"', -1)
    marked = pieces.withColumn("_q", bare).withColumn("flips", (F.size("_q") - 1) % 2)
    even, odd = (F.array_join(F.filter("_q", keep), "") for keep in (lambda _, i: i % 2 == 0, lambda _, i: i % 2 == 1))
    return marked.withColumn("out", _rise(even) - F.when(F.col("flips") == 0, 1).otherwise(0)).withColumn(
        "in", _rise(odd) - F.when(F.col("flips") == 1, 1).otherwise(0)
    ).drop("_q")


def _before(column: Column, scope) -> Column:
    return F.coalesce(F.sum(column).over(scope.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _split_starts(effects: DataFrame) -> DataFrame:
    """``(_file, _block, inside, depth)`` at the start of every split."""
    scope = Window.partitionBy(*SPLIT).orderBy("_seq")
    turned = effects.select(*SPLIT, "_seq", "flips", "out", "in").withColumn("odd", _before(F.col("flips"), scope) % 2)
    same, other = F.col("odd") == 0, F.col("odd") == 1
    splits = turned.groupBy(*SPLIT).agg(
        (F.sum("flips") % 2).alias("flips"),
        F.sum(F.when(same, F.col("out")).otherwise(F.col("in"))).alias("out"),
        F.sum(F.when(other, F.col("out")).otherwise(F.col("in"))).alias("in"),
    )
    files = Window.partitionBy("_file").orderBy("_block")
    entered = splits.withColumn("inside", _before(F.col("flips"), files) % 2)
    rise = F.when(F.col("inside") == 0, F.col("out")).otherwise(F.col("in"))
    return materialise(
        entered.withColumn("rise", rise).select(
            *SPLIT, "inside", _before(F.col("rise"), files).alias("depth"),
            # What the file comes to: the last piece has no } behind it.
            (F.sum("rise").over(Window.partitionBy("_file")) + 1).alias("left"),
            (F.sum("flips").over(Window.partitionBy("_file")) % 2).alias("open"),
        ), "array-splits",
    )


def array_items(pieces: DataFrame) -> DataFrame:
    """``(text, _file, _block, _seq)``: the items of the files' top-level arrays
    in order, ``_seq`` dense from 1 in each split that an item begins in.

    Raises where an array does not close."""
    effects = _effects(pieces)
    starts = _split_starts(effects)
    broken = starts.where("left <> 0 OR open <> 0").select("_file").distinct().limit(1).collect()
    if broken:
        raise ValueError(f"{broken[0]['_file']} is no complete JSON array")
    known = effects.join(broadcast_if_small(starts.drop("left", "open")), SPLIT)
    scope = Window.partitionBy(*SPLIT).orderBy("_seq")
    inside = (F.col("inside") + _before(F.col("flips"), scope)) % 2
    placed = known.withColumn("_in", inside).withColumn("_rise", F.when(F.col("_in") == 0, F.col("out")).otherwise(F.col("in")))
    after = F.col("depth") + F.sum("_rise").over(scope.rowsBetween(Window.unboundedPreceding, 0))
    # The file's last piece leads out of the array, to a depth below the items'.
    ends = ((F.col("_in") + F.col("flips")) % 2 == 0) & (F.col("_after") <= 1)
    marked = placed.withColumn("_after", after).withColumn("_end", ends.cast("int")).withColumn("_group", _before(F.col("_end"), scope))
    groups = marked.groupBy(*SPLIT, "_group").agg(
        F.array_sort(F.collect_list(F.struct("_seq", "text"))).alias("p"), F.max("_end").alias("_end"),
        F.first("inside").alias("inside"), F.first("depth").alias("depth"), (F.min("_after") < 1).alias("_final"),
    )
    joined = F.array_join(F.transform("p", lambda x: x["text"]), "}")
    # The first group of a split is a fragment, unless the split begins between items.
    begins = (F.col("_group") > 0) | (F.col("_block") == 0) | ((F.col("inside") == 0) & (F.col("depth") == 1))
    groups = groups.select(
        *SPLIT, "_group", joined.alias("text"), begins.alias("_begins"), (F.col("_end") == 1).alias("_ends"), "_final",
    )
    # Whole groups are numbered by split, where they already lie.
    items = materialise(_items(groups.where("_begins AND _ends")), "array-items")
    order = Window.partitionBy(*SPLIT).orderBy("_group", "_place")
    whole = items.withColumn("_seq", F.row_number().over(order).cast("bigint"))
    fragments = materialise(groups.where("NOT (_begins AND _ends)"), "array-fragments")
    chain = F.sum(F.col("_begins").cast("int")).over(Window.partitionBy("_file").orderBy("_block", "_group"))
    stitched = fragments.withColumn("_chain", chain).groupBy("_file", "_chain").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_group", "text", "_final"))).alias("p")
    ).select(
        "_file", F.col("p")[0]["_block"].alias("_block"), F.col("p")[0]["_group"].alias("_group"),
        F.array_join(F.transform("p", lambda x: x["text"]), "}").alias("text"), F.element_at("p", -1)["_final"].alias("_final"),
    )
    counted = items.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("_n"))
    # An item that crosses a border is the last to begin in its split.
    crossing = _items(stitched).join(counted, SPLIT, "left").withColumn(
        "_seq", F.coalesce("_n", F.lit(0)) + F.col("_place") + 1
    )
    columns = ["text", *SPLIT, "_seq"]
    return whole.select(*columns).unionByName(crossing.select(*columns))


def _items(groups: DataFrame) -> DataFrame:
    """The items of groups of pieces, ``_place`` from 0 in each group: what
    stands before an object, and the object."""
    first = (F.col("_block") == 0) & (F.col("_group") == 0)
    body = F.regexp_replace("text", F.when(first, F.lit(f"^[{BLANK}]*\\[")).otherwise(F.lit(f"^[{BLANK}]*,")), F.lit(""))
    # Only the file's last group has no } behind it, and ends with the array.
    body = F.when(F.col("_final"), F.regexp_replace(body, f"\\][{BLANK}]*$", "")).otherwise(F.concat(body, F.lit("}")))
    trimmed = groups.withColumn("_body", F.btrim(body, F.lit(BLANK)))
    array = F.concat(F.lit("["), F.col("_body"), F.lit("]"))
    raw, kinds = (F.from_json(array, f"array<{kind}>", {"mode": "FAILFAST"}) for kind in ("string", "variant"))

    def item(text: Column, kind: Column) -> Column:
        """Numbers and containers as they stand; strings keep their quotes."""
        json = F.to_json(kind)
        return F.when(text.isNull(), "null").when(F.startswith(json, F.lit('"')), json).otherwise(text)

    one = F.startswith("_body", F.lit("{"))
    found = F.when(F.col("_body") == "", F.array().cast("array<string>")).when(one, F.array("_body")).otherwise(F.zip_with(raw, kinds, item))
    return trimmed.select(*SPLIT, "_group", F.posexplode(found).alias("_place", "text"))
