"""Delimited text files without losing evidence."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import annotate, ref
from ..functions.scalars import stripped
from ..operators.detect import infer_types
from ..operators.ids import file_blocks, file_row_ids
from ..session import broadcast_if_small, materialise
from .schema import clean_names

DELIMITERS = ",\t;|"
CORRUPT = "_corrupt_record"


@dataclass
class Ingested:
    """A written source: ``source_id``, ``rid``, text columns with logical
    types, and how many rows were of another width."""

    frame: DataFrame
    ragged_rows: int


def _head_lines(spark: SparkSession, paths: list[str], count: int = 20) -> list[str]:
    """The first lines that are not blank, however many blank ones stand before
    them."""
    filled = text_lines(spark, paths[:1]).where(stripped(F.ltrim("text", F.lit("\ufeff"))) != "")
    lines = [r["text"].lstrip("\ufeff") for r in filled.limit(count).collect()]
    if not lines:
        raise ValueError("The file is empty")
    return lines


def sniff_delimiter(lines: list[str]) -> str:
    try:
        return csv.Sniffer().sniff("\n".join(lines)[:8192], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return max(DELIMITERS, key=lines[0].count)


def _open_field(sep: str) -> str:
    """Matches a line that, begun outside quotes, ends inside a quoted field.

    A quote opens a field only at its start; two inside are one character."""
    cut = re.escape(sep)
    inside = r'"[^"]*+(?:""[^"]*+)*+'
    return f'^(?:(?:{inside}"[^{cut}]*+|[^"{cut}][^{cut}]*+|){cut})*+{inside}$'


def literal_path(path: str) -> str:
    """A path whose glob characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def text_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every line with its file, split and place."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.regexp_replace("value", "\r$", "").alias("text"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def _carried(rows: DataFrame, scope, order: str) -> DataFrame:
    """``_known``: the quote state before each row as far as the rows of its
    scope tell it, and ``_flips``: how often it has turned since, or since the
    scope began.

    A row leaves the state open or closed whatever it was (``_sets``), turns it
    (``_turns``), or keeps it."""
    earlier = scope.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = scope.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turned = rows.withColumn("_total", F.sum("_turns").over(upto))
    mark = F.when(F.col("_sets").isNotNull(), F.struct(F.col("_sets").alias("to"), F.col("_total").alias("at")))
    seen = turned.withColumn("_mark", F.last(mark, ignorenulls=True).over(earlier)).withColumn(
        "_before", F.coalesce(F.lag("_total").over(scope.orderBy(order)), F.lit(0))
    )
    return seen.withColumn("_known", F.col("_mark.to")).withColumn(
        "_flips", F.col("_before") - F.coalesce("_mark.at", F.lit(0))
    ).drop("_mark", "_total", "_before")


def _owned(lines: DataFrame, sep: str) -> DataFrame:
    """Every line with the place of the record it belongs to.

    Each split is walked by itself, for either state it may begin in; one row
    per split then says which it was.  A ``_cut`` line is a record of its own,
    whatever it leaves open."""
    opens = F.col("text").rlike(_open_field(sep))
    rest = F.regexp_extract("text", r'^[^"]*+(?:""[^"]*+)*+"(.*)$', 1)
    closes = F.col("text").rlike(r'^[^"]*+(?:""[^"]*+)*+"(?!")')
    reopens = F.concat(F.lit("x"), rest).rlike(_open_field(sep))
    from_out, from_in = opens & ~F.col("_cut"), (~closes | reopens) & ~F.col("_cut")
    judged = lines.withColumn("_sets", F.when(from_out == from_in, from_out)).withColumn(
        "_turns", F.when(from_out & ~from_in, 1).otherwise(0)
    )
    block = Window.partitionBy("_file", "_block")
    walked = materialise(_carried(judged, block, "_seq"), "walked")
    last = F.max_by(F.struct("_sets", "_turns", "_known", "_flips"), "_seq").alias("l")
    ends = walked.groupBy("_file", "_block").agg(last).select("_file", "_block", "l.*")
    odd = F.col("_flips") % 2 == 1
    # What a whole split does to the state is what its last line leaves.
    left = F.coalesce("_sets", F.when(F.col("_known").isNotNull(), (F.col("_known") != odd) != (F.col("_turns") == 1)))
    splits = ends.select(
        "_file", "_block", left.alias("_sets"), F.when(left.isNull(), (F.col("_flips") + F.col("_turns")) % 2).otherwise(0).alias("_turns")
    )
    entered = _carried(splits, Window.partitionBy("_file"), "_block").select(
        "_file", "_block", (F.coalesce("_known", F.lit(False)) != odd).alias("_entry")
    )
    inside = walked.join(broadcast_if_small(materialise(entered, "entered")), ["_file", "_block"]).withColumn(
        "_inside", F.coalesce("_known", "_entry") != odd
    )
    place = F.struct(F.col("_block").alias("block"), F.col("_seq").alias("seq"))
    started = inside.withColumn("_first", F.last(F.when(~F.col("_inside"), place), ignorenulls=True).over(block.orderBy("_seq")))
    starts = started.groupBy("_file", "_block").agg(F.max(F.when(~F.col("_inside"), place)).alias("_own")).withColumn(
        "_carry", F.last("_own", ignorenulls=True).over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    )
    owned = started.join(broadcast_if_small(materialise(starts.select("_file", "_block", "_carry"), "starts")), ["_file", "_block"]).select(
        "text", "_file", "_cut", place.alias("at"), F.coalesce("_first", "_carry").alias("record"),
        # A line is a record of its own when it begins and ends outside quotes.
        (~F.col("_inside") & ~F.coalesce("_sets", F.col("_turns") == 1)).alias("whole"),
    )
    return materialise(owned, "owned")


def _stitched(lines: DataFrame, sep: str, max_lines: int) -> DataFrame:
    """Records of lines whose quoted fields hold line breaks; only the lines of
    records that span several are gathered, by record.

    A quote that is not closed within ``max_lines`` lines was never meant to be:
    its line is cut off as a record of its own, and the walk begins again behind
    it.  A round cuts the first such line of every file."""
    lines = lines.withColumn("_cut", F.lit(False))
    while True:
        owned = _owned(lines, sep)
        sizes = owned.where("NOT whole").groupBy("_file", "record").agg(F.count(F.lit(1)).alias("n"))
        open_ = materialise(sizes.where(F.col("n") > max_lines).groupBy("_file").agg(F.min("record").alias("_at")), "open-quotes")
        if open_.isEmpty():
            break
        here = (F.col("_block") == F.col("_at.block")) & (F.col("_seq") == F.col("_at.seq"))
        lines = lines.join(broadcast_if_small(open_), "_file", "left").withColumn("_cut", F.col("_cut") | F.coalesce(here, F.lit(False))).drop("_at")
    block = Window.partitionBy("_file", "_block")
    dense = block.orderBy("_seq")
    single = owned.where("whole").select("text", "_cut", "_file", F.col("at.block").alias("_block"), F.col("at.seq").alias("_seq"))
    parts = owned.where("NOT whole").groupBy("_file", "record").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"))
    joined = parts.select(
        F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), F.lit(False).alias("_cut"), "_file",
        F.col("record.block").alias("_block"), F.col("record.seq").alias("_seq"),
    )
    return single.unionByName(joined).withColumn("_seq", F.row_number().over(dense).cast("bigint"))


MAX_LINES = 10_000  # of a record, unless a caller knows better


def records(spark: SparkSession, paths: list[str], sep: str, max_lines: int = MAX_LINES) -> DataFrame:
    """``(text, _cut, _file, _block, _seq)``: one row per record, line breaks
    inside quotes included.  Lines are records unless some line leaves a quote
    open, which one scan tells; ``_cut`` marks a line whose quote is not closed
    within ``max_lines`` lines."""
    lines = text_lines(spark, paths)
    opened = lines.where(F.contains("text", F.lit('"')) & F.col("text").rlike(_open_field(sep)))
    return lines.withColumn("_cut", F.lit(False)) if opened.isEmpty() else _stitched(materialise(lines, "lines"), sep, max_lines)


def parse_delimited(
    spark: SparkSession, paths: list[str], names: list[str], delimiter: str, has_header: bool = True, max_lines: int = MAX_LINES,
) -> DataFrame:
    """A written table: text columns, ``_ragged``, ``_file``, ``_block`` and ``_seq``.

    A blank line is a ragged row of empty cells, and a line whose quote is not
    closed within ``max_lines`` lines a ragged row.  With a header, each file's
    first line that is not blank is left out, and the blank lines before it."""
    rows = records(spark, paths, delimiter, max_lines).withColumn("text", F.ltrim("text", F.lit("\ufeff")))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField(CORRUPT, T.StringType())])
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    blank = stripped(F.col("text")) == ""
    parsed = rows.withColumn("_cells", F.when(~blank, F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), options)))
    cells = [F.coalesce(F.col(f"_cells.c{i}"), F.lit("")) for i in range(len(names))]
    cells[0] = F.when(blank, F.col("text")).otherwise(cells[0])
    cells = [c.alias(n) for c, n in zip(cells, names)]
    ragged = F.col("_cut") | blank & ((F.col("text") == "") | F.lit(len(names) > 1)) | F.coalesce(F.col(f"_cells.{CORRUPT}").isNotNull(), F.lit(False))
    written = materialise(
        parsed.select(*cells, ragged.alias("_ragged"), "_file", "_block", "_seq", blank.alias("_blank")), "parsed"
    )
    if not has_header:
        return written.drop("_blank")
    place = F.struct(F.col("_block").alias("block"), F.col("_seq").alias("seq"))
    heads = written.where("NOT _blank").groupBy("_file").agg(F.min(place).alias("_head"))
    headed = written.join(broadcast_if_small(materialise(heads, "heads")), "_file")
    return headed.where(place > F.col("_head")).select(*[ref(c) for c in written.columns if c != "_blank"])


def typed_source(
    df: DataFrame, source_id: int, sample: DataFrame, column_types: dict[str, str] | None = None
) -> DataFrame:
    """Key columns first, logical types inferred on ``sample`` (all rows, or
    some); explicit types win."""
    data = [c for c in df.columns if c not in ("source_id", "rid")]
    keyed = df.select(F.lit(source_id).cast("int").alias("source_id"), "rid", *[ref(c) for c in data])
    types = {r["column"]: r["type"] for r in infer_types(sample.select(*[ref(c) for c in data]), None).collect()}
    types.update(column_types or {})
    return annotate(keyed, types)


def read_delimited(
    spark: SparkSession, path: str | list[str], delimiter: str | None = None, has_header: bool = True,
    column_types: dict[str, str] | None = None, source_id: int = 1, max_lines: int = MAX_LINES,
) -> Ingested:
    """One source from one file (or several parts of one layout).

    Everything stays text; short rows are padded and long rows cut, blank lines
    are rows without cells, and all three are counted.  Quoted cells may hold
    line breaks, up to ``max_lines`` lines; a quote left open for longer spoils
    its own line only, which is counted too.  The parse is written once; row ids, types and the count come
    from the written table."""
    paths = [path] if isinstance(path, str) else list(path)
    lines = _head_lines(spark, paths)
    delimiter = delimiter or sniff_delimiter(lines)
    head = next(csv.reader(lines, delimiter=delimiter))
    names = clean_names(head if has_header else [None] * len(head))
    parsed = parse_delimited(spark, paths, names, delimiter, has_header, max_lines)
    blocks = file_blocks(parsed, per_file=False)
    numbered = file_row_ids(parsed, blocks).select("rid", *[ref(n) for n in names])
    frame = typed_source(numbered, source_id, numbered, column_types)
    return Ingested(frame, blocks.agg(F.coalesce(F.sum("_bad"), F.lit(0))).head()[0])
