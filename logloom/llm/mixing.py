"""Mixing sources to target weights by capped water-filling.

Every source gets a share of a word budget in proportion to its weight.  A
source that would be read more often than ``max_epochs`` is clamped there and
its excess is dealt out again by weight, until no source is above its clamp.
A target then becomes whole repetitions of the source and a fraction; the
fraction is filled with whole documents in a seeded order.

No step gathers a source: the word counts are added up by (source, hash cell),
running sums over groups of cells and then over the cells of one group say in
which of ``CELLS`` cells the fraction ends, and only the documents of that one
cell are put in order.

Defined results: a null text has no words and is taken as it is, 0 words; a
null source is a source of its own, the last; documents without words never
matter to a sum; rows that agree in every way are interchangeable, so which of
them fills a fraction does not show; an empty table gives an empty result;
further columns pass through ``mix`` untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ids import with_position
from .common import WORD, broadcast_below, materialise, query, table

CELLS = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def seeded_order(seed: str, *keys: Column) -> Column:
    """60 hash bits of the row's keys; the top 16 are its cell."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 15), 16, 10).cast("bigint")


def _cell(order: Column) -> Column:
    return F.shiftright(order, 44).cast("int")


@dataclass(frozen=True)
class Level:
    """An unclamped source gets ``left * weight / weights`` words."""

    left: float
    weights: float

    def clamps(self, cap: Column, weight: Column) -> Column:
        return cap * F.lit(self.weights) <= weight * F.lit(self.left)

    def target(self, cap: Column, weight: Column) -> Column:
        share = F.lit(self.left) * weight / F.lit(self.weights) if self.weights else cap
        return F.least(cap, share)


def water_level(sources: DataFrame, budget: float) -> Level:
    """Fill ``sources`` (cap double, weight double) up to ``budget``.

    Each round is one aggregate over the sources; the level only rises, so the
    level itself says which sources are clamped."""
    level, clamped = None, -1
    while True:
        at_cap = level.clamps(F.col("cap"), F.col("weight")) if level else F.lit(False)
        row = sources.agg(
            F.count_if(at_cap).alias("n"),
            F.sum(F.when(at_cap, F.col("cap"))).alias("spent"),
            F.sum(F.when(~at_cap, F.col("weight"))).alias("weights"),
        ).first()
        if row["n"] == clamped:
            return level
        clamped = row["n"]
        level = Level(budget - (row["spent"] or 0.0), row["weights"] or 0.0)
        if not level.weights:
            return level


def plan_mix(
    rows: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, max_epochs: int = 2
) -> DataFrame:
    """One row per source: size, target, whole repetitions, words of the
    fraction, and the cell in which the fraction ends.

    ``rows`` has source, size and order; weights repeat over the sources by
    code point, null last; ``budget`` is a multiple of all words."""
    cells = materialise(
        rows.groupBy("source", _cell(F.col("order")).alias("cell")).agg(F.sum("size").alias("words")), "mix-cells"
    )
    sized = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.col("pos") - 1) % len(weights) + 1).cast("int")
    )
    sources = materialise(
        with_position(sized, [F.col("source").asc_nulls_last()]).select(
            "source", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_epochs)).alias("cap")
        ),
        "mix-sources",
    )
    total = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level = water_level(sources, total * budget)
    target = level.target(F.col("cap"), F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    filled = (
        sources.withColumn("target", target)
        .withColumn("whole", whole.cast("int"))
        .withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    # The first group of cells, and in it the first cell, to reach beyond the
    # fraction, and the words before it: two short windows for each source.
    part = broadcast_below(materialise(filled.select(F.col("source").alias("s"), "part"), "mix-parts"), _bytes("s"))
    mine = F.col("source").eqNullSafe(F.col("s"))
    groups = cells.groupBy("source", _group(F.col("cell")).alias("at")).agg(F.sum("words").alias("words"))
    group_ends = materialise(_first_beyond(groups.join(part, mine).withColumn("before", F.lit(0))), "mix-groups")
    inside = cells.withColumnRenamed("source", "c").join(
        broadcast_below(group_ends, _bytes("source")), F.col("c").eqNullSafe(F.col("source")) & (_group(F.col("cell")) == F.col("end"))
    )
    ends = _first_beyond(inside.select("source", F.col("cell").alias("at"), "words", "part", "before"))
    return materialise(
        filled.join(ends.select(F.col("source").alias("s"), "end", "before"), mine, "left").select(
            F.col("source").alias("plan_source"), "source_size", "target", "whole", "part",
            F.coalesce("before", F.lit(0)).alias("end_before"), F.coalesce("end", F.lit(CELLS)).alias("end_cell"),
        ),
        "mix-plan",
    )


def _bytes(source: str) -> Column:
    """Of a row of a source: its name, of any length, and up to six numbers."""
    return F.coalesce(F.octet_length(F.col(source).cast("string")), F.lit(0)) + 48


def _group(cell: Column) -> Column:
    return F.shiftright(cell, 8)


def _first_beyond(rows: DataFrame) -> DataFrame:
    """(source, part, end, before): of each source the first place ``at`` whose
    words, added to ``before`` and those of the earlier places, exceed the part."""
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("at"))
    beyond = rows.withColumn("upto", upto).where("upto > part")
    first = F.min(F.struct(F.col("at").alias("end"), (F.col("upto") - F.col("words")).alias("before"))).alias("f")
    return beyond.groupBy("source", "part").agg(first).select("source", "part", "f.end", "f.before")


def repetitions(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the plan of their source and ``copies``: how often each is
    read.  A document belongs to the fraction when its middle word does."""
    joined = rows.join(broadcast_below(plan, _bytes("plan_source")), F.col("source").eqNullSafe(F.col("plan_source")))
    cell = _cell(F.col("order"))
    certain = joined.where(cell != F.col("end_cell")).withColumn(
        "copies", F.col("whole") + F.when(cell < F.col("end_cell"), 1).otherwise(0)
    )
    earlier = Window.partitionBy("source").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("end_before") + F.coalesce(F.sum("size").over(earlier), F.lit(0))
    inside = begin * 2 + F.col("size") <= F.col("part") * 2
    edge = joined.where(cell == F.col("end_cell")).withColumn("copies", F.col("whole") + F.when(inside, 1).otherwise(0))
    return certain.unionByName(edge)


def keyed(docs: DataFrame, row: Column, seed: str, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(
        row.alias("row"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        seeded_order(seed, F.col(doc_id)).alias("order"),
    )


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, max_epochs: int = 2,
    seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as it is to be read,
    with the columns of ``docs``.  ``docs`` is read twice: pass a table."""
    rows = keyed(docs, F.struct("*"), seed, doc_id, text, source)
    plan = plan_mix(rows.drop("row"), weights, budget, max_epochs)
    read = repetitions(rows, plan).where("copies > 0")
    return read.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


SQL = r"""
WITH d AS (
    SELECT doc_id, source,
        CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS o
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS DOUBLE) AS n, 2.0 * sum(size) AS cap,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS w
    FROM d GROUP BY source
), r AS (  -- sources from the first that clamps to the last
    SELECT *, sum(n) OVER () * 1.5
            - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
        row_number() OVER (ORDER BY cap / w, source) AS k
    FROM s
), l AS (SELECT CAST(rest AS DOUBLE) AS rest, CAST(weights AS DOUBLE) AS weights FROM r
         WHERE cap * weights > rest * w ORDER BY k LIMIT 1
), t AS (
    SELECT source, n, CAST(least(cap, coalesce((SELECT rest FROM l) * w / (SELECT weights FROM l), cap)) AS DOUBLE) AS target FROM s
), p AS (
    SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole FROM t
), q AS (
    SELECT d.doc_id, d.size, p.n, p.target, p.whole, p.target - p.whole * p.n AS part,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target,
    CAST(size * whole + CASE WHEN 2 * before + size <= 2 * part AND part > 0 THEN size ELSE 0 END AS BIGINT) AS taken
FROM q
"""


@query("op1_mix_sources", SQL)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = materialise(keyed(docs, F.col("doc_id"), "mix", "doc_id", "text", "source"), "mix-rows")
    return repetitions(rows, plan_mix(rows)).select(
        F.col("row").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )
