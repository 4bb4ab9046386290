"""Cross-source union and the timeline of tagged rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KEYS, as_text, base_columns, data_fields, datetime_columns, is_derived, ref
from ..functions.scalars import ts_normalize
from ..session import broadcast_if_small, materialise
from .annotations import tag_sets
from .ids import OrderedRows, number_sorted


@dataclass
class Source:
    id: int
    name: str
    frame: DataFrame  # with rid; source_id is set from id

    def keyed(self) -> DataFrame:
        return self.frame.withColumn("source_id", F.lit(self.id).cast("int"))


def column_signature(df: DataFrame) -> tuple[str, ...]:
    """Order- and case-independent identity of a column-name set."""
    return tuple(sorted(c.strip().lower() for c in base_columns(df)))


def merge_sources(sources: list[Source]) -> DataFrame:
    """Union of at least two sources with equal column names; rows keep their
    source id, derived columns stay behind."""
    if len(sources) < 2:
        raise ValueError("A merge needs at least two sources")
    if len({column_signature(s.frame) for s in sources}) != 1:
        raise ValueError("Sources have different columns")
    first = base_columns(sources[0].frame)
    frames = []
    for source in sources:
        by_name = {c.strip().lower(): c for c in base_columns(source.frame)}
        keyed = source.keyed()
        frames.append(
            keyed.select(*KEYS, *[ref(by_name[c.strip().lower()]).alias(c) for c in first])
        )
    return reduce(DataFrame.unionByName, frames)


def _entry(source: Source, config: dict, marked: DataFrame) -> DataFrame:
    """The marked rows of one source; times and texts are made of those only."""
    df = source.keyed()
    names = [f.name for f in data_fields(df)]
    moments = datetime_columns(df)
    ts_column = config.get("timestamp_column")
    if ts_column not in names:
        ts_column = moments[0] if moments else None
    if ts_column is None:
        ts = F.lit(None).cast("string")
    elif is_derived(df.schema[ts_column]):
        ts = as_text(df, ts_column)  # already canonical, fraction included
    else:
        ts = ts_normalize(df, ts_column)
    body = [c for c in config.get("body_columns") or [] if c in names] or names
    return df.join(marked, KEYS).select(
        *KEYS,
        ts.alias("ts"),
        F.concat_ws(" | ", *[F.coalesce(as_text(df, c), F.lit("")) for c in body]).alias("body"),
        F.lit(config.get("type_label") or source.name).alias("type_label"),
        F.lit(source.name).alias("source_name"),
        "tag_ids",
    )


def timeline(
    sources: list[Source], tags: DataFrame, configs: dict[int, dict] | None = None,
    tag_ids: list[int] | None = None,
) -> DataFrame:
    """Every tagged row of every source with time, text, labels and all its
    tags.  The annotation side is reduced to one row per tagged row first."""
    marked = tag_sets(tags)
    if tag_ids:
        marked = marked.where(F.arrays_overlap("tag_ids", F.array(*[F.lit(int(t)) for t in tag_ids])))
    # Findings are few beside the evidence: a short list goes to the rows, so the
    # sources are not shuffled; a long one joins by shuffle.
    marked = broadcast_if_small(materialise(marked, "marked"))
    return reduce(DataFrame.unionByName, [_entry(s, (configs or {}).get(s.id, {}), marked) for s in sources])


def timeline_order(rows: DataFrame) -> DataFrame:
    """Time order, rows without a time last."""
    return rows.orderBy(F.col("ts").asc_nulls_last(), *KEYS)


def timeline_view(rows: DataFrame) -> OrderedRows:
    """The ordered timeline with dense positions, written once for paging."""
    return number_sorted(timeline_order(rows), "timeline")
