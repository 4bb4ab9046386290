"""Tags and notes as keyed tables, and exact, reversible changes to them.

``tags(source_id, rid, tag_id)`` is a set; ``notes(source_id, rid, note)`` has
one row per row; ``tag_defs(id, name, color, hotkey)`` names may repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, datetime_columns, ref
from ..functions.scalars import stripped, ts_normalize
from ..session import broadcast_if_small, materialise
from .predicates import exclude_rows

TAG_KEYS = [*KEYS, "tag_id"]


def having_tags(df: DataFrame, tags: DataFrame, tag_ids: list[int] | None = None) -> DataFrame:
    chosen = tags.where(F.col("tag_id").isin(tag_ids)) if tag_ids else tags
    return df.join(chosen.select(*KEYS), KEYS, "left_semi")


def without_tags(df: DataFrame, tags: DataFrame) -> DataFrame:
    return df.join(tags.select(*KEYS), KEYS, "left_anti")


def explode_tags(df: DataFrame, tags: DataFrame) -> DataFrame:
    """One row per row and tag."""
    return df.join(tags.select(*TAG_KEYS), KEYS)


def filter_tagged(df: DataFrame, tags: DataFrame, wanted: list) -> DataFrame:
    """``["__any__"]``, ``["__none__"]`` or a list of tag ids."""
    if wanted == ["__any__"]:
        return having_tags(df, tags)
    if wanted == ["__none__"]:
        return without_tags(df, tags)
    ids = [int(t) for t in wanted if str(t).isdigit()]
    return having_tags(df, tags, ids) if ids else df


def tag_sets(tags: DataFrame) -> DataFrame:
    """The sorted tag ids of each tagged row; a row has few tags, so the
    collected list is bounded by the tag definitions."""
    return tags.groupBy(*KEYS).agg(F.sort_array(F.collect_set("tag_id")).alias("tag_ids"))


def attach_annotations(df: DataFrame, tags: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Every row with its tag ids (empty when untagged) and its note."""
    out = df.join(tag_sets(tags), KEYS, "left")
    out = out.withColumn("tag_ids", F.coalesce("tag_ids", F.array().cast("array<int>")))
    if notes is not None:
        out = out.join(notes.select(*KEYS, "note"), KEYS, "left")
    return out


# ------------------------------------------------------------------ changes

def distinct_rows(df: DataFrame) -> DataFrame:
    return df.select(*KEYS).dropDuplicates()


def tag_delta(target: DataFrame, tags: DataFrame, tag_id: int, on: bool = True) -> DataFrame:
    """The assignments an apply (or remove) would really change."""
    held = tags.where(F.col("tag_id") == tag_id).select(*KEYS)
    changed = distinct_rows(target).join(held, KEYS, "left_anti" if on else "left_semi")
    return changed.withColumn("tag_id", F.lit(tag_id).cast(tags.schema["tag_id"].dataType))


def apply_delta(tags: DataFrame, delta: DataFrame, on: bool = True, exact: bool = False) -> DataFrame:
    """``exact``: the delta comes from ``tag_delta`` on these tags, so it shares
    no row with them and nothing has to be shuffled."""
    delta = delta.select(*TAG_KEYS)
    if on:
        united = tags.select(*TAG_KEYS).union(delta)
        return united if exact else united.dropDuplicates()
    return tags.join(delta, TAG_KEYS, "left_anti")


def revert_delta(tags: DataFrame, delta: DataFrame, on: bool = True) -> DataFrame:
    """The exact inverse of ``apply_delta`` for a delta made by ``tag_delta``."""
    return apply_delta(tags, delta, not on)


@dataclass
class TagChange:
    target: DataFrame
    delta: DataFrame
    tags: DataFrame

    def summary(self) -> DataFrame:
        """One row ``(affected, changed)``."""
        affected = self.target.agg(F.count(F.lit(1)).alias("affected"))
        changed = self.delta.agg(F.count(F.lit(1)).alias("changed"))
        one = F.lit(1).alias("_one")
        return affected.select("*", one).join(changed.select("*", one), "_one").drop("_one")


def tag_view(
    df: DataFrame, tags: DataFrame, tag_id: int, on: bool = True, exclude: list[tuple[int, int]] | None = None
) -> TagChange:
    """Tag or untag every row of a view but an explicit list."""
    target = distinct_rows(exclude_rows(df, exclude or []))
    delta = tag_delta(target, tags, tag_id, on)
    return TagChange(target, delta, apply_delta(tags, delta, on, exact=True))


def set_tags(pairs: DataFrame, tags: DataFrame, tag_id: int, on: bool = True) -> TagChange:
    """Tag or untag explicit rows, possibly of several sources."""
    return tag_view(pairs, tags, tag_id, on)


def last_notes(changes: DataFrame, order: str | None = None) -> DataFrame:
    """One note per row, as ``_new``: of several the one with the largest
    ``order``; of those, or without an order, the greatest text."""
    text = F.coalesce("note", F.lit(""))
    if order is None:
        return changes.groupBy(*KEYS).agg(F.max(text).alias("_new"))
    best = F.max(F.struct(ref(order).alias("_at"), text.alias("_new"))).alias("_best")
    return changes.groupBy(*KEYS).agg(best).select(*KEYS, "_best._new")


def upsert_notes(notes: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Replace notes; a blank note deletes.  Several changes of a row are one:
    see ``last_notes``."""
    new = last_notes(changes, order)
    merged = notes.select(*KEYS, "note").join(new, KEYS, "full")
    note = F.coalesce("_new", "note")
    return merged.where(stripped(note) != "").select(*KEYS, note.alias("note"))


def drop_tag(tags: DataFrame, tag_defs: DataFrame, tag_id: int) -> tuple[DataFrame, DataFrame]:
    """Assignments and definitions without one tag."""
    return tags.where(F.col("tag_id") != tag_id), tag_defs.where(F.col("id") != tag_id)


def remove_source(tables: dict[str, DataFrame], source_id: int) -> dict[str, DataFrame]:
    """Every annotation table without one source's rows."""
    return {
        name: table.where(F.col("source_id") != source_id) if "source_id" in table.columns else table
        for name, table in tables.items()
    }


# ------------------------------------------------------------------ reports

def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag_id").agg(F.count(F.lit(1)).alias("count"))


def tag_counts_in_view(df: DataFrame, tags: DataFrame) -> DataFrame:
    """Tagged rows of a view per tag."""
    return tag_counts(tags.join(df.select(*KEYS), KEYS, "left_semi"))


def tag_time_bounds(
    df: DataFrame, tags: DataFrame, tag_ids: list[int] | None = None, column: str | None = None
) -> DataFrame:
    """One row ``(start, end)``: the time span of the tagged rows."""
    every = datetime_columns(df)
    chosen = [column] if column in every else every
    if not chosen:
        return df.sparkSession.createDataFrame([(None, None)], "start string, end string")
    # Only the tagged rows' times are read out.
    rows = having_tags(df, tags, tag_ids)
    times = [ts_normalize(rows, c) for c in chosen]
    low = times[0] if len(times) == 1 else F.least(*times)
    high = times[0] if len(times) == 1 else F.greatest(*times)
    rows = rows.select(low.alias("_low"), high.alias("_high"))
    return rows.agg(F.min("_low").alias("start"), F.max("_high").alias("end"))


def source_stats(sources: DataFrame, tags: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows, distinct tagged rows and notes per source; ``sources`` holds the
    row keys of all sources."""
    rows = sources.groupBy("source_id").agg(F.count(F.lit(1)).alias("row_count"))
    tagged = tags.select(*KEYS).dropDuplicates().groupBy("source_id").agg(F.count(F.lit(1)).alias("tagged_row_count"))
    noted = notes.groupBy("source_id").agg(F.count(F.lit(1)).alias("note_count"))
    return (
        rows.join(tagged, "source_id", "left").join(noted, "source_id", "left")
        .na.fill(0, ["tagged_row_count", "note_count"])
    )


# ------------------------------------------------------------ session merge

@dataclass
class Annotations:
    tag_defs: DataFrame
    tags: DataFrame
    notes: DataFrame


def map_tag_ids(local_defs: DataFrame, incoming_defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(all definitions, incoming id -> local id)``, matched by name without
    case.  Definitions are made by people: a short table."""
    key = F.lower(F.col("name")).alias("_key")
    known = local_defs.groupBy(key).agg(F.max("id").alias("_local"))
    named = incoming_defs.withColumn("_key", F.lower(F.col("name")))
    fresh = (
        named.join(known.select("_key"), "_key", "left_anti")
        .groupBy("_key")
        .agg(F.min(F.struct("id", "name", "color", "hotkey")).alias("d"))
    )
    top = local_defs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"), F.lit(1).alias("_one"))
    numbered = (
        fresh.withColumn("_nth", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("d.id")))
        .withColumn("_one", F.lit(1))
        .join(top, "_one")
        .withColumn("_local", (F.col("_top") + F.col("_nth")).cast(local_defs.schema["id"].dataType))
    )
    created = numbered.select(F.col("_local").alias("id"), "d.name", "d.color", "d.hotkey")
    every = known.unionByName(numbered.select("_key", "_local"))
    mapping = named.join(every, "_key").select(F.col("id").alias("tag_id"), "_local")
    return local_defs.select("id", "name", "color", "hotkey").unionByName(created), mapping


def merge_annotations(
    local: Annotations, incoming: Annotations, merge: bool = True, order: str | None = None
) -> Annotations:
    """Import a session: tags unite, an incoming note wins (of several for a
    row, that of ``last_notes``).  ``merge=False`` first clears the sources the
    session speaks about."""
    defs, mapping = map_tag_ids(local.tag_defs, incoming.tag_defs)
    # One tag may hold most assignments: broadcast the short mapping if it is short.
    mapping = broadcast_if_small(materialise(mapping, "tag-map"))
    moved = incoming.tags.join(mapping, "tag_id", "left").select(
        *KEYS, F.coalesce("_local", "tag_id").alias("tag_id")
    )
    tags, notes = local.tags, local.notes
    if not merge:
        spoken = incoming.tags.select("source_id").union(incoming.notes.select("source_id")).distinct()
        named = [r["source_id"] for r in spoken.collect()]  # one per source
        tags = tags.where(~F.col("source_id").isin(named))
        notes = notes.where(~F.col("source_id").isin(named))
    united = tags.select(*TAG_KEYS).union(moved).dropDuplicates()
    merged = notes.join(last_notes(incoming.notes, order), KEYS, "full").select(*KEYS, F.coalesce("_new", "note").alias("note"))
    return Annotations(defs, united, merged)


def session_warnings(recorded: str | None, current: str | None) -> list[str]:
    """A fingerprint that differs means the row numbers may not line up."""
    if recorded and recorded != current:
        return ["The session belongs to other content; its row ids may point elsewhere."]
    return []


def reattach_sources(session_sources: DataFrame, local_sources: DataFrame) -> DataFrame:
    """Match a whole case's sources by fingerprint: ``(recorded_id, source_id)``,
    NULL where no open source has the same content."""
    recorded = session_sources.select(F.col("source_id").alias("recorded_id"), "fingerprint")
    current = local_sources.groupBy("fingerprint").agg(F.max("source_id").alias("source_id"))
    return recorded.join(current, "fingerprint", "left").select("recorded_id", "source_id")


@dataclass
class CaseImport:
    annotations: Annotations
    unmatched: DataFrame  # recorded_id, fingerprint of sources that are not open


def import_case(
    local: Annotations, incoming: Annotations, session_sources: DataFrame, local_sources: DataFrame,
    merge: bool = True, order: str | None = None,
) -> CaseImport:
    """Import a whole case: its sources are matched to the open ones by
    fingerprint, its rows get their ids, then its annotations are merged.
    Annotations of a source that is not open stay out and are reported."""
    matched = reattach_sources(session_sources, local_sources)
    known = broadcast_if_small(materialise(
        matched.where("source_id IS NOT NULL").select("recorded_id", F.col("source_id").alias("_local")), "case-sources"
    ))

    def moved(table: DataFrame) -> DataFrame:
        rows = table.withColumnRenamed("source_id", "recorded_id").join(known, "recorded_id")
        return rows.withColumn("source_id", F.col("_local").cast(table.schema["source_id"].dataType)).select(*table.columns)

    merged = merge_annotations(local, Annotations(incoming.tag_defs, moved(incoming.tags), moved(incoming.notes)), merge, order)
    unmatched = matched.where("source_id IS NULL").select("recorded_id").join(
        session_sources.withColumnRenamed("source_id", "recorded_id"), "recorded_id"
    )
    return CaseImport(merged, unmatched.select("recorded_id", "fingerprint"))
