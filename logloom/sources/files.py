"""Which files below a folder would be read, and why the others would not."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grouping import top_with_flag

# Extensions read by default, the ones read as JSON, and below the
# reasons a file is left out.
IMPORT_EXTENSIONS = [".csv", ".tsv", ".txt", ".psv", ".json", ".jsonl", ".ndjson"]
JSON_EXTENSIONS = [".json", ".jsonl", ".ndjson"]


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored, case-folded regular expression."""
    out, i, pattern = "", 0, pattern.strip().lower()
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif close > 0:
            body = pattern[i + 1: close].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = close
        else:
            out += re.escape(ch)
        i += 1
    return f"(?s)^{out}$"


def _matches(pattern: str, name: Column, relative: Column) -> Column:
    """A pattern with ``/`` looks at the path below the root, one without at
    the bare name."""
    return F.lower(relative if "/" in pattern else name).rlike(glob_regex(pattern))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def scan_files(
    spark: SparkSession, root: str, recursive: bool = True, extensions: list[str] | None = None,
    include: list[str] | None = None, exclude: list[str] | None = None,
    filename_patterns: list[str] | None = None, already: DataFrame | None = None, limit: int | None = None,
) -> DataFrame:
    """``(path, rel_path, size_bytes, status, reason, kind, already_imported)``.

    Contents are never read: the scan only lists.  ``already`` holds a ``path``
    column of files imported before.  With a limit the first files come with
    ``truncated``."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
        .select("path", F.col("length").alias("size_bytes"))
    )
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.regexp_replace("path", "^.*?" + re.escape(base) + "/", "")
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))
    wanted = [(e if e.startswith(".") else "." + e).lower() for e in extensions or IMPORT_EXTENSIONS]
    includes, excludes, by_name = (
        [p for p in patterns or [] if p.strip()] for patterns in (include, exclude, filename_patterns)
    )
    known = extension.isin(wanted) | _any([F.lower(name).rlike(glob_regex(p)) for p in by_name])
    reason = F.when(~known, F.lit("extension"))
    if includes:
        reason = reason.when(~_any([_matches(p, name, relative) for p in includes]), "no include pattern matched")
    for pattern in excludes:
        reason = reason.when(_matches(pattern, name, relative), f"excluded by pattern: {pattern}")
    kind = F.when(extension.isin(JSON_EXTENSIONS), "json").when(extension.isin(IMPORT_EXTENSIONS), "csv").otherwise("plugin")
    judged = listed.select("path", relative.alias("rel_path"), "size_bytes", reason.alias("reason"), kind.alias("kind"))
    if already is not None:
        seen = already.select(F.regexp_replace("path", "^file:/+", "/").alias("_known"), F.lit(True).alias("_seen"))
        judged = judged.join(
            seen.dropDuplicates(), F.regexp_replace("path", "^file:/+", "/") == F.col("_known"), "left"
        )
    else:
        judged = judged.withColumn("_seen", F.lit(False))
    matched = F.col("reason").isNull()
    found = judged.select(
        "path", "rel_path", "size_bytes",
        F.when(matched, "matched").otherwise("excluded").alias("status"), "reason",
        F.when(matched, F.col("kind")).alias("kind"),
        (matched & F.coalesce("_seen", F.lit(False))).alias("already_imported"),
    )
    order = [F.col("status"), F.col("rel_path")]
    return found.orderBy(*order) if limit is None else top_with_flag(found, order, limit)
