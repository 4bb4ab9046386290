"""Quality rules: a table of thresholds compiled into one Spark projection.

A ``Rule`` bounds a percentage of two counts of a text, or one count by itself.
``measures`` turns a text into a struct of counts, ``verdict`` a rule table into
conditions on it; both are column expressions, so a table of documents is judged
in the scan's own stage, without a shuffle and without user functions.

Words are runs of other than ASCII white space.  Repetition inside a text is
found by hashes of 8-word windows, put together in three doubling steps (pairs,
fours, eights); a text whose window hashes are all distinct ends there, any
other sorts its windows, so the work is ``n log n`` in a text's words whatever
it repeats.  Windows of one text are told apart by 64 bits.

Defined results: a null text is an empty one; a text without words has zero
counts, and every percentage of nothing is zero; repeated rows are judged alike;
a very long text is judged as a whole, within the memory of its words; an empty
table gives an empty result; ``judge`` adds one struct column under a name of
the caller's choice, and refuses a name that the table already has.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bind
from .common import query, table, text_or_empty

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8  # words; a power of two

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from an or not but have his they which you "
    "der die und den von zu das mit sich des auf für ist im dem nicht eine ein als auch es an werden aus er "
    "de la le et les en un du une que pour est dans qui par au sur pas avec ce il plus "
    "el y los se las del por con no su para al lo como más pero sus o"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails below ``low`` or above ``high``: percent of ``whole``, or
    the count itself where no whole is named.  ``low`` does not bind where the
    whole is below ``least``."""

    name: str
    part: str
    whole: str | None = None
    low: int | None = None
    high: int | None = None
    least: int = 0

    def failed(self, counts: Column) -> Column:
        part = counts[self.part]
        value, scale = (part, F.lit(1)) if self.whole is None else (part * 100, counts[self.whole])
        tests = []
        if self.low is not None:
            below = value < scale * self.low
            tests.append(below & (scale >= self.least) if self.least else below)
        if self.high is not None:
            tests.append(value > scale * self.high)
        return reduce(Column.__or__, tests)


BASE = (
    Rule("few_words", "n_words", low=20),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=30),
)
# Beyond the base: what running prose keeps to, with room on either side.
PROSE = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=25),
    Rule("stop_words", "n_stop_words", "n_words", low=3, least=50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")


def _pairs(hashes: Column, step: int) -> Column:
    """The hash of every element with the one ``step`` places on."""
    rest = F.size(hashes) - step
    return F.zip_with(F.slice(hashes, 1, rest), F.slice(hashes, step + 1, rest), lambda a, b: F.xxhash64(a, b))


def _covered(places: Column) -> Column:
    """Words in the union of the windows at the given ascending places."""
    reach = F.transform(places, lambda at, i: F.least(F.coalesce(F.get(places, i + 1) - at, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(reach, F.lit(0), lambda a, b: a + b)


def _repeated_places(windows: Column) -> Column:
    """Ascending places of the windows that another place holds too."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def shared(sorted_windows: Column) -> Column:
        def same(w: Column, i: Column, shift: int) -> Column:
            return F.coalesce(F.get(sorted_windows, i + shift)["h"] == w["h"], F.lit(False))

        return F.filter(sorted_windows, lambda w, i: same(w, i, -1) | same(w, i, 1))

    return F.sort_array(F.transform(bind(placed, shared), lambda w: w["i"]))


def repeat_words(words: Column) -> Column:
    """Words in windows found twice or more in the array, the first included."""
    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(
            bind(_repeated_places(windows), _covered)
        )

    def doubled(hashes: Column, step: int) -> Column:
        return of_windows(hashes) if step == WINDOW else bind(_pairs(hashes, step), lambda h: doubled(h, 2 * step))

    singles = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(bind(singles, lambda h: doubled(h, 1)))


def measures(text: Column) -> Column:
    """The counts of a text as a struct of bigints."""
    def of_text(t: Column) -> Column:
        words = F.array_remove(F.split(F.translate(t, SPACE, " " * len(SPACE)), " "), "")
        lines = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
        length = F.length(t)
        symbols = length - F.length(F.translate(t, SYMBOLS, ""))

        def of_words(w: Column) -> Column:
            stops = F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))
            return bind(lines, lambda kept: F.struct(*[
                value.cast("bigint").alias(name) for name, value in (
                    ("n_words", F.size(w)), ("word_chars", F.length(F.translate(t, SPACE, ""))), ("n_symbols", symbols),
                    ("n_lines", F.size(kept)), ("n_dup_lines", F.size(kept) - F.size(F.array_distinct(kept))),
                    ("n_stop_words", F.size(stops)), ("n_repeat_words", repeat_words(w)),
                )
            ]))

        return bind(words, of_words)

    return bind(text_or_empty(text), of_text)


def failures(counts: Column, rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a text with these counts fails, in table order."""
    return F.array_compact(F.array(*[F.when(r.failed(counts), F.lit(r.name)) for r in rules]))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + PROSE, into: str = "quality") -> DataFrame:
    """``docs`` with a struct ``into``: the counts, and ``failed`` (names of the
    rules); a document is good where that list is empty."""
    if into in docs.columns:
        raise ValueError(f"The table already has a column {into!r}")
    judged = bind(measures(F.col(text)), lambda m: F.struct(*[m[c].alias(c) for c in COUNTS], failures(m, rules).alias("failed")))
    # Taken out of an array, so that reading several fields computes them once.
    return docs.select("*", F.explode(F.array(judged)).alias(into))


def rules_sql(rules: tuple[Rule, ...]) -> str:
    """The same table as an SQL condition that holds where a rule fails."""
    def one(r: Rule) -> str:
        value, scale = (r.part, "1") if r.whole is None else (f"{r.part} * 100", r.whole)
        tests = []
        if r.low is not None:
            tests.append(f"({value} < {scale} * {r.low}" + (f" AND {scale} >= {r.least})" if r.least else ")"))
        if r.high is not None:
            tests.append(f"{value} > {scale} * {r.high}")
        return " OR ".join(tests)

    return "(" + " OR ".join(one(r) for r in rules) + ")"


_WORDS = r"'[^\x20\x09-\x0D]+'"
SQL = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w
    FROM documents
), windows AS (
    SELECT k, i, w[i:i + {WINDOW - 1}] AS win FROM docs, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS i)
), marked AS (
    SELECT k, i, count(*) OVER (PARTITION BY k, win) AS n FROM windows
), covered AS (
    SELECT k, sum(reach) AS n_repeat_words
    FROM (SELECT k, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, {WINDOW})) AS reach
          FROM marked WHERE n > 1)
    GROUP BY k
), counted AS (
    SELECT docs.k, doc_id, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS lines,
           len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{s}'" for s in dict.fromkeys(STOP_WORDS))}))) AS n_stop_words,
           coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM docs LEFT JOIN covered USING (k)
), measured AS (
    SELECT *, coalesce(chars, 0) AS word_chars, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines
    FROM counted
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, {rules_sql(BASE)} AS base_failed,
       NOT {rules_sql(BASE + PROSE)} AS kept
FROM measured"""


@query("op13_quality_rules", SQL)
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality.*")
    base = F.arrays_overlap("failed", F.array(*[F.lit(r.name) for r in BASE]))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (F.size("failed") == 0).alias("kept"),
    )
