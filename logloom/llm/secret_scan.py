"""Secret scans: fixed patterns and a battery of randomness tests.

Three patterns (assignments, access keys, long hexadecimal runs) give the base
spans.  Beside them every run of 20 or more token characters is a candidate:
its encoding is the smallest known alphabet that holds all its symbols, and
three tests ask whether it looks like uniform draws from that alphabet: a
chi-squared test of the symbol counts, a runs test of the halves of the
alphabet, and the serial correlation of neighbours.  Their combined p-value is
uniform on 0..1 for random strings and near 0 for patterns and most words.

Which strings are not random is decided by Benjamini-Hochberg over these
p-values in each encoding and length class by itself, at ``KEEP``: of the strings
that are ruled out, no larger share is random.  What remains may still be a word
that passed by chance, so a stated filter follows: a string's chance under the
fixed model of ``words`` over its chance under uniform draws from its encoding.
Among words that ratio falls below x at most with probability x, whatever the
string's length, so it is a p-value of being a word, and its inverse an e-value;
Benjamini-Hochberg over these, again by encoding and length class and at
``RATE``, bounds the share of words among what is reported.  A lone random
string is found like one of many, and repeating a table changes nothing.  Only
the bounded table of counts (encoding, length class, p-value in half nats, whole
nats against words) comes to the driver.

Everything is column expressions; no Python runs on the executors.

Defined results: a null or empty text has no spans; whole texts are scanned,
however long; equal rows give equal results; columns other than the named ones
pass through ``redact`` untouched.  Positions are code points, end exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, query, table, text_or_empty
from .words import SYMBOLS, log_steps

# The base patterns, with the smallest length of what they find.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Encodings from the smallest alphabet on.
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "hex_upper": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "base36_upper": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "mixed": UPPER + LOWER + DIGITS + "+/-_",
}
LENGTHS = (20, 24, 28, 32, 40, 48, 64, 96, 128, 256)  # lower ends of the length classes
KEEP = 0.001  # of what the battery rules out, the share that may be random
HALVES = 60  # a p-value of exp(-30) or less counts as that
NATS = 60  # a word's p-value of exp(-60) or less counts as that
RATE = 0.02  # of what is reported, the share that may be words

SPAN = "array<struct<start:int,kind:int,end:int>>"
RUN = 256  # matches whose places are added up in one array


def _steps(text: Column, pattern: str, group: int) -> Column:
    """The matches in order: characters before each, its length, the length of
    ``group``, and what was found."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    return F.transform(
        F.arrays_zip(gaps.alias("g"), found.alias("f"), kept.alias("k")),
        lambda x: F.struct(
            F.length(x["g"]).alias("gap"), F.length(x["f"]).alias("n"), F.length(x["k"]).alias("kept"), x["f"].alias("token")
        ),
    )


def _placed(steps: Column) -> Column:
    """The matches as struct(start, end, kept, token).

    Arrays grow by copying, so places are added up in runs of ``RUN`` matches,
    each from where the runs before it end: a text may hold very many."""
    end_of = lambda a, x: a + x["gap"] + x["n"]
    runs = F.transform(
        F.sequence(F.lit(0), F.call_function("div", F.size(steps) - 1, F.lit(RUN)).cast("int")),
        lambda r: F.slice(steps, r * RUN + 1, F.lit(RUN)),
    )
    starts = F.aggregate(
        runs, F.array(F.lit(0)),
        lambda acc, run: F.array_append(acc, F.aggregate(run, F.element_at(acc, -1), end_of)),
    )

    def walk(run: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<struct<start:int,end:int,kept:int,token:string>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            at = acc["at"] + x["gap"]
            match = F.struct(at.alias("start"), (at + x["n"]).alias("end"), x["kept"].alias("kept"), x["token"].alias("token"))
            return F.struct((at + x["n"]).alias("at"), F.array_append(acc["out"], match).alias("out"))

        return F.aggregate(run, first, step)["out"]

    return F.flatten(F.zip_with(runs, F.slice(starts, F.lit(1), F.size(runs)), walk))


PLACED = "array<struct<start:int,end:int,kept:int,token:string>>"


def _matches(text: Column, pattern: str, likely: Column, group: int = 0) -> Column:
    """Leftmost non-overlapping matches; most texts have none and are not split."""
    none = F.array().cast(PLACED)
    # Naming the steps in an array of one keeps them from being made over again.
    walked = F.transform(F.array(_steps(text, pattern, group)), lambda s: F.when(F.size(s) > 0, _placed(s)).otherwise(none))[0]
    return F.coalesce(F.when(likely, walked), none)


def _spans(text: Column, pattern: str, kind: int, likely: Column, group: int, least: int) -> Column:
    """Spans of the matches whose ``group`` has ``least`` characters."""
    kept = F.filter(_matches(text, pattern, likely, group), lambda m: m["kept"] >= least)
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns by start, then kind."""
    low = F.lower(text)
    named = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
        named = named | low.contains(word)
    return F.array_sort(F.concat(
        _spans(text, ASSIGN, 0, named, 1, ASSIGN_LENGTH),
        _spans(text, ACCESS, 1, text.contains("AKIA"), 0, ACCESS_LENGTH),
        _spans(text, HEX, 2, text.rlike("[0-9a-f]{%d}" % HEX_LENGTH), 0, HEX_LENGTH),
    ))


def _tail2(q: Column) -> Column:
    return F.exp(-q / 2)


def _tail3(q: Column) -> Column:
    """Upper tail of chi-squared with 3 degrees, by the rational approximation
    of the error function that is right to 1.5e-7."""
    x = F.sqrt(q / 2)
    t = F.lit(1.0) / (x * 0.3275911 + 1)
    poly = ((((t * 1.061405429 - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-q / 2) + F.sqrt(q * (2 / 3.141592653589793)) * F.exp(-q / 2)


def _encoding(token: Column) -> Column:
    out = F.lit(None).cast("int")
    for number, alphabet in reversed(list(enumerate(ALPHABETS.values()))):
        out = F.when(F.length(F.translate(token, alphabet, "")) == 0, number).otherwise(out)
    return out


def _by_encoding(encoding: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), encoding + 1)


def _log_chance(at: Column) -> Column:
    """Logarithm of the chance of a string among words, from the places of its
    characters in ``SYMBOLS``."""
    steps = F.split(F.lit(",".join(f"{x:.3f}" for x in log_steps())), ",").cast("array<double>")
    before = F.concat(F.array(F.lit(0)), F.slice(at, F.lit(1), F.size(at) - 1))
    return F.aggregate(
        F.zip_with(before, at, lambda a, b: F.element_at(steps, a * len(SYMBOLS) + b)), F.lit(0.0), lambda s, x: s + x
    )


def randomness(token: Column) -> Column:
    """struct(encoding int, n int, odd int, far int) of a token: its p-value
    among random strings is exp(-odd / 2) or less, but for ``odd`` of 0 or
    ``HALVES`` not by a half nat; among words it is exp(-far) or less."""
    body = F.rtrim(token, F.lit("="))
    tested = F.transform(
        F.array(F.struct(body.alias("s"), _encoding(body).alias("e"))),
        lambda x: F.struct(
            x["e"].alias("e"), x["s"].alias("s"), F.length(x["s"]).alias("n"),
            _by_encoding(x["e"], [float(len(a)) for a in ALPHABETS.values()]).alias("k"),
            F.slice(F.split(x["s"], ""), F.lit(1), F.length(x["s"])).alias("symbols"),
            _by_encoding(x["e"], list(ALPHABETS.values())).alias("alphabet"),
        ),
    )
    places = lambda x: F.transform(x["symbols"], lambda c: F.position(c, F.lit(SYMBOLS)))
    numbered = F.transform(tested, lambda x: F.struct(
        x["e"].alias("e"), x["n"].alias("n"), x["k"].alias("k"),
        F.aggregate(
            F.array_distinct(x["symbols"]), F.lit(0.0),
            lambda a, c: a + F.pow(F.length(x["s"]) - F.length(F.replace(x["s"], c, F.lit(""))), F.lit(2)),
        ).alias("squares"),
        F.transform(x["symbols"], lambda c: F.position(c, x["alphabet"]) - 1).alias("at"),
        F.transform(F.array(places(x)), _log_chance)[0].alias("words"),
    ))
    sums = F.transform(numbered, lambda x: F.struct(
        x["e"].alias("e"), x["n"].alias("n"), x["k"].alias("k"), x["squares"].alias("squares"), x["words"].alias("words"),
        F.aggregate(
            F.zip_with(F.slice(x["at"], F.lit(1), x["n"] - 1), F.slice(x["at"], F.lit(2), x["n"] - 1), lambda a, b: F.struct(
                F.when((a * 2 >= x["k"]) != (b * 2 >= x["k"]), 1.0).otherwise(0.0).alias("turn"),
                ((a - (x["k"] - 1) / 2) * (b - (x["k"] - 1) / 2)).alias("product"),
            )),
            F.struct(F.lit(0.0).alias("turns"), F.lit(0.0).alias("products")),
            lambda s, y: F.struct((s["turns"] + y["turn"]).alias("turns"), (s["products"] + y["product"]).alias("products")),
        ).alias("pairs"),
    ))

    def combine(x: Column) -> Column:
        n, k = x["n"], x["k"]
        chi = (k / n * x["squares"] - n - (k - 1)) / F.sqrt((k - 1) * 2 * (n - 1) / n)
        runs = (x["pairs"]["turns"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        serial = x["pairs"]["products"] / ((k * k - 1) / 12) / F.sqrt((n - 1).cast("double"))
        q = F.pow(F.greatest(chi, F.lit(0.0)), F.lit(2)) + runs * runs + serial * serial
        # The chi-squared part counts on one side only: half of the time it is 0.
        p = (_tail2(q) + _tail3(q)) / 2
        nats = F.greatest(F.lit(0.0), F.least(F.lit(float(NATS)), -x["words"] - n * F.log(k)))
        halves = F.least(F.lit(float(HALVES)), -2 * F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300))))
        return F.struct(
            x["e"].alias("encoding"), n.alias("n"), F.floor(halves).cast("int").alias("odd"), F.floor(nats).cast("int").alias("far")
        )

    return F.transform(sums, combine)[0]


def candidates(text: Column, base: Column) -> Column:
    """Tested token runs that touch no base span."""
    runs = _matches(text, CANDIDATE, text.rlike("[A-Za-z0-9+/_-]{20}"))
    free = F.filter(runs, lambda r: ~F.exists(base, lambda b: (r["start"] < b["end"]) & (b["start"] < r["end"])))

    def test(r: Column) -> Column:
        t = randomness(r["token"])
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), t["encoding"].alias("encoding"), t["n"].alias("n"), t["odd"].alias("odd"), t["far"].alias("far"))

    return F.transform(free, test)


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for number, low in enumerate(LENGTHS):
        out = F.when(n >= low, number).otherwise(out)
    return out


@dataclass(frozen=True)
class Thresholds:
    """By encoding and length class: half nats from which the battery rules a
    string out, and whole nats from which it is no word."""

    limits: dict[tuple[int, int], tuple[int, int]]

    def accept(self, c: Column) -> Column:
        if not self.limits:
            return F.lit(False)
        classes = c["encoding"] * 100 + _length_class(c["n"])
        odd, far = (
            F.element_at(F.create_map(*[F.lit(v) for (e, s), two in sorted(self.limits.items()) for v in (e * 100 + s, two[i])]), classes)
            for i in (0, 1)
        )
        return F.coalesce((c["odd"] < odd) & (c["far"] >= far), F.lit(False))


def ruled_out(counts: list[int], rate: float) -> int:
    """Benjamini-Hochberg over p-values counted by half nats: the fewest half
    nats that are ruled out.  A p-value counts as the largest of its half nat."""
    for odd in range(1, HALVES + 1):
        rejected = sum(counts[odd:])
        if rejected and sum(counts) * math.exp(-odd / 2) <= rate * rejected:
            return odd
    return HALVES + 1


def reported(counts: list[int], rate: float) -> int:
    """The same over p-values of being a word, counted by whole nats."""
    for far in range(1, NATS + 1):
        if 0 < sum(counts) * math.exp(-far) <= rate * sum(counts[far:]):
            return far
    return NATS + 1


def thresholds_of(table: dict[tuple[int, int], dict[tuple[int, int], int]], keep: float = KEEP, rate: float = RATE) -> Thresholds:
    """Limits from counts by class, and in each by (odd, far)."""
    limits = {}
    for key, found in table.items():
        odds = [0] * (HALVES + 1)
        for (odd, _), n in found.items():
            odds[odd] += n
        limit, fars = ruled_out(odds, keep), [0] * (NATS + 1)
        for (odd, far), n in found.items():
            fars[far if odd < limit else 0] += n  # what is ruled out counts as words
        limits[key] = (limit, reported(fars, rate))
    return Thresholds(limits)


def fit_thresholds(tested: Column, rows: DataFrame, rate: float = RATE) -> Thresholds:
    """The limits from all rows, through one table of counts."""
    one = rows.select(F.explode(tested).alias("c")).select("c.*")
    table: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
    for r in one.groupBy("encoding", _length_class(F.col("n")).alias("class"), "odd", "far").count().collect():
        table.setdefault((r["encoding"], r["class"]), {})[r["odd"], r["far"]] = r["count"]
    return thresholds_of(table, rate=rate)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(
        spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    ))


def _with_random(base: Column, tested: Column, thresholds: Thresholds) -> Column:
    random = F.transform(
        F.filter(tested, thresholds.accept),
        lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")),
    )
    return F.array_sort(F.concat(base, random))


def scan(docs: DataFrame, text: str = "text", rate: float = RATE) -> tuple[DataFrame, Thresholds]:
    """(row, base, spans): the whole row, its base spans and all its spans.

    The rows are written once with what was tested in them, since the limits
    come from all of them."""
    rows = docs.select(F.struct("*").alias("row"), text_or_empty(F.col(text)).alias("text"))
    based = rows.select("row", "text", base_spans(F.col("text")).alias("base"))
    tested = materialise(based.select("row", "base", candidates(F.col("text"), F.col("base")).alias("tested")), "secrets")
    thresholds = fit_thresholds(F.col("tested"), tested, rate)
    return tested.select("row", "base", _with_random(F.col("base"), F.col("tested"), thresholds).alias("spans")), thresholds


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """``docs`` with every secret replaced by ``mask``; overlapping spans count
    as one.  A column ``n_chars`` follows the text; a null text stays null."""
    scanned, _ = scan(docs, text, rate)
    body = text_or_empty(F.col(f"row.{text}"))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(body, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        put = F.when((s["start"] < acc["at"]) & (acc["at"] > 0), F.lit("")).otherwise(F.concat(gap, F.lit(mask)))
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.concat(acc["out"], put).alias("out"))

    walked = F.aggregate(F.col("spans"), first, step)
    whole = F.aggregate(F.array(walked), F.lit(""), lambda a, w: F.concat(w["out"], F.substring(body, w["at"] + 1, F.length(body))))
    clean = F.when(F.size("spans") == 0, F.col(f"row.{text}")).otherwise(whole)
    fields = []
    for field in scanned.schema["row"].dataType.fields:
        value = F.col("row").getField(field.name)
        if field.name == text:
            value = clean
        elif field.name == "n_chars":
            value = F.when(F.size("spans") == 0, value).otherwise(F.length(whole)).cast(field.dataType)
        fields.append(value.alias(field.name))
    return scanned.select(*fields)


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = text_or_empty(F.col("text"))
    based = docs.select("doc_id", text.alias("text"), base_spans(text).alias("base"))
    slim = materialise(based.select("doc_id", "base", candidates(F.col("text"), F.col("base")).alias("tested")), "secrets")
    thresholds = fit_thresholds(F.col("tested"), slim)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return slim.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(_with_random(F.col("base"), F.col("tested"), thresholds)).alias("spans"),
    )
