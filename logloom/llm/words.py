"""How likely a string is among words, names, numbers and paths.

A fixed chain over the 66 token characters: lower case, upper case, digits and
separators follow each other at set rates, and a letter follows a letter as in
the entries of a public vocabulary file, three parts in ten as if alone.  No
input is looked at, so a string is judged alike in any table.
"""

from __future__ import annotations

import json
import math
from functools import cache

LOWER, UPPER, DIGITS, MARKS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/-_"
SYMBOLS = LOWER + UPPER + DIGITS + MARKS

# What follows a kind of character, and what comes first: lower, upper, digit, mark.
STEPS = {
    "first": (0.5, 0.3, 0.15, 0.05), "lower": (0.92, 0.03, 0.015, 0.035), "upper": (0.35, 0.55, 0.03, 0.07),
    "digit": (0.07, 0.05, 0.8, 0.08), "mark": (0.5, 0.25, 0.2, 0.05),
}


def _kind(symbol: str) -> int:
    return next(k for k, held in enumerate((LOWER, UPPER, DIGITS, MARKS)) if symbol in held)


ALONE = 0.3  # of a letter's chance, whatever is before it


def vocabulary_file() -> str:
    """The file whose entries say how letters follow each other."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def letter_pairs(path: str) -> tuple[tuple[float, ...], ...]:
    """For every letter the chances of the next one, over the vocabulary's
    entries that are three letters or more, case folded."""
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    counts = [[1.0] * 26 for _ in range(26)]
    for entry in entries:
        word = entry.lstrip("\u0120").lower()  # the mark of a space before the entry
        if len(word) >= 3 and word.isascii() and word.isalpha():
            for a, b in zip(word, word[1:]):
                counts[LOWER.index(a)][LOWER.index(b)] += 1
    total = sum(map(sum, counts))
    alone = [sum(row[j] for row in counts) / total for j in range(26)]
    return tuple(tuple((1 - ALONE) * x / sum(row) + ALONE * alone[j] for j, x in enumerate(row)) for row in counts)


def log_steps(path: str | None = None) -> list[float]:
    """Logarithms of the chances of each symbol at the start, then after each
    symbol: ``1 + len(SYMBOLS)`` runs in the order of ``SYMBOLS``."""
    pairs = letter_pairs(path or vocabulary_file())
    alone = [1 / 26] * 26
    for _ in range(50):
        alone = [sum(alone[i] * pairs[i][j] for i in range(26)) for j in range(26)]
    out = []
    for before in ("", *SYMBOLS):
        kind = _kind(before) if before else None
        rates = STEPS["first"] if kind is None else STEPS[("lower", "upper", "digit", "mark")[kind]]
        for after in SYMBOLS:
            to = _kind(after)
            if to >= 2:
                chance = 1 / len((DIGITS, MARKS)[to - 2])
            elif kind in (0, 1) and (kind, to) != (0, 1):
                chance = pairs[LOWER.index(before.lower())][LOWER.index(after.lower())]
            else:
                chance = alone[LOWER.index(after.lower())]
            out.append(math.log(rates[to] * chance))
    return out
