"""Scores of one text line: data density and header keywords (HDR1, HDR2)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DENSITY_CHARS, HEADER_KEYWORDS, SEPARATORS
from .binding import let
from .text import strip_text

ASCII_LETTERS, ASCII_DIGITS = string.ascii_letters, string.digits
#: Neither letters nor digits nor separators; NUL has a meaning of its own in ``translate``.
ASCII_OTHERS = "".join(c for c in map(chr, range(1, 128)) if c not in ASCII_LETTERS + ASCII_DIGITS and c not in SEPARATORS)


def _sketch(line: Column) -> Column:
    """The line with every digit as '0', every letter as 'a', separators kept.

    The token counts then need no further regex. Lines of ASCII take one pass by a table of characters; others
    take a pattern for each kind.
    """
    table = F.translate(line, ASCII_LETTERS + ASCII_DIGITS + ASCII_OTHERS, "a" * len(ASCII_LETTERS) + "0" * len(ASCII_DIGITS))
    return let(table, lambda t: F.when(t.rlike(r"\A[0a;,\t|]*+\z"), t).otherwise(_sketch_by_patterns(line)))


def _sketch_by_patterns(line: Column) -> Column:
    c = F.regexp_replace(line, r"\p{Nd}", "0")
    c = F.regexp_replace(c, r"\p{L}", "a")
    return F.regexp_replace(c, r"[^0a;,\t|]", "")


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def has_separator(line: Column) -> Column:
    return strip_text(line).rlike(r"[;,\t|]")


def has_digit(line: Column) -> Column:
    return line.rlike(r"\p{Nd}")


def data_density(line: Column) -> Column:
    """Best share of number-like tokens over the separators found in the line.

    Without a separator: share of digits and number punctuation among all
    characters. A blank line scores 0.
    """
    numeric = lambda t: (_count(t, "0") > 0) & (_count(t, "0") >= _count(t, "a"))
    share = lambda tokens: F.size(F.filter(tokens, numeric)) / F.size(tokens)
    others = r"[^\p{Nd}" + DENSITY_CHARS.replace("-", r"\-") + "]"

    def tokens_score(sketch: Column) -> Column:
        # A separator that does not occur gives one token, which is no structure.
        split = [F.split(sketch, "\\" + sep if sep == "|" else sep, -1) for sep in SEPARATORS]
        present = F.filter(F.array(*split), lambda tokens: F.size(tokens) > 1)
        return F.array_max(F.transform(present, share))

    score = lambda stripped: F.coalesce(
        let(_sketch(stripped), tokens_score), F.length(F.regexp_replace(stripped, others, "")) / F.length(stripped)
    )
    empty = F.coalesce(F.length(strip_text(line)), F.lit(0)) == 0
    return F.when(empty, F.lit(0.0)).otherwise(let(strip_text(line), score))


def keyword_score(line: Column) -> Column:
    """Header keywords contained in the line, plus one for ',' or ';'."""
    low = F.lower(line)
    score = sum((F.contains(low, F.lit(k)).cast("int") for k in HEADER_KEYWORDS), F.lit(0))
    return F.coalesce(score + line.rlike("[,;]").cast("int"), F.lit(0))
