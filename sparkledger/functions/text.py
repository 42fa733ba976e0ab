"""Text cleaning and tokenising as column expressions (TXT*, PRJ1, NRM11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BANNED_TAGS, NOISE_PATTERNS, STOP_WORDS

UNICODE = "(?U)"
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_text(c: Column) -> Column:
    """Trim every Unicode white space, not only blanks; null stays null.

    Trimming a set of characters looks at the ends alone; a pattern would scan
    the whole text.
    """
    return F.btrim(c, F.lit(WHITE_SPACE))


def upper_text(c: Column) -> Column:
    return F.upper(c)


def any_word(words: Sequence[str]) -> str:
    """Alternation of literal words, longest first so the longest wins."""
    return "|".join(r"\Q" + w + r"\E" for w in sorted(words, key=lambda w: (-len(w), w)))


def drop_stop_words(c: Column, extra: Sequence[str] = ()) -> Column:
    """Replace whole stop words of an upper-cased text by one blank.

    Word characters are ASCII letters, digits and the underscore here.
    """
    words = list(dict.fromkeys(w.upper() for w in [*STOP_WORDS, *extra]))
    return F.regexp_replace(c, r"(?<![A-Za-z0-9_])(?:" + any_word(words) + r")(?![A-Za-z0-9_])", " ")


def drop_noise(c: Column) -> Column:
    """Remove dates, card numbers, long ids and punctuation, in this order."""
    for pattern in NOISE_PATTERNS:
        c = F.regexp_replace(c, UNICODE + pattern, " ")
    return c


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, UNICODE + r"\s+", " "))


def clean_text(c: Column, extra_stop_words: Sequence[str] = ()) -> Column:
    """The match key of a description; null and blank give ''."""
    return F.coalesce(collapse_spaces(drop_noise(drop_stop_words(upper_text(c), extra_stop_words))), F.lit(""))


def tokenize(c: Column) -> Column:
    """Segments of a bank line without numbers, long ids and single characters."""
    parts = F.transform(F.split(c, r"[/:*;,\-]|\s{2,}"), strip_text)
    keep = lambda t: (F.length(t) > 1) & ~t.rlike(r"^[0-9.]+$") & ~t.rlike(r"^[A-Za-z0-9]{16,}$")
    return F.coalesce(F.filter(parts, keep), F.array().cast("array<string>"))


def drop_banned_tags(tokens: Column) -> Column:
    banned = F.array(*[F.lit(t) for t in BANNED_TAGS])
    return F.filter(tokens, lambda t: ~F.array_contains(banned, F.upper(t)))


def match_words(c: Column) -> Column:
    """Lower-case words for alias matching; punctuation and '_' are breaks."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: w != "")


def match_key(c: Column) -> Column:
    return F.array_join(match_words(c), " ")
