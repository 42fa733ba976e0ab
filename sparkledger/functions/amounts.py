"""Locale amounts and polarity (NRM1-NRM7, UDF1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MINUS_SIGNS, NULL_SPELLINGS, WIDE_SPACES
from .text import strip_text

PLAIN_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"

AmountParser = Callable[[Column], Column]


def null_if_missing(c: Column) -> Column:
    """Null for the spellings a CSV reader takes as missing."""
    return F.when(~c.isin(NULL_SPELLINGS), c)


def plain_number(c: Column) -> Column:
    """Double of a plain number, null for anything else."""
    return F.regexp_extract(F.trim(c), PLAIN_NUMBER, 0).try_cast("double")


def is_plain_number(c: Column) -> Column:
    return F.trim(c).rlike(PLAIN_NUMBER)


def _bare(c: Column) -> Column:
    signs = F.translate(c, MINUS_SIGNS + WIDE_SPACES, "-" * len(MINUS_SIGNS) + " " * len(WIDE_SPACES))
    return F.regexp_replace(signs, r"[^\p{Nd}.,\-]", "")


def us_number(c: Column) -> Column:
    """1,234.56 with currency signs, spaces and letters ignored; null if unreadable."""
    return plain_number(F.replace(_bare(c), F.lit(","), F.lit("")))


def eu_number(c: Column) -> Column:
    """1.234,56 with currency signs, spaces and letters ignored; null if unreadable."""
    return plain_number(F.translate(_bare(c), ",.", "."))


def strict_us_number(c: Column) -> Column:
    return plain_number(F.replace(strip_text(c), F.lit(","), F.lit("")))


def strict_eu_number(c: Column) -> Column:
    return plain_number(F.translate(strip_text(c), ",.", "."))


# Amount parsers by the mapping's decimal separator.
LENIENT_PARSERS: dict[str, AmountParser] = {".": us_number, ",": eu_number}
STRICT_PARSERS: dict[str, AmountParser] = {".": strict_us_number, ",": strict_eu_number}
DEFAULT_SEPARATOR = ","


def with_amount_parser(symbol: str, parser: AmountParser, mode: str = "lenient") -> dict[str, AmountParser]:
    """The mode's parsers and one more, for mappings whose decimal separator is ``symbol``."""
    return {**(LENIENT_PARSERS if mode == "lenient" else STRICT_PARSERS), symbol: parser}


def try_amount(
    value: Column,
    decimal_separator: Column,
    is_numeric: Column | None = None,
    mode: str = "lenient",
    parsers: dict[str, AmountParser] | None = None,
) -> Column:
    """Amount or null. ``is_numeric`` marks columns that hold plain numbers only:
    those were read as numbers and skip the locale rules. An unknown separator
    counts as the comma; ``parsers`` replaces those of the mode."""
    parsers = parsers or (LENIENT_PARSERS if mode == "lenient" else STRICT_PARSERS)
    by_locale = parsers[DEFAULT_SEPARATOR](value)
    for symbol, parser in parsers.items():
        if symbol != DEFAULT_SEPARATOR:
            by_locale = F.when(decimal_separator == symbol, parser(value)).otherwise(by_locale)
    if is_numeric is None:
        return by_locale
    return F.when(is_numeric, plain_number(value)).otherwise(by_locale)


def amount(
    value: Column,
    decimal_separator: Column,
    is_numeric: Column | None = None,
    mode: str = "lenient",
    parsers: dict[str, AmountParser] | None = None,
) -> Column:
    """Amount with 0 for missing and unreadable values."""
    return F.coalesce(try_amount(value, decimal_separator, is_numeric, mode, parsers), F.lit(0.0))


def direction_amount(amount_: Column, direction: Column, outgoing: Column, mode: str = "lenient") -> Column:
    """Sign by direction text: it contains the outgoing word (lenient) or equals it (strict)."""
    text, word = F.lower(direction), F.lower(outgoing)
    out = F.contains(strip_text(text), word) if mode == "lenient" else text == word
    return F.when(F.coalesce(out, F.lit(False)), -F.abs(amount_)).otherwise(F.abs(amount_))


def credit_debit_amount(credit: Column, debit: Column, mode: str = "lenient") -> Column:
    """Credit minus debit; in strict mode a non-zero credit wins."""
    if mode == "lenient":
        return F.abs(credit) - F.abs(debit)
    return F.when(credit != 0, F.abs(credit)).when(debit != 0, -F.abs(debit)).otherwise(F.lit(0.0))
