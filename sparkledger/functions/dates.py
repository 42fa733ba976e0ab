"""Date text: spelled dates, candidate formats and parsing (NRM8).

Dates with a month's name are read by their tokens: the name, two numbers and words that may stand
beside them; what the numbers are follows from their place and length. They and ISO
week dates become plain year-month-day text. Only dates of numbers can be ambiguous, and
these are settled for a whole statement by its formats.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DATE_FILLERS, MONTH_NAMES, WEEKDAY_NAMES
from .binding import let

# (pattern, shapes a text may have to be parsed with it; 9 stands for a digit).
# Comparing shapes is cheap and keeps failing parses, which are not, off the
# hot path. In order of preference; of each day-first / month-first pair the
# locale decides.
ISO_FORMATS = [
    ("yyyy-MM-dd", ["9999-99-99"]),
    ("yyyyMMdd", ["99999999"]),
    ("yyyy/M/d", ["9999/99/99", "9999/9/99", "9999/99/9", "9999/9/9"]),
]
PAIRED_FORMATS = [
    (f"{first}{sep}{second}{sep}{year}", [f"{a}{sep}{b}{sep}{digits}" for a in ("9", "99") for b in ("9", "99")])
    for year, digits in (("yyyy", "9999"), ("yy", "99"))
    for sep in (".", "/", "-")
    for first, second in (("d", "M"), ("M", "d"))
]
DATE_FORMATS = [*ISO_FORMATS, *PAIRED_FORMATS]
READABLE = [shape for _, shapes in DATE_FORMATS for shape in shapes]

#: A longer text is no date.
LONGEST_DATE = 64
ACCENTED, PLAIN = "äáàâãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc"
ISO_WEEK = r"^([0-9]{4})-?[Ww]([0-9]{2})(?:-?([1-7]))?$"


def _iso_week_day(text: Column) -> Column:
    """The day of '2024-W05-3'; a week stands for its Monday. Null for a week that the year does not have."""
    piece = lambda i: F.regexp_extract(text, ISO_WEEK, i)
    fourth = F.make_date(piece(1).try_cast("int"), F.lit(1), F.lit(4))  # lies in week 1
    week, day = piece(2).try_cast("int"), F.coalesce(piece(3).try_cast("int"), F.lit(1))
    monday = F.date_sub(fourth, F.weekday(fourth))
    found = F.date_add(monday, (week - 1) * 7 + day - 1)
    return F.when(text.rlike(ISO_WEEK) & (F.weekofyear(found) == week), found)


def _named_day(text: Column) -> Column:
    """The day of '5 March 2024', 'Mi., 15. März 24' or 'marzo 5, 2024'; null where it has other words or numbers."""
    months = F.create_map(*[F.lit(x) for i, names in enumerate(MONTH_NAMES, 1) for name in names.split() for x in (name, i)])
    beside = F.array(*[F.lit(w) for names in (*WEEKDAY_NAMES, DATE_FILLERS) for w in names.split()])
    folded = F.translate(F.lower(text), ACCENTED, PLAIN)

    def read(tokens: Column) -> Column:
        words, numbers = (F.filter(tokens, lambda t: t.rlike(f"^[{kind}]")) for kind in ("a-z", "0-9"))
        named = F.filter(words, lambda w: F.map_contains_key(months, w))
        known = F.forall(words, lambda w: F.map_contains_key(months, w) | F.array_contains(beside, w))
        # 'mar' is a weekday too: of two names the last is the month.
        month = F.element_at(months, F.try_element_at(named, F.lit(-1)))
        first, second = F.get(numbers, 0), F.get(numbers, 1)
        year_first = F.length(first) == 4
        year, day = F.when(year_first, first).otherwise(second), F.when(year_first, second).otherwise(first)
        sizes = F.length(year).isin(2, 4) & (F.length(day) <= 2)
        whole = F.when(F.length(year) == 2, year.try_cast("int") + 2000).otherwise(year.try_cast("int"))
        text_ = F.format_string("%04d-%02d-%02d", whole, month, day.try_cast("int"))
        fine = known & (F.size(named) >= 1) & (F.size(numbers) == 2) & sizes & (F.size(words) <= 4)
        return F.when(fine, F.try_to_date(text_, "yyyy-MM-dd"))

    return let(F.regexp_extract_all(folded, F.lit("[a-z]+|[0-9]+"), F.lit(0)), read)


def _spelled(text: Column) -> Column:
    """Text whose date has letters with the date as year, month and day; its clock time stays."""
    day = day_part(text)
    found = let(day, lambda d: F.when(d.rlike(r"\p{L}"), F.coalesce(_iso_week_day(d), _named_day(d))))
    return F.coalesce(F.concat(F.date_format(found, "yyyy-MM-dd"), F.substr(text, F.length(day) + 1)), text)


def date_text(c: Column) -> Column:
    """Text of a date cell; '20240831.0' (a number read as float) loses '.0', names and ISO weeks become numbers."""
    plain = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    spelled = lambda t: F.when((F.length(t) <= LONGEST_DATE) & t.rlike(r"\p{L}"), _spelled(t)).otherwise(t)
    return let(plain, spelled)


# A clock time behind any date: 1 the date, 2 hours, 3 minutes, 4 seconds with
# their fraction, 5 AM or PM, 6 the zone.
WITH_CLOCK = r"^(.+?)(?:[T ]|, )\s*([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}(?:[.,][0-9]+)?))?\s?([AaPp][Mm])?\s?(Z|UTC|[+-][0-9]{2}(?::?[0-9]{2})?)?$"


def day_part(text: Column) -> Column:
    """The text without a clock time."""
    timed = F.contains(text, F.lit(":"))
    return F.when(timed & text.rlike(WITH_CLOCK), F.regexp_extract(text, WITH_CLOCK, 1)).otherwise(text)


def _clock(text: Column) -> Column:
    """Time of day behind the date as an interval in UTC; none counts as midnight,
    an impossible one gives null."""
    piece = lambda i: F.regexp_extract(text, WITH_CLOCK, i)
    hour, minute = piece(2).try_cast("int"), piece(3).try_cast("int")
    second = F.coalesce(F.replace(piece(4), F.lit(","), F.lit(".")).try_cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    half = F.lower(piece(5))
    hour24 = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "pm", 12).otherwise(0))
    zone = piece(6)
    sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    ahead = lambda start: F.coalesce(F.substring(digits, start, 2).try_cast("int"), F.lit(0)) * sign
    fine = (hour < 24) & (minute < 60) & (second < 60) & ((half == "") | hour.between(1, 12))
    interval = F.make_dt_interval(F.lit(0), hour24 - ahead(1), minute - ahead(3), second)
    none = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0).cast("decimal(18,6)"))
    timed = F.contains(text, F.lit(":")) & text.rlike(WITH_CLOCK)
    return F.when(~timed, none).when(fine, interval)


def date_shape(text: Column) -> Column:
    """The date, without clock time, with 9 for digits."""
    return F.translate(day_part(text), "0123456789", "9999999999")


def readable_text(text: Column, shape: Column) -> Column:
    """The text if any format may read it: other text has no date, so it need not go along to its statement's format."""
    return F.when(shape.isin(READABLE), text)


def _parsed(text: Column, shape: Column, fmt: str, shapes: list[str]) -> Column:
    return F.when(shape.isin(shapes), F.try_to_timestamp(day_part(text), F.lit(fmt)))


def format_counts(text: Column, shape: Column) -> list[Column]:
    """Aggregates: rows each candidate format can read, as date_n0, date_n1, ..."""
    return [
        F.count(_parsed(text, shape, fmt, shapes)).alias(f"date_n{i}") for i, (fmt, shapes) in enumerate(DATE_FORMATS)
    ]


def best_format(day_first: Column) -> Column:
    """Index of the format that reads the most rows, from ``format_counts``.

    Ties go to the earlier format; within a pair, to the day-first one for
    comma-decimal statements and to the month-first one otherwise.
    """
    pairs = {fmt for fmt, _ in PAIRED_FORMATS}
    ranked = []
    for i, (fmt, _) in enumerate(DATE_FORMATS):
        favoured = (day_first if fmt[0] == "d" else ~day_first) if fmt in pairs else F.lit(True)
        ranked.append(
            F.struct(
                F.col(f"date_n{i}").alias("n"),
                F.coalesce(favoured, F.lit(False)).cast("int").alias("favoured"),
                F.lit(-i).alias("neg"),
            )
        )
    return -F.array_max(F.array(*ranked))["neg"]


def parse_date(text: Column, shape: Column, format_index: Column) -> Column:
    """Timestamp (UTC) by the statement's chosen date format and the text's own
    clock time; unreadable gives null."""
    parsed = F.lit(None).cast("timestamp")
    for i, (fmt, shapes) in reversed(list(enumerate(DATE_FORMATS))):
        parsed = F.when(format_index == i, _parsed(text, shape, fmt, shapes)).otherwise(parsed)
    return let(parsed, lambda day: F.when(day.isNotNull(), day + _clock(text)))
