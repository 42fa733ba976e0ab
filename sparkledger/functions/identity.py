"""Fingerprints and ids (MAP1, NRM9, NRM10, NRM12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JSON_NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"

JSON_SPECIAL = r'["\\\x00-\x1f]'


def header_hash(headers: Column) -> Column:
    """MD5 over the stripped header names."""
    return F.md5(F.array_join(headers, "\u0001"))


def as_uuid(hex_text: Column) -> Column:
    return F.regexp_replace(
        F.substring(hex_text, 1, 32), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def transaction_id(date: Column, amount: Column, description: Column) -> Column:
    """Deterministic id of a transaction: the same content gives the same id."""
    return as_uuid(
        F.sha2(
            F.concat(
                F.coalesce(F.date_format(date, "yyyy-MM-dd HH:mm:ss"), F.lit("NaT")),
                F.coalesce(amount.try_cast("decimal(18,2)").cast("string"), F.lit("")),
                F.coalesce(description, F.lit("")),
            ),
            256,
        )
    )


def random_id() -> Column:
    """Random id. It changes when a lost task is computed again, so it must be
    written out before use; ``transaction_id`` is the default everywhere."""
    return F.expr("uuid()")


def json_text(c: Column) -> Column:
    """A text as JSON string; only text with special characters is encoded."""
    encoded = F.btrim(F.to_json(F.array(c)), F.lit("[]"))
    return F.when(c.rlike(JSON_SPECIAL), encoded).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def json_names(names: Column) -> Column:
    return F.transform(names, json_text)


def row_json(names: Column, values: Column, numeric: Column) -> Column:
    """JSON of a source row with nulls kept; cells of numeric columns print as numbers.

    ``names`` went through ``json_names``, once per statement; ``numeric`` is
    an array of booleans aligned with it. The object is put together by hand
    because its keys differ from statement to statement.
    """
    number_text = lambda c: F.when(F.trim(c).rlike(JSON_NUMBER), F.trim(c)).otherwise(
        F.trim(c).try_cast("double").cast("string")
    )
    text = lambda value, i: F.coalesce(F.when(F.get(numeric, i), number_text(value)).otherwise(json_text(value)), F.lit("null"))
    cell = lambda value, i: F.concat(F.get(names, i), F.lit(":"), text(value, i))
    return F.concat(F.lit("{"), F.array_join(F.transform(values, cell), ","), F.lit("}"))
