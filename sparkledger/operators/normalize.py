"""Mapped rows to the eight normalised columns (PRJ2, PRJ3, NRM3-NRM12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_CURRENCY, UNKNOWN_BANK_ACCOUNT
from ..functions.amounts import credit_debit_amount, direction_amount, try_amount
from ..functions.dates import best_format, date_shape, date_text, parse_date
from ..functions.identity import json_names, row_json, transaction_id
from ..functions.text import strip_text
from ..sources.statements import number_rows
from .layout import numeric_flags, profile_columns

TRANSACTION_COLUMNS = [
    "transaction_id", "date", "account", "amount", "currency", "price", "description", "meta",
]


def constant_columns() -> dict[str, Column]:
    return {
        "account": F.lit(UNKNOWN_BANK_ACCOUNT),
        "currency": F.lit(DEFAULT_CURRENCY),
        "price": F.lit(None).cast("double"),
    }


MAPPED = {
    "date": "mapping.date_col",
    "description": "mapping.desc_col",
    "amount": "mapping.amount_col",
    "credit": "mapping.polarity.credit_col",
    "debit": "mapping.polarity.debit_col",
    "direction": "mapping.polarity.direction_col",
}
AMOUNTS = ["amount", "credit", "debit"]


def locate_columns(statements: DataFrame) -> DataFrame:
    """Adds ``at``: the 0-based place of every mapped column, -1 where missing."""
    place = lambda name: F.coalesce(F.array_position("columns", F.col(name)).cast("int") - 1, F.lit(-1))
    return statements.withColumn("at", F.struct(*[place(name).alias(k) for k, name in MAPPED.items()]))


def decide_formats(layouts: DataFrame, rows: DataFrame) -> DataFrame:
    """Per statement: layout, mapping, numeric columns and date format.

    ``layouts`` and ``rows`` went through ``locate_columns``. The rows are only
    aggregated here; the small result goes back to the raw lines.
    """
    profile = profile_columns(rows, date_text(F.get("fields", F.col("at.date"))))
    decided = profile.join(layouts, "statement_id").withColumn(
        "numeric", numeric_flags(F.col("columns"), F.col("text_masks"))
    )
    flag = lambda k: F.coalesce(F.get("numeric", F.col(f"at.{k}")), F.lit(False)).alias(k)
    return decided.select(
        *layouts.columns,
        "numeric",
        json_names(F.col("columns")).alias("names"),
        F.struct(*[flag(k) for k in AMOUNTS]).alias("is_numeric"),
        best_format(F.col("mapping.decimal_separator") == ",").alias("date_format"),
    )


def normalize(rows: DataFrame, mode: str = "lenient") -> DataFrame:
    """Parsed rows with the columns of ``decide_formats`` to transactions.

    Beside the eight columns: statement_id, line_no and amount_ok, which is
    false where a filled amount cell could not be read and counted as 0.
    """
    separator, polarity = F.col("mapping.decimal_separator"), F.col("mapping.polarity")
    cell = lambda k: F.get("fields", F.col(f"at.{k}"))
    cells = rows.select(
        "statement_id", "line_no", "names", "fields", "numeric", "mapping", "is_numeric", "date_format",
        date_text(cell("date")).alias("_date"),
        *[cell(k).alias(f"_{k}") for k in (*AMOUNTS, "direction")],
        strip_text(cell("description")).alias("description"),
    )
    parsed = cells.withColumns(
        {
            "_shape": date_shape(F.col("_date")),
            **{f"_{k}_read": try_amount(F.col(f"_{k}"), separator, F.col(f"is_numeric.{k}"), mode) for k in AMOUNTS},
        }
    )
    value = lambda k: F.coalesce(f"_{k}_read", F.lit(0.0))
    fine = lambda k: F.col(f"_{k}").isNull() | F.col(f"_{k}_read").isNotNull()
    signed = (
        F.when(polarity["type"] == "signed", value("amount"))
        .when(
            polarity["type"] == "direction",
            direction_amount(value("amount"), F.col("_direction"), polarity["outgoing_value"], mode),
        )
        .when(polarity["type"] == "credit_debit", credit_debit_amount(value("credit"), value("debit"), mode))
        .otherwise(F.lit(0.0))
    )
    both = polarity["type"] == "credit_debit"
    typed = parsed.withColumns(
        {
            "date": parse_date(F.col("_date"), F.col("_shape"), F.col("date_format")),
            "amount": signed,
            "amount_ok": F.when(both, fine("credit") & fine("debit")).otherwise(fine("amount")),
            "meta": row_json(F.col("names"), F.col("fields"), F.col("numeric")),
            **constant_columns(),
        }
    )
    return typed.withColumn(
        "transaction_id", transaction_id(F.col("date"), F.col("amount"), F.col("description"))
    ).select("statement_id", "line_no", *TRANSACTION_COLUMNS, "amount_ok")


def number_occurrences(transactions: DataFrame) -> DataFrame:
    """Adds ``occurrence``: equal rows of a statement share an id and are counted up."""
    return number_rows(transactions, ["statement_id", "transaction_id"], "line_no", "occurrence")

