"""End to end: raw lines to transactions to a validated ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators.entities import categorize
from ..operators.layout import bad_rows, detect_layout, lay_out, parse_rows, quoted_parts, table_rows
from ..operators.ledger import category_as_account, generate_splits
from ..operators.mapping import resolve_mapping
from ..operators.normalize import decide_formats, locate_columns, normalize
from ..operators.quality import split_quarantine
from ..operators.review import completed_rows, route
from ..session import stage_table


def statement_records(lines: DataFrame, structured_only: bool = True) -> tuple[DataFrame, list[DataFrame]]:
    """(layouts, parts): one row per statement, and its lines with quoted line
    breaks joined. Lines and layouts are needed several times and staged."""
    lines = lay_out(lines)
    layouts = stage_table(detect_layout(lines, structured_only), "layouts")
    return layouts, quoted_parts(lines, layouts)


def parse_parts(parts: list[DataFrame], per_statement: DataFrame) -> DataFrame:
    """Rows of all parts. Each part meets the statements where its lines lie; a union would hide that."""
    return reduce(DataFrame.unionByName, [parse_rows(part, per_statement) for part in parts])


def _decide(layouts: DataFrame, parts: list[DataFrame], cached: DataFrame | None, proposed: DataFrame | None) -> DataFrame:
    located = stage_table(locate_columns(resolve_mapping(layouts, cached, proposed)), "mappings")
    return stage_table(decide_formats(located, table_rows(parse_parts(parts, located))), "decisions")


def decide_statements(
    lines: DataFrame, cached: DataFrame | None = None, proposed: DataFrame | None = None, structured_only: bool = True
) -> DataFrame:
    """One row per statement: header, delimiter, columns, mapping, numeric columns, date format."""
    return _decide(*statement_records(lines, structured_only), cached, proposed)


def normalize_statements(
    lines: DataFrame,
    cached: DataFrame | None = None,
    proposed: DataFrame | None = None,
    structured_only: bool = True,
    mode: str = "lenient",
) -> DataFrame:
    """Transactions of all statements in ``lines(statement_id, line_no, line)``.

    The lines are laid out once in buckets of statement and chunk (``lay_out``), then read
    there for the header window, for open quotes, for the whole-column facts and for the rows; what is
    decided between, one row per statement, is staged and goes to the buckets.
    """
    layouts, parts = statement_records(lines, structured_only)
    decisions = _decide(layouts, parts, cached, proposed)
    return normalize(table_rows(parse_parts(parts, decisions)), mode)


def unreadable_rows(lines: DataFrame, structured_only: bool = True) -> DataFrame:
    """(statement_id, line_no, line) of the records that cannot be read."""
    layouts, parts = statement_records(lines, structured_only)
    return bad_rows(parse_parts(parts, layouts))


def route_statements(transactions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Transactions with their cleaned text, routed to processed or review."""
    return route(transactions.withColumn("cleaned_description", clean_text(F.col("description"))), resolved)


def ledger_by_alias(
    transactions: DataFrame, aliases: DataFrame, rules: DataFrame | None = None, scope: str = "row"
) -> tuple[DataFrame, DataFrame]:
    """(ledger, quarantine): categorise by alias, drop skipped rows, split, validate."""
    categorized = category_as_account(categorize(transactions, aliases, rules=rules))
    return split_quarantine(generate_splits(categorized), scope)


def statements_to_ledger(
    lines: DataFrame,
    aliases: DataFrame,
    rules: DataFrame | None = None,
    cached: DataFrame | None = None,
    scope: str = "row",
) -> tuple[DataFrame, DataFrame]:
    """(ledger, quarantine) of raw lines. The transactions are staged: matching
    needs their descriptions first and their rows afterwards."""
    transactions = stage_table(normalize_statements(lines, cached), "transactions")
    return ledger_by_alias(transactions, aliases, rules, scope)


def ledger_of_completed(state: DataFrame, scope: str = "row") -> tuple[DataFrame, DataFrame]:
    """(ledger, quarantine) of the statements with nothing left to review."""
    return split_quarantine(generate_splits(completed_rows(state)), scope)
