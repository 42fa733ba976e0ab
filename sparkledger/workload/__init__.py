"""Queries over the given tables, one per operator."""

from . import (  # noqa: F401
    amount_queries,
    entity_queries,
    ledger_queries,
    review_queries,
    statement_queries,
    text_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
