"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once and written once in the plan.

    Columns are trees without sharing: using a large expression several times
    copies it, and the plan grows with every level.
    """
    return F.transform(F.array(value), body)[0]
