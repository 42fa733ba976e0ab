"""Security trades in descriptions (LED1, LED2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BUY_WORDS, SELL_WORDS

TRADE = (
    r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(sorted([*BUY_WORDS, *SELL_WORDS], key=len, reverse=True))
    + r")\s+([0-9]+)\s+([A-Za-z]{2,5})\s+@\s+([0-9.,]+)"
)


def is_investment(description: Column) -> Column:
    """Any buy or sell word occurs somewhere in the description."""
    return F.coalesce(F.lower(description).rlike("|".join([*BUY_WORDS, *SELL_WORDS])), F.lit(False))


def trade_details(description: Column) -> Column:
    """struct(action, quantity, ticker, price), or null where none can be read."""
    part = lambda i: F.regexp_extract(description, TRADE, i)
    quantity = part(2).try_cast("double")
    price = F.replace(part(4), F.lit(","), F.lit(".")).try_cast("double")
    found = F.struct(
        part(1).alias("action"), quantity.alias("quantity"), part(3).alias("ticker"), price.alias("price")
    )
    return F.when(quantity.isNotNull() & price.isNotNull(), found)


def is_buy(action: Column) -> Column:
    """The whole word decides: 'Verkoop' is a sale although it contains 'koop'."""
    return F.lower(action).isin(BUY_WORDS)


def decimal_text(number: Column) -> Column:
    """A double in plain notation with at least one decimal (10.0, 150.25)."""
    wide = F.regexp_replace(number.try_cast("decimal(38,10)").cast("string"), r"(\.\d+?)0+$", "$1")
    plain = (F.abs(number) < 1e7) & ((F.abs(number) >= 1e-3) | (number == 0))
    return F.when(plain, number.cast("string")).otherwise(wide)
