"""Double-entry splits (LED1-LED5, AGG8, PRJ4, PRJ5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    BANK_ACCOUNT,
    DEFAULT_CURRENCY,
    DEFAULT_EXPENSE_ACCOUNT,
    INVESTMENT_ACCOUNT_PREFIX,
    SKIPPED,
)
from ..functions.trades import decimal_text, is_buy, is_investment, trade_details

SPLIT_COLUMNS = ["transaction_id", "date", "description", "account", "amount", "currency", "price", "meta"]


def category_as_account(df: DataFrame, category: str = "category") -> DataFrame:
    """The category becomes the account; rows marked Skipped leave the ledger."""
    return df.withColumn("account", F.col(category)).filter(~F.col("account").eqNullSafe(F.lit(SKIPPED)))


def _split(description: Column, account: Column, amount: Column, currency: Column) -> Column:
    return F.struct(
        description.alias("description"),
        account.alias("account"),
        amount.alias("amount"),
        currency.alias("currency"),
        F.lit(None).cast("double").alias("price"),
    )


def _bank_split() -> Column:
    return _split(F.col("description"), F.lit(BANK_ACCOUNT), F.col("amount"), F.lit(DEFAULT_CURRENCY))


def _category_split(account: Column) -> Column:
    return _split(
        F.col("description"),
        F.coalesce(account, F.lit(DEFAULT_EXPENSE_ACCOUNT)),
        -F.col("amount"),
        F.lit(DEFAULT_CURRENCY),
    )


def _security_split(trade: Column) -> Column:
    ticker = F.upper(trade["ticker"])
    sign = F.when(is_buy(trade["action"]), F.lit(1.0)).otherwise(F.lit(-1.0))
    text = F.concat_ws(
        " ", trade["action"], decimal_text(trade["quantity"]), trade["ticker"], F.lit("@"), decimal_text(trade["price"])
    )
    return _split(text, F.concat(F.lit(INVESTMENT_ACCOUNT_PREFIX), ticker), F.abs(trade["quantity"]) * sign, ticker)


def _explode_splits(df: DataFrame, second: Column) -> DataFrame:
    """Two rows per transaction: a narrow map step, no shuffle."""
    extra = [c for c in ("statement_id", "line_no") if c in df.columns]
    meta = F.col("meta") if "meta" in df.columns else F.lit(None).cast("string")
    base = df.select(
        *extra, "transaction_id", "date", meta.alias("meta"), F.explode(F.array(_bank_split(), second)).alias("s")
    )
    return base.select(
        *extra, "transaction_id", "date", "s.description", "s.account", "s.amount", "s.currency", "s.price", "meta"
    )


def _prepared(df: DataFrame) -> DataFrame:
    typed = df.withColumn("amount", F.col("amount").cast("double"))
    return typed if "account" in df.columns else typed.withColumn("account", F.lit(None).cast("string"))


def standard_splits(df: DataFrame) -> DataFrame:
    """Bank account and category account with opposite amounts."""
    return _explode_splits(_prepared(df), _category_split(F.col("account")))


def investment_splits(df: DataFrame) -> DataFrame:
    """Bank cash and units of the security; unreadable trades get standard splits."""
    rows = _prepared(df).withColumn("_trade", trade_details(F.col("description")))
    second = F.when(F.col("_trade").isNotNull(), _security_split(F.col("_trade"))).otherwise(
        _category_split(F.col("account"))
    )
    return _explode_splits(rows, second)


def generate_splits(df: DataFrame) -> DataFrame:
    """The ledger of a table of transactions: investment or standard per row."""
    description = F.col("description")
    rows = _prepared(df).withColumn("_trade", F.when(is_investment(description), trade_details(description)))
    second = F.when(F.col("_trade").isNotNull(), _security_split(F.col("_trade"))).otherwise(
        _category_split(F.col("account"))
    )
    return _explode_splits(rows, second)


def balances(splits: DataFrame) -> DataFrame:
    """Sum per transaction and currency; standard pairs sum to 0. A sum with an
    amount that is missing or no number is null."""
    value = F.col("amount").cast("decimal(18,2)")
    return splits.groupBy("transaction_id", "currency").agg(
        F.when(F.count(value) == F.count(F.lit(1)), F.sum(value).cast("decimal(38,2)")).alias("balance"),
        F.count(F.lit(1)).alias("n_splits"),
    )


def harmonize_items(items: DataFrame, date_col: str, desc_col: str) -> DataFrame:
    """Review items of one mapping to the ledger's column names."""
    return items.withColumns({"date": F.col(date_col), "description": F.col(desc_col)})
