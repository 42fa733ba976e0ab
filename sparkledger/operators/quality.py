"""Schema contract, error collection and quarantine (VAL1-VAL3, SET2, AGG5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTRACT = T.StructType(
    [
        T.StructField("transaction_id", T.StringType(), False),
        T.StructField("date", T.TimestampType(), False),
        T.StructField("account", T.StringType(), False),
        T.StructField("amount", T.DoubleType(), False),
        T.StructField("currency", T.StringType(), False),
        T.StructField("description", T.StringType(), True),
        T.StructField("price", T.DoubleType(), True),
        T.StructField("meta", T.StringType(), True),
    ]
)


class ContractError(ValueError):
    """The table itself breaks the contract: a column is missing or mistyped."""


def check_schema(df: DataFrame, contract: T.StructType = CONTRACT) -> list[str]:
    """Schema-level failures; extra columns are allowed."""
    have = {f.name: f.dataType for f in df.schema.fields}
    times = (T.TimestampType, T.TimestampNTZType)
    failures = []
    for field in contract.fields:
        if field.name not in have:
            failures.append(f"{field.name}: missing")
        elif have[field.name] != field.dataType and not (
            isinstance(field.dataType, times) and isinstance(have[field.name], times)
        ):
            failures.append(f"{field.name}: {have[field.name].simpleString()} instead of {field.dataType.simpleString()}")
    return failures


def row_errors(contract: T.StructType = CONTRACT) -> Column:
    """Every failed check of a row as 'column: check', empty for a clean row."""
    checks = []
    for f in contract.fields:
        c = F.col(f.name)
        if not f.nullable:
            missing = c.isNull() | F.isnan(c) if isinstance(f.dataType, T.DoubleType) else c.isNull()
            checks.append(F.when(missing, F.lit(f"{f.name}: not_null")))
    checks.append(F.when(F.col("transaction_id") == "", F.lit("transaction_id: not_empty")))
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def collect_errors(df: DataFrame, contract: T.StructType = CONTRACT) -> DataFrame:
    failures = check_schema(df, contract)
    if failures:
        raise ContractError("; ".join(failures))
    return df.withColumn("errors", row_errors(contract))


def mark_quarantine(df: DataFrame, scope: str = "row") -> DataFrame:
    """Adds ``errors`` and ``quarantined``, in one pass over the table.

    ``scope='transaction'`` marks both splits of a transaction when one fails.
    """
    checked = collect_errors(df)
    failing = F.size("errors") > 0
    if scope == "row":
        return checked.withColumn("quarantined", failing)
    # Rows without an id stand alone; the hash keeps them from meeting in one task.
    alone = F.when(F.col("transaction_id").isNull(), F.xxhash64(*df.columns))
    together = F.max(failing).over(Window.partitionBy("transaction_id", alone))
    return checked.withColumn("quarantined", failing | (F.col("transaction_id").isNotNull() & together))


def split_quarantine(df: DataFrame, scope: str = "row") -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined with ``errors``)."""
    marked = mark_quarantine(df, scope)
    return marked.filter(~F.col("quarantined")).drop("errors", "quarantined"), marked.filter("quarantined").drop("quarantined")


def validate(df: DataFrame, scope: str = "row") -> DataFrame:
    return split_quarantine(df, scope)[0]


def count_failures(checked: DataFrame) -> DataFrame:
    """Failures per column and check."""
    part = F.split(F.col("error"), ": ")
    return (
        checked.select(F.explode("errors").alias("error"))
        .groupBy(part[0].alias("column"), part[1].alias("check"))
        .agg(F.count(F.lit(1)).alias("failures"))
    )
