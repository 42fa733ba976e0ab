"""Writing ledgers, quarantined rows and records (SNK1-SNK3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_ledger_csv(ledger: DataFrame, path: str, mode: str = "overwrite") -> None:
    ledger.write.mode(mode).option("header", True).csv(path)


def write_quarantine(quarantined: DataFrame, path: str, run_id: str) -> None:
    """Append one run's rejects; earlier runs stay. Repeating a run replaces it."""
    flat = quarantined.withColumn("errors", F.array_join("errors", "; ")) if "errors" in quarantined.columns else quarantined
    flat.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/run_id={run_id}")


def nan_to_null(df: DataFrame) -> DataFrame:
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    clean = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return df.select(*[clean(c) if c in floating else F.col(c) for c in df.columns])


def as_records(ledger: DataFrame) -> Column:
    """One JSON object per row, nulls written out."""
    return F.to_json(F.struct(*ledger.columns), {"ignoreNullFields": "false"})


def write_records(ledger: DataFrame, path: str, mode: str = "overwrite") -> None:
    nan_to_null(ledger).write.mode(mode).option("ignoreNullFields", "false").json(path)
