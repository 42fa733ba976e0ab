"""Small ways to feed literal rows to column functions and operators."""

from pyspark.sql import functions as F

from sparkledger.sources.statements import lines_from_content


def apply(spark, column, values, kind="string"):
    """Values of ``column('v')`` for each input value, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.select(column(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]


def lines_of(spark, **statements):
    df = spark.createDataFrame(list(statements.items()), "statement_id string, content string")
    return lines_from_content(df, "statement_id", "content")
