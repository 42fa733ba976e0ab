"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, v) pairs with the smallest of v's and u beside them. The minimum is
    taken in the map tasks first, and a node of very many edges meets it in a
    join whose large partitions Spark splits."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(low, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(u, v)``; component is the smallest node reached.

    Every round is written to the shared folder; rounds grow with the logarithm
    of the longest path. Only a count and a sum come to the driver.
    """
    now = stage_table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage_table(_smallest(both).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        met = _smallest(down)
        small = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.filter("u <> m").select("u", F.col("m").alias("v")))
        now = stage_table(small.distinct(), "edges")
