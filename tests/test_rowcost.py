"""Cheaper ways through a row give what the plain ones give."""

import re
import string

from helpers import apply
from pyspark.sql import functions as F

from sparkledger.constants import SEPARATORS
from sparkledger.functions import lines
from sparkledger.operators import layout


def test_ascii_lines_are_sketched_alike(spark):
    every = "".join(map(chr, range(1, 128)))
    texts = ["", "2024-01-02;Shop 7,50", every, every[::-1], "café;٣,1", "a\x00b;1", "\U0001F600|x\t9", "²½Ⅷ", None]
    assert apply(spark, lines._sketch, texts) == apply(spark, lines._sketch_by_patterns, texts)
    # Only text that is not ASCII goes to the patterns, which took most of the time.
    assert [r for r in apply(spark, lambda c: F.translate(c, string.ascii_letters + lines.ASCII_OTHERS, "a" * 52), ["Ab;é-"])] == ["aa;é"]


def test_known_delimiters_come_as_literals(spark):
    """A pattern made of a column is compiled for each row; known delimiters give the same by literals."""
    texts = ['a{0}"b{0}""c"{0}d', '"x{0}y', 'plain{0}{0}z', '"a"b{0}"', '{0}"q"{0}', 'a"b{0}c', ""]
    rows = [(s, t.replace("{0}", s or ";")) for s in [*SEPARATORS, "#", "", None] for t in texts]
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "i int, d string, line string")
    both = df.select("i", layout.split_fields(F.col("line"), F.col("d")).alias("cells"), layout.has_open_quote(F.col("line"), F.col("d")).alias("open"))
    known, layout.SEPARATORS = layout.SEPARATORS, []
    try:
        plain = df.select("i", layout.split_fields(F.col("line"), F.col("d")).alias("cells"), layout.has_open_quote(F.col("line"), F.col("d")).alias("open"))
    finally:
        layout.SEPARATORS = known
    assert sorted(both.collect()) == sorted(plain.collect())
    shown = df.select(layout.has_open_quote(F.col("line"), F.col("d")).alias("open"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RLIKE\(line#\d+, \^", shown)) == len(SEPARATORS)

