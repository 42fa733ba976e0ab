"""License notices in texts: MinHash bands over overlapping windows, exact containment after.

Words are runs of letters and digits, A-Z in lower case. A notice is found where a
window holds at least CONTAINMENT of its five-word shingles (a shorter notice has one
shingle, all its words).

1. Shingles that no notice has cannot count, so only positions of notice shingles go on
   (the notices are a given, bounded list and go to every task).
2. Windows are 2 L shingles long and start every L, L being the notice's shingles, so
   each place a notice may have lies in a window whole.
3. A window that holds 0.8 L of L shingles and at most 2 L in all has a similarity of
   0.8 / 2.2 or more with the notice; ``bands`` gives as many bands of ROWS hashes as
   leave it without a common band with a chance of at most MISS.
4. Windows that share a band with a notice are checked exactly.

DataFrame functions only. Null and empty texts hold nothing; rows that agree in id and
text count once; without notices nothing is found.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binding import let

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
ROWS = 1
MISS = 1e-4
#: A longer list belongs in several calls: the notices go to every task.
MOST_NOTICES = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Short public notices.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License."),
    ("mit-header", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def bands(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Fewest bands of ``rows`` hashes with which this similarity shares none with a chance of ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


BANDS = bands(CONTAINMENT / (3 - CONTAINMENT))


def _shingled(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the hashes of the text's shingles, in order, in place of the text."""
    words = F.filter(F.split(F.translate(F.col(text), _UPPER, _LOWER), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def runs(w: Column) -> Column:
        n = F.size(w)
        all_ = F.transform(F.sequence(F.lit(0), n - SHINGLE_WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE_WORDS)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < SHINGLE_WORDS, F.array(F.xxhash64(w))).otherwise(all_)

    return rows.withColumn("shingles", let(words, runs)).drop(text)


def _signature() -> list[Column]:
    """Band values of a group of rows ``shingle``."""
    mins = [F.min(F.xxhash64("shingle", F.lit(k))) for k in range(BANDS * ROWS)]
    return [F.xxhash64(F.lit(b), *mins[b * ROWS : (b + 1) * ROWS]).alias(f"b{b}") for b in range(BANDS)]


def _posted(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(F.array(*[F.col(f"b{b}") for b in range(BANDS)])).alias("band"))


def notice_table(spark: SparkSession, notices: Sequence[tuple[str, str]]) -> DataFrame:
    """(license, size, notice): each notice's distinct shingles."""
    if len(notices) > MOST_NOTICES:
        raise ValueError(f"at most {MOST_NOTICES} notices in one call")
    rows = _shingled(spark.createDataFrame(list(notices), "license string, text string"), "text")
    return rows.select("license", F.array_distinct("shingles").alias("notice")).withColumn("size", F.size("notice")).filter("size > 0")


def scan(docs: DataFrame, notices: Sequence[tuple[str, str]] = NOTICES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, containment, first_word): for each document and notice found, the window that
    holds most of it, the first of equals; first_word is where its first shingle of the notice starts."""
    known = notice_table(docs.sparkSession, notices)
    single = known.select(F.explode("notice").alias("shingle")).distinct()
    sizes = [r.size for r in known.select("size").distinct().orderBy("size").collect()]

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).cast("string").alias("text"))
    places = _shingled(rows.filter("text is not null"), "text").select("doc_id", "row", F.posexplode("shingles").alias("pos", "shingle"))
    hits = places.join(F.broadcast(single), "shingle").distinct()

    each = F.explode(F.array(*[F.lit(n) for n in sizes]).cast("array<int>")).alias("size")
    spread = hits.select("doc_id", "row", "pos", "shingle", each).withColumn("at", F.floor(F.col("pos") / F.col("size")))
    spread = spread.withColumn("window", F.explode(F.array("at", F.col("at") - 1)))
    windows = spread.groupBy("doc_id", "row", "size", "window").agg(
        F.collect_set("shingle").alias("held"), F.collect_set(F.struct("pos", "shingle")).alias("order"), *_signature()
    )
    signed = known.select("license", "size", "notice", F.explode("notice").alias("shingle")).groupBy("license", "size", "notice").agg(*_signature())
    pairs = _posted(windows, "doc_id", "row", "size", "window", "held", "order").join(F.broadcast(_posted(signed, "license", "size", "notice")), ["size", "band"])
    checked = pairs.dropDuplicates(["doc_id", "row", "size", "window", "license"]).withColumn("containment", F.size(F.array_intersect("held", "notice")) / F.col("size"))
    first = F.array_min(F.transform(F.filter("order", lambda x: F.array_contains("notice", x["shingle"])), lambda x: x["pos"]))
    found = checked.filter(F.col("containment") >= CONTAINMENT).select("doc_id", "license", "containment", first.alias("first_word"))
    best = Window.partitionBy("doc_id", "license").orderBy(F.desc("containment"), "first_word")
    return found.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")
