"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. The keys of a source fall into ranges
(more for a larger source), the words of each range are summed, and prefix sums
over the ranges find the one in which the source's budget ends; only that range
is sorted by key, and its own prefix sums give the exact cut. Documents before
the cut are taken, the document at the cut in part, and a source whose budget
exceeds its size starts further epochs. Texts never move: documents are compared
with their source's cut, one row a source.

* Budgets: weights share ``share`` of all words; no budget exceeds ``max_epochs``
  times its source, and what is cut off is shared again by weight until no budget
  is above. Sources are ordered by code point, null last, and weigh ``weights``,
  repeating. The table of sources is ordered in one task: one narrow row a source.
* A word is a run of characters other than space and 0x09-0x0D; null text has none.
* Rows that agree in id and text share a key; at the cut they share the words left,
  rounded down. Reruns give the same mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Documents of a key range, about.
RANGE_ROWS = 50_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: str, text: str) -> Column:
    """A key that looks random and depends on nothing but id and text."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(F.col(text)), F.lit(""))))


def budgets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size, ...) with weight and target: each source's words in the mix.

    A budget at its limit is that limit; with sources ordered by limit per weight,
    those at their limit come first, so one running sum finds where they end.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = sizes.withColumn("weight", F.element_at(table, F.pmod(number - 1, F.lit(len(weights))).cast("int") + 1))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    left = total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", left / weight_left).withColumn("place", F.row_number().over(order))
    # The first source in this order that stays below its limit sets the level for itself and the rest.
    open_level = F.min(F.when(F.col("level") * F.col("weight") < F.col("limit"), F.struct("place", "level"))).over(everything)
    target = F.least(F.col("limit"), F.coalesce(open_level["level"] * F.col("weight"), F.col("limit")))
    return ranked.withColumn("target", target).drop("level", "limit", "place")


def cuts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row a source: source, source_size, target, epochs (whole passes), cut (the key at which
    the last pass ends), at_cut (words each document with that key gives to it)."""
    narrow = docs.select(F.col(source).cast("string").alias("source"), mix_key(doc_id, text).alias("key"), word_count(text).alias("size"))
    keys = stage_table(narrow.groupBy("source", "key").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "mix-keys")

    sources = keys.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("docs"))
    goal = budgets(sources, weights, share, max_epochs)
    goal = goal.withColumn("words", F.floor("target").cast("long")).withColumn("ranges", F.ceil(F.col("docs") / RANGE_ROWS).cast("long"))
    epochs = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0))
    goal = goal.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size"))
    goal = stage_table(goal.select("source", "source_size", "target", "ranges", "epochs", "rest"), "mix-goals")

    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    open_ = goal.filter("rest > 0").select(F.col("source").alias("its"), "ranges", "rest")
    ranged = keys.join(open_, F.col("source").eqNullSafe(F.col("its"))).select("source", "key", "size", "n", "rest", F.shiftright(place * F.col("ranges"), 32).alias("range"))
    per_range = ranged.groupBy("source", "range", "rest").agg(F.sum("size").alias("words"))
    until = F.sum("words").over(Window.partitionBy("source").orderBy("range"))
    at = per_range.withColumn("before", until - F.col("words")).filter("before < rest and rest <= before + words")
    at = at.select(F.col("source").alias("its"), F.col("range").alias("last_range"), "before")
    inside = ranged.join(at, F.col("source").eqNullSafe(F.col("its")) & (F.col("range") == F.col("last_range")))
    so_far = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key")) - F.col("size")
    cut = inside.withColumn("so_far", so_far).filter("so_far < rest and rest <= so_far + size")
    cut = cut.select(F.col("source").alias("its"), F.col("key").alias("cut"), F.expr("(rest - so_far) div n").alias("at_cut"))
    whole = goal.select("source", "source_size", "target", "epochs")
    # Staged, so that Spark knows its size: a small table is broadcast, a large one meets splittable partitions.
    return stage_table(whole.join(cut, F.col("source").eqNullSafe(F.col("its")), "left").drop("its"), "mix-cuts")


def _with_cut(docs: DataFrame, found: DataFrame, doc_id: str, text: str, source: str, size: Column) -> DataFrame:
    """``docs`` (as struct ``doc``) with key, size and its source's cut."""
    own = docs.select(F.struct(*docs.columns).alias("doc"), F.col(source).cast("string").alias("own_source"), mix_key(doc_id, text).alias("key"), size.alias("size"))
    joined = own.join(found, F.col("own_source").eqNullSafe(F.col("source")))
    last = F.when(F.col("key") < F.col("cut"), F.col("size")).when(F.col("key") == F.col("cut"), F.col("at_cut")).otherwise(F.lit(0))
    return joined.withColumn("last", F.coalesce(last, F.lit(0)).cast("long")).drop("own_source")


def mix_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **shares) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: taken counts the words the mix takes, repeats included."""
    found = cuts(docs, doc_id, text, source, **shares)
    rows = _with_cut(docs.select(*dict.fromkeys([doc_id, text, source])), found, doc_id, text, source, word_count(text))
    return rows.select(F.col("doc").getField(doc_id).alias("doc_id"), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("last")).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **shares) -> DataFrame:
    """The mix itself: the columns of ``docs`` and ``epoch`` (from 1; a column of that name is replaced),
    a row for each time a document is taken. The document at a cut keeps its first words, joined by one space."""
    found = cuts(docs, doc_id, text, source, **shares)
    rows = _with_cut(docs, found, doc_id, text, source, word_count(text))
    part = (F.col("last") > 0) & (F.col("last") < F.col("size"))
    passes = F.concat(F.sequence(F.lit(0), F.col("epochs")), F.when(F.col("last") > 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>")))
    taken = rows.withColumn("turn", F.explode(F.filter(passes, lambda e: e != 0)))
    words = F.regexp_extract_all(F.col("doc").getField(text), F.lit(f"({WORD})"))
    cut_text = F.array_join(F.slice(words, 1, F.greatest(F.col("last"), F.lit(1)).cast("int")), " ")
    whole = F.col("doc").getField(text)
    columns = [
        F.when((F.col("turn") == -1) & part, cut_text).otherwise(whole).alias(c) if c == text else F.col("doc").getField(c).alias(c)
        for c in docs.columns
        if c != "epoch"
    ]
    return taken.select(*columns, F.when(F.col("turn") == -1, F.col("epochs") + 1).otherwise(F.col("turn")).cast("int").alias("epoch"))
