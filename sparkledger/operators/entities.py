"""Merchants by alias and discovery (JON2, JON7, JON8, JON10, AGG6, KNW4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import UNCATEGORIZED
from ..functions.text import clean_text, match_key, match_words
from .fuzzy import rank_similar


# --- phonebook ------------------------------------------------------------

def _alias_rows(entities: DataFrame) -> DataFrame:
    """One row per alias; the name is an alias of itself."""
    named = F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return entities.select("canonical_name", "default_category", F.explode(named).alias("alias"))


def _owners(rows: DataFrame, key: str) -> DataFrame:
    """Of several owners of a key the smallest name keeps it."""
    owner = F.min(F.struct("canonical_name", "default_category")).alias("o")
    return rows.filter(F.col(key) != "").groupBy(key).agg(owner).select(key, "o.*")


def alias_table(entities: DataFrame) -> DataFrame:
    """(alias_key, canonical_name, default_category, n_words), one row per key.

    ``entities`` is (canonical_name, default_category, aliases).
    """
    keyed = _alias_rows(entities).withColumn("alias_key", match_key(F.col("alias")))
    return _owners(keyed, "alias_key").withColumn("n_words", F.size(F.split("alias_key", " ")))


def register_entities(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Append aliases to entities; the newest category of a name wins.

    ``changes`` is (canonical_name, default_category, alias, version). Aliases
    are made distinct as rows before they are gathered per name.
    """
    alias_rows = (
        entities.select("canonical_name", F.explode("aliases").alias("alias"))
        .unionByName(changes.select("canonical_name", "alias"))
        .filter("alias is not null")
        .distinct()
    )
    aliases = alias_rows.groupBy("canonical_name").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    versions = entities.select("canonical_name", "default_category", F.lit(-1).cast("bigint").alias("version")).unionByName(
        changes.select("canonical_name", "default_category", F.col("version").cast("bigint").alias("version"))
    )
    categories = versions.groupBy("canonical_name").agg(F.max_by("default_category", "version").alias("default_category"))
    return categories.join(aliases, "canonical_name", "left").select(
        "canonical_name", "default_category", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")
    )


def find_by_alias(names: DataFrame, entities: DataFrame, name: str = "name") -> DataFrame:
    """Exact alias lookup, letter case and outer spaces ignored; left join."""
    same = lambda c: F.lower(F.trim(c)).alias("_alias")
    known = _owners(_alias_rows(entities).select("canonical_name", "default_category", same("alias")), "_alias")
    return names.withColumn("_alias", same(name)).join(known, "_alias", "left").drop("_alias")


# --- alias inside a text --------------------------------------------------

def alias_postings(aliases: DataFrame, words: DataFrame) -> DataFrame:
    """``aliases`` with ``posted`` and ``offset``: the alias's word that is rarest among ``words(word)``, and its 0-based place."""
    parts = aliases.select("alias_key", F.posexplode(F.split("alias_key", " ")).alias("offset", "word"))
    counts = words.join(parts.select("word").distinct(), "word").groupBy("word").agg(F.count("*").alias("n"))
    rarest = F.min_by(F.struct(F.col("word").alias("posted"), "offset"), F.struct(F.coalesce("n", F.lit(0)), "offset"))
    chosen = parts.join(counts, "word", "left").groupBy("alias_key").agg(rarest.alias("r"))
    return aliases.join(chosen.select("alias_key", "r.*"), "alias_key")


def match_aliases(texts: DataFrame, aliases: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """(key, canonical_name, default_category, alias_key): the longest alias in a text.

    Aliases match at word borders. Each alias is posted under its rarest word, and a text meets
    the postings with each of its words once: the work grows with the words of the texts, not with
    texts times aliases or words times lengths. What has met goes back to its text and is
    compared with the neighbours in place. ``key`` identifies a text; without it the text itself does.
    """
    key = key or text
    worded = texts.select(F.col(key).alias("_key"), match_words(F.col(text)).alias("_words"))
    words = worded.select("_key", F.posexplode("_words").alias("at", "word"))
    posted = alias_postings(aliases, words.select("word"))
    met = words.join(posted, F.col("word") == F.col("posted")).select("_key", "alias_key", "n_words", "canonical_name", "default_category", (F.col("at") - F.col("offset")).alias("start"))
    single = met.filter("n_words = 1")
    run = F.array_join(F.slice("_words", F.col("start") + 1, F.col("n_words")), " ")
    longer = met.filter("n_words > 1 and start >= 0").join(worded, "_key").filter(run == F.col("alias_key"))
    fields = ["canonical_name", "default_category", "alias_key"]
    hits = single.select("_key", *fields).unionByName(longer.select("_key", *fields))
    best = F.max_by(F.struct(*fields), F.struct(F.length("alias_key"), F.col("alias_key")))
    return hits.groupBy("_key").agg(best.alias("b")).select(F.col("_key").alias(key), "b.*")


def apply_context_rules(category: Column, rules: Column, description: Column) -> Column:
    """The first rule whose keyword the description holds replaces the category."""
    hit = F.filter(rules, lambda r: F.contains(F.lower(description), F.lower(r["contains_keyword"])))
    return F.coalesce(F.try_element_at(hit, F.lit(1))["assign_category"], category)


def categorize(
    transactions: DataFrame, aliases: DataFrame, description: str = "description", rules: DataFrame | None = None
) -> DataFrame:
    """Adds entity and category ('Uncategorized' where nothing matches).

    Each distinct description is resolved once. ``rules`` is (canonical_name,
    rules array<struct<contains_keyword, assign_category>>).
    """
    texts = transactions.select(F.col(description).alias("_text")).filter(F.col(description).isNotNull()).distinct()
    # Runs of words carry a digest instead of the whole text.
    texts = texts.withColumn("_id", F.md5("_text"))
    found = match_aliases(texts, aliases, "_text", "_id").join(texts, "_id")
    if rules is not None:
        found = found.join(rules, "canonical_name", "left").withColumn(
            "default_category", apply_context_rules(F.col("default_category"), F.col("rules"), F.col("_text"))
        )
    found = found.select(
        F.col("_text").alias(description), F.col("canonical_name").alias("entity"), F.col("default_category").alias("category")
    )
    return transactions.join(found, description, "left").withColumn(
        "category", F.coalesce("category", F.lit(UNCATEGORIZED))
    )


# --- discovery ------------------------------------------------------------

def discover_entities(
    rows: DataFrame, description: str = "description", suggestions: DataFrame | None = None, examples: int = 3
) -> DataFrame:
    """(raw, n_rows, original_examples, suggested_name) of uncategorised descriptions.

    ``raw`` is the lower-case cleaned text. Rows are counted per distinct
    description first; a raw text keeps its first few descriptions, taken by a
    ranking that is cut to the few inside every task.
    """
    pairs = (
        rows.filter(F.col("category") == UNCATEGORIZED)
        .select(F.lower(clean_text(F.col(description))).alias("raw"), F.col(description).alias("example"))
        .groupBy("raw", "example")
        # The length comes out of the aggregate: a filter on raw itself would be
        # pushed below it and clean every text a second time.
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.length("raw")).alias("size"))
        .filter("size > 0")
    )
    counts = pairs.groupBy("raw").agg(F.sum("n").alias("n_rows"))
    order = Window.partitionBy("raw").orderBy("example")
    firsts = pairs.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= examples)
    shown = firsts.groupBy("raw").agg(F.array_sort(F.collect_list("example")).alias("original_examples"))
    found = counts.join(shown, "raw")
    if suggestions is None:
        return found.withColumn("suggested_name", F.lit(None).cast("string"))
    top = rank_similar(suggestions, 1).select(F.col("candidate").alias("raw"), F.col("name").alias("suggested_name"))
    return found.join(top, "raw", "left")
