"""What review teaches: merchants and labels (KNW1-KNW3, JON2, PRJ9, AGG1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import RESOLVE_THRESHOLD, VECTOR_DIM
from ..functions.text import clean_text
from ..session import stage_table
from ..sources.tables import upsert
from .classify import COUNTS, TextEmbedder, count_runs
from .nearest import nearest_merchant, split_by_dimension

MERCHANTS_SCHEMA = T.StructType(
    [
        T.StructField("canonical_name", T.StringType()),
        T.StructField("default_category", T.StringType()),
        T.StructField("vector_embedding", T.ArrayType(T.DoubleType())),
    ]
)


#: Merchants whose vectors say which encoder made them.
ENCODED_SCHEMA = T.StructType([*MERCHANTS_SCHEMA.fields, T.StructField("encoder", T.StringType())])


def check_encoder(merchants: DataFrame, embedder: TextEmbedder) -> None:
    """An error where a merchant's vector was made by another encoder than ``embedder``."""
    if "encoder" in merchants.columns:
        others = merchants.filter(F.col("vector_embedding").isNotNull() & ~F.col("encoder").eqNullSafe(F.lit(embedder.version)))
        found = others.select("canonical_name", "encoder").head(1)
        if found:
            raise ValueError(f"the vector of {found[0][0]!r} was made by encoder {found[0][1]}, not by {embedder.version}")


def upsert_merchants(
    merchants: DataFrame, changes: DataFrame, dim: int = VECTOR_DIM, version: str | None = None
) -> DataFrame:
    """Insert or replace by name; vectors of another dimension are left out."""
    right, _ = split_by_dimension(changes, "vector_embedding", dim)
    return upsert(merchants, right, "canonical_name", version)


def merchants_from_text(additions: DataFrame, embedder: TextEmbedder) -> DataFrame:
    """(name, category, description) to merchant rows: the description, or the
    name where there is none, is cleaned and turned into the vector. Rows of ``counted_feedback`` are turned into it at once."""
    text = additions
    if COUNTS not in additions.columns:
        described = F.coalesce(F.when(F.col("description") != "", F.col("description")), F.col("name"))
        text = additions.withColumn(embedder.text, clean_text(described)).drop("description")
    rows = embedder.transform(text, "vector_embedding").drop(embedder.text, COUNTS).withColumnsRenamed(
        {"name": "canonical_name", "category": "default_category"}
    )
    return rows.withColumn("encoder", F.lit(embedder.version))


def complete_feedback(labels: DataFrame) -> DataFrame:
    """Labels with entity, category and description all filled."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return labels.filter(filled("entity") & filled("category") & filled("description"))


def counted_feedback(labels: DataFrame, text: str = "cleaned_description", dim: int = VECTOR_DIM) -> DataFrame:
    """The complete labels with the runs of their cleaned descriptions counted, written once: an embedder
    is fitted on them and ``update_knowledge`` takes them as they are."""
    rows = complete_feedback(labels).withColumn(text, clean_text(F.col("description"))).drop("description")
    return stage_table(count_runs(rows, text, dim).drop(text), "feedback")


def update_knowledge(
    merchants: DataFrame, labels: DataFrame, embedder: TextEmbedder, dim: int = VECTOR_DIM, version: str | None = None
) -> DataFrame:
    """Merchants after a round of labels (entity, category, description), or of ``counted_feedback``."""
    complete = labels if COUNTS in labels.columns else complete_feedback(labels)
    rows = complete.withColumnRenamed("entity", "name")
    return upsert_merchants(merchants, merchants_from_text(rows, embedder), dim, version)


def distinct_categories(merchants: DataFrame) -> DataFrame:
    return merchants.select("default_category").filter("default_category is not null").distinct()


def resolve_texts(
    texts: DataFrame, merchants: DataFrame, embedder: TextEmbedder, dim: int = VECTOR_DIM,
    threshold: float = RESOLVE_THRESHOLD, text: str = "cleaned_description",
) -> DataFrame:
    """(text, canonical_name, default_category, similarity) of distinct cleaned texts."""
    check_encoder(merchants, embedder)
    # The length comes out of the aggregate: a filter on the cleaned text would
    # be pushed below it and clean every text a second time.
    asked = texts.groupBy(F.col(text).alias(embedder.text)).agg(F.max(F.length(text)).alias("_size"))
    asked = asked.filter("_size > 0").drop("_size")
    found = nearest_merchant(embedder.transform(asked), merchants, dim, threshold, key=embedder.text)
    return found.withColumnRenamed(embedder.text, text)


def resolve_entities(
    rows: DataFrame, description: str, merchants: DataFrame, embedder: TextEmbedder, dim: int = VECTOR_DIM,
    threshold: float = RESOLVE_THRESHOLD,
) -> DataFrame:
    """Clean, embed and look up every row; blank texts and misses give nulls."""
    cleaned = rows.withColumn("cleaned_description", clean_text(F.col(description)))
    return cleaned.join(resolve_texts(cleaned, merchants, embedder, dim, threshold), "cleaned_description", "left")
