"""Routing and review rounds over one state table (RVW*, JON4-JON6, AGG2, AGG3, SRT2, SRT4, PRJ6, PRJ8).

A row's ``status`` is 'processed' or 'needs_review'; it is never in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DISCOVERY_BATCH, REVIEW_BATCH, REVIEW_THRESHOLD, UNCATEGORIZED
from ..sources.statements import number_rows

PROCESSED, NEEDS_REVIEW = "processed", "needs_review"


def route(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Resolved rows are processed, the rest needs review.

    ``resolved`` is (cleaned_description, canonical_name, default_category, similarity).
    """
    hit = F.col("similarity").isNotNull()
    return (
        rows.join(resolved, "cleaned_description", "left")
        .withColumns(
            {
                "entity": F.col("canonical_name"),
                "account": F.col("default_category"),
                "confidence": F.coalesce("similarity", F.lit(0.0)),
                "method": F.when(hit, F.lit("vector_search")),
                "status": F.when(hit, F.lit(PROCESSED)).otherwise(F.lit(NEEDS_REVIEW)),
            }
        )
        .drop("canonical_name", "default_category", "similarity")
    )


def _predicted(state: DataFrame, predictions: DataFrame) -> DataFrame:
    p = predictions.select(
        "cleaned_description", F.col("category").alias("_category"), F.col("confidence").alias("_confidence")
    )
    return state.join(p, "cleaned_description", "left")


def _set(taken: Column, **values: Column) -> dict[str, Column]:
    return {name: F.when(taken, value).otherwise(F.col(name)) for name, value in values.items()}


def suggest(state: DataFrame, predictions: DataFrame) -> DataFrame:
    """Classifier suggestions for review rows; the rows stay in review."""
    taken = (F.col("status") == NEEDS_REVIEW) & F.col("_category").isNotNull()
    changes = _set(taken, account=F.col("_category"), confidence=F.col("_confidence"), method=F.lit("setfit"))
    return _predicted(state, predictions).withColumns(changes).drop("_category", "_confidence")


def accept_predictions(state: DataFrame, predictions: DataFrame) -> DataFrame:
    """Review rows with a prediction become processed."""
    taken = (F.col("status") == NEEDS_REVIEW) & F.col("_category").isNotNull()
    changes = _set(
        taken,
        account=F.col("_category"),
        confidence=F.col("_confidence"),
        method=F.lit("setfit_v2"),
        status=F.lit(PROCESSED),
    )
    return _predicted(state, predictions).withColumns(changes).drop("_category", "_confidence")


def feedback_table(feedback: DataFrame) -> DataFrame:
    """(raw_key, name, category), one row per text, letter case ignored.

    The highest ``version`` wins where a text was labelled twice.
    """
    version = F.col("version") if "version" in feedback.columns else F.lit(0)
    return (
        feedback.groupBy(F.upper("raw").alias("raw_key"))
        # Blank texts are left out by a length from the aggregate: a filter on
        # the text would be pushed down and compute it twice.
        .agg(
            F.max(F.struct(version.cast("bigint").alias("v"), "name", "category")).alias("f"),
            F.max(F.length("raw")).alias("size"),
        )
        .filter("size > 0")
        .select("raw_key", F.col("f.name").alias("name"), F.col("f.category").alias("category"))
    )


def apply_feedback(state: DataFrame, feedback: DataFrame) -> DataFrame:
    """Label review rows by their cleaned text."""
    f = feedback_table(feedback).withColumns({"_hit": F.lit(True)}).withColumnsRenamed({"name": "_name", "category": "_category"})
    joined = state.withColumn("raw_key", F.upper("cleaned_description")).join(f, "raw_key", "left")
    taken = (F.col("status") == NEEDS_REVIEW) & F.coalesce("_hit", F.lit(False))
    changes = _set(
        taken,
        entity=F.col("_name"),
        account=F.col("_category"),
        confidence=F.lit(1.0),
        method=F.lit("manual_user"),
        status=F.lit(PROCESSED),
    )
    return joined.withColumns(changes).drop("raw_key", "_name", "_category", "_hit")


def still_unlabelled(state: DataFrame, feedback: DataFrame) -> DataFrame:
    """Review rows no feedback speaks of."""
    keys = feedback_table(feedback).select("raw_key")
    rows = state.filter(F.col("status") == NEEDS_REVIEW).withColumn("raw_key", F.upper("cleaned_description"))
    return rows.join(keys, "raw_key", "left_anti").drop("raw_key")


def review_round(
    state: DataFrame, feedback: DataFrame, categorizer, threshold: float = REVIEW_THRESHOLD
) -> DataFrame:
    """State after labels first, then a given classifier's confident predictions for the rest."""
    labelled = apply_feedback(state, feedback)
    rest = labelled.filter(F.col("status") == NEEDS_REVIEW)
    return accept_predictions(labelled, categorizer.predict_texts(rest, threshold))


def summarize(state: DataFrame, *keys: str) -> DataFrame:
    """Total, auto-processed and open rows, per ``keys`` or over all."""
    return state.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == PROCESSED).alias("auto_processed"),
        F.count_if(F.col("status") == NEEDS_REVIEW).alias("needs_review"),
    )


def count_auto_categorized(state: DataFrame, *keys: str) -> DataFrame:
    return state.groupBy(*keys).agg(F.count_if(F.col("method").eqNullSafe(F.lit("setfit_v2"))).alias("auto_categorized"))


def completion(state: DataFrame, key: str = "statement_id") -> DataFrame:
    """Statements and whether nothing is left to review."""
    return state.groupBy(key).agg((F.count_if(F.col("status") == NEEDS_REVIEW) == 0).alias("completed"))


def completed_rows(state: DataFrame, key: str = "statement_id") -> DataFrame:
    """Rows of statements that may be written to the ledger."""
    open_ = state.filter(F.col("status") == NEEDS_REVIEW).select(key).distinct()
    return state.join(open_, key, "left_anti")


def next_batch(state: DataFrame, size: int = REVIEW_BATCH, key: str = "statement_id", order: str = "line_no") -> DataFrame:
    """The first open rows of each statement in file order.

    Each task keeps ``size`` rows per statement before the shuffle, so a
    statement of any length costs ``size`` rows per task.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return state.filter(F.col("status") == NEEDS_REVIEW).withColumn("place", place).filter(F.col("place") <= size)


def discovery_batches(rows: DataFrame, size: int = DISCOVERY_BATCH, key: str = "statement_id", order: str = "line_no") -> DataFrame:
    """Adds ``batch_id``: runs of ``size`` rows in file order, per statement."""
    numbered = number_rows(rows, [key], order, "_n")
    return numbered.withColumn("batch_id", F.floor((F.col("_n") - 1) / size)).drop("_n")


def review_items(batch: DataFrame, description: str = "description", date: str = "date", amount: str = "amount") -> DataFrame:
    """What a reviewer sees of each open row."""
    return batch.select(
        F.col("cleaned_description").alias("raw"),
        F.array(description).alias("original_examples"),
        F.col(date).alias("date"),
        F.col(amount).alias("amount"),
        F.col("entity").alias("suggested_name"),
        F.col("account").alias("suggested_category"),
        "confidence",
    )


def uncategorized(rows: DataFrame, category: str = "category") -> DataFrame:
    return rows.filter(F.col(category) == UNCATEGORIZED)


def merge_processed(processed: DataFrame, newly: DataFrame) -> DataFrame:
    return processed.unionByName(newly)


def attach_entities(ledger: DataFrame, state: DataFrame) -> DataFrame:
    """Adds short_description, the entity of the transaction or ''."""
    named = state.filter("entity is not null").groupBy("transaction_id").agg(F.max("entity").alias("short_description"))
    return ledger.join(named, "transaction_id", "left").withColumn(
        "short_description", F.coalesce("short_description", F.lit(""))
    )
