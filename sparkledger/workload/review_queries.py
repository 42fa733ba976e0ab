"""Queries over the review loop: RVW*, JON4-6, AGG2, AGG3, SRT2, SRT4, SET1, PRJ6, PRJ8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators.classify import TextEmbedder
from ..operators.learning import Knowledge, learning_round
from ..operators.ledger import generate_splits
from ..operators.review import (
    accept_predictions,
    apply_feedback,
    attach_entities,
    completed_rows,
    completion,
    count_auto_categorized,
    discovery_batches,
    merge_processed,
    next_batch,
    review_items,
    route,
    still_unlabelled,
    suggest,
    summarize,
    uncategorized,
)
from ..session import stage_table
from . import views as V
from .registry import query, table
from .statement_queries import work_dir

# Events in review: purchases and sign-ups are known merchants, clicks are
# labelled by the user, errors are predicted, views stay open.


def _state(spark, d):
    rows = V.event_rows(spark, d)
    known = rows.filter(F.length("cleaned_description") > 5).select("cleaned_description").distinct()
    resolved = known.select(
        "cleaned_description", F.initcap("cleaned_description").alias("canonical_name"),
        F.concat(F.lit("Cat:"), F.col("cleaned_description")).alias("default_category"), F.lit(0.9).alias("similarity"),
    )
    return route(rows, resolved)


def _feedback(spark, d):
    """Two labels for one text, the later one counts; letter case differs."""
    clicks = table(spark, d, "events").filter("event_type = 'click'").select(F.col("event_type").alias("raw"))
    label = lambda name, v: clicks.distinct().select("raw", F.lit(name).alias("name"), F.lit("Cat:CLICK").alias("category"), F.lit(v).alias("version"))
    return label("Old", 1).unionByName(label("Click Shop", 2))


def _predictions(spark, d):
    texts = V.event_rows(spark, d).select("cleaned_description").distinct()
    sure = F.length("cleaned_description") == 5
    return texts.select("cleaned_description", F.when(sure, "Auto").alias("category"), F.when(sure, 0.9).otherwise(0.4).alias("confidence"))


STATE_SQL = """
state AS (SELECT user_id AS statement_id, event_id AS line_no, event_type, value AS amount,
  CASE WHEN event_type IN ('purchase', 'signup') THEN upper(event_type[1:1]) || event_type[2:] END AS entity,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'Cat:' || upper(event_type) END AS account,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 0.9 ELSE 0.0 END::double AS confidence,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'vector_search' END AS method,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'processed' ELSE 'needs_review' END AS status FROM events)"""
KEEP = ["line_no", "entity", "account", "confidence", "method", "status"]


@query("rvw1_route", f"WITH {STATE_SQL} SELECT line_no, entity, account, confidence, method, status FROM state")
def rvw1(spark, d):
    return _state(spark, d).select(*KEEP)


@query("rvw2_suggest", f"""WITH {STATE_SQL} SELECT line_no, entity,
 CASE WHEN event_type IN ('click', 'error') THEN 'Auto' ELSE account END AS account, CASE WHEN event_type IN ('click', 'error') THEN 0.9 ELSE confidence END AS confidence,
 CASE WHEN event_type IN ('click', 'error') THEN 'setfit' ELSE method END AS method, status FROM state""")
def rvw2(spark, d):
    """Suggestions change review rows; they stay in review."""
    return suggest(_state(spark, d), _predictions(spark, d)).select(*KEEP)


# Rounds that learn: a text is an event type and one of 26 words. Users label the words A to M of
# some types; the words N to Z of these types are left to the model that the round trains.
WORDED_SQL = """
worded AS (SELECT event_id // 3 AS statement_id, event_id AS line_no, event_type, value AS amount,
  event_type IN ('purchase', 'signup') AS known, user_id % 26 < 13 AS said FROM events)"""


def _outcome_sql(learned: str) -> str:
    """Rows after rounds that taught the types of ``learned`` (a condition)."""
    return f"""SELECT statement_id, line_no, amount,
  CASE WHEN known THEN 'Known' WHEN {learned} AND said THEN 'Shop ' || event_type END AS entity,
  CASE WHEN known THEN 'Cat:Known' WHEN {learned} THEN 'Cat:' || event_type END AS account,
  CASE WHEN known THEN 'vector_search' WHEN {learned} AND said THEN 'manual_user' WHEN {learned} THEN 'setfit_v2' END AS method,
  CASE WHEN known OR {learned} THEN 'processed' ELSE 'needs_review' END AS status FROM worded"""


TAUGHT = "event_type IN ('click', 'error')"
ROUND_SQL = WORDED_SQL + f", round AS ({_outcome_sql(TAUGHT)})"
ROUND_KEEP = ["line_no", "entity", "account", "method", "status"]


def _worded_state(spark, d):
    word = F.repeat(F.chr(65 + F.col("user_id") % 26), F.lit(3))
    rows = table(spark, d, "events").select(
        F.floor(F.col("event_id") / 3).alias("statement_id"), F.col("event_id").alias("line_no"), F.col("event_id").cast("string").alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("date"), F.col("value").alias("amount"), F.col("event_type").alias("description"),
        F.concat(F.upper("event_type"), F.lit(" "), word).alias("cleaned_description"),
    )
    known = rows.filter("description in ('purchase', 'signup')").select("cleaned_description").distinct()
    lit = lambda v, n: F.lit(v).alias(n)
    return route(rows, known.select("*", lit("Known", "canonical_name"), lit("Cat:Known", "default_category"), lit(0.9, "similarity")))


def _said(spark, d, *types):
    """What users say of some types: each text of a word from A to M once."""
    rows = table(spark, d, "events").filter(F.col("event_type").isin(*types) & (F.col("user_id") % 26 < 13))
    word = F.repeat(F.chr(97 + F.col("user_id") % 26), F.lit(3))
    return rows.select(
        F.concat("event_type", F.lit(" "), word).alias("raw"), F.concat(F.lit("Shop "), "event_type").alias("name"), F.concat(F.lit("Cat:"), "event_type").alias("category")
    ).distinct()


def _knowledge(spark, d):
    texts = _worded_state(spark, d).select("cleaned_description").distinct()
    return Knowledge.at(spark, work_dir(spark) + "/knowledge", TextEmbedder.fit(texts))


def _round(spark, d):
    return learning_round(_worded_state(spark, d), _said(spark, d, "click", "error"), _knowledge(spark, d))


@query("rvw3_review_round", f"WITH {WORDED_SQL} {_outcome_sql('NOT known')}")
def rvw3(spark, d):
    """Two rounds, even events first. Labels of the first count for the texts of the second,
    and its model still knows what the first was taught."""
    knowledge, state = _knowledge(spark, d), _worded_state(spark, d)
    first = learning_round(state.filter("line_no % 2 = 0"), _said(spark, d, "click", "error"), knowledge, tag="round-1")
    both = stage_table(first, "round-1").unionByName(state.filter("line_no % 2 = 1"))
    done = learning_round(both, _said(spark, d, "view"), knowledge, tag="round-2")
    return done.select("statement_id", "amount", *ROUND_KEEP)


@query("rvw3_first_round", f"WITH {ROUND_SQL} SELECT line_no, entity, account, method, status FROM round")
def rvw3_first(spark, d):
    """One round with two types taught: the third stays open, the model is not sure of it."""
    return _round(spark, d).select(*ROUND_KEEP)


@query("knw3_learned_merchants", f"""WITH {WORDED_SQL} SELECT 'Shop ' || event_type AS canonical_name, 'Cat:' || event_type AS default_category,
 2::bigint AS versions FROM worded WHERE NOT known AND said GROUP BY event_type""")
def knw3_learned(spark, d):
    """Merchants after two rounds, the second one run twice."""
    knowledge = _knowledge(spark, d)
    knowledge.learn(_said(spark, d, "click"), "round-1")
    for _ in range(2):
        knowledge.learn(_said(spark, d, "error", "view"), "round-2")
    versions = F.lit(len(knowledge.merchants.versions())).cast("bigint").alias("versions")
    return knowledge.merchants.read().select("canonical_name", "default_category", versions)


@query("rvw4_completion", f"WITH {ROUND_SQL} SELECT statement_id, bool_and(status = 'processed') AS completed FROM round GROUP BY 1")
def rvw4(spark, d):
    return completion(_round(spark, d))


@query("rvw4_completed_rows", f"""WITH {ROUND_SQL} SELECT line_no FROM round WHERE statement_id NOT IN (SELECT statement_id FROM round WHERE status = 'needs_review')""")
def rvw4_rows(spark, d):
    return completed_rows(_round(spark, d)).select("line_no")


@query("rvw5_skipped_rows", """SELECT event_id::varchar AS transaction_id, count(*) * 2 AS n_splits FROM events WHERE event_type <> 'view' GROUP BY 1""")
def rvw5(spark, d):
    """Entities registered as Skipped keep their rows out of the ledger."""
    from ..operators.ledger import category_as_account

    rows = V.event_rows(spark, d).withColumn("category", F.when(F.col("description") == "view", "Skipped").otherwise("Uncategorized"))
    return generate_splits(category_as_account(rows)).groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n_splits"))


FEEDBACK_SQL = f"""
docs AS (SELECT doc_id, {V.clean_sql('text')} AS clean FROM documents),
said AS (SELECT clean, doc_id AS version, 'D' || doc_id::varchar AS name, 'Q' || quality::varchar AS category FROM docs JOIN labels USING (doc_id) WHERE clean <> ''),
feedback AS (SELECT clean, arg_max(name, version) AS name, arg_max(category, version) AS category FROM said GROUP BY 1)"""


def _document_state(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("source").alias("statement_id"), F.col("doc_id").alias("line_no"), clean_text(F.col("text")).alias("cleaned_description")
    )
    none = F.lit(None).cast("string")
    return docs.withColumns({"entity": none, "account": none, "confidence": F.lit(0.0), "method": none, "status": F.lit("needs_review")})


def _document_feedback(spark, d):
    said = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return said.select(
        F.lower(clean_text(F.col("text"))).alias("raw"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("name"),
        F.concat(F.lit("Q"), F.col("quality").cast("string")).alias("category"), F.col("doc_id").alias("version"),
    )


@query("jon4_apply_feedback", f"""WITH {FEEDBACK_SQL} SELECT doc_id AS line_no, name AS entity, category AS account,
 CASE WHEN name IS NULL THEN 0.0 ELSE 1.0 END::double AS confidence, CASE WHEN name IS NOT NULL THEN 'manual_user' END AS method,
 CASE WHEN name IS NULL THEN 'needs_review' ELSE 'processed' END AS status FROM docs LEFT JOIN feedback USING (clean)""")
def jon4(spark, d):
    """Labels of some documents reach all copies of their cleaned text."""
    return apply_feedback(_document_state(spark, d), _document_feedback(spark, d)).select(*KEEP)


@query("jon5_still_unlabelled", f"WITH {FEEDBACK_SQL} SELECT doc_id AS line_no FROM docs WHERE NOT EXISTS (SELECT 1 FROM feedback f WHERE f.clean = docs.clean)")
def jon5(spark, d):
    return still_unlabelled(_document_state(spark, d), _document_feedback(spark, d)).select("line_no")


@query("jon6_attach_entities", f"""WITH {ROUND_SQL} SELECT line_no::varchar AS transaction_id, side AS account, coalesce(entity, '') AS short_description
 FROM round, (VALUES ('bank'), ('other')) s(side)""")
def jon6(spark, d):
    state = _round(spark, d)
    side = F.when(F.col("account") == "Assets:Current:Bank", "bank").otherwise("other")
    return attach_entities(generate_splits(state), state).select("transaction_id", side.alias("account"), "short_description")


@query("agg2_run_summary", f"WITH {STATE_SQL} SELECT statement_id, count(*) AS total, count(*) FILTER (status = 'processed') AS auto_processed, count(*) FILTER (status = 'needs_review') AS needs_review FROM state GROUP BY 1")
def agg2(spark, d):
    return summarize(_state(spark, d), "statement_id")


@query("agg3_auto_categorized", f"WITH {ROUND_SQL} SELECT statement_id, count(*) FILTER (method = 'setfit_v2') AS auto_categorized FROM round GROUP BY 1")
def agg3(spark, d):
    return count_auto_categorized(_round(spark, d), "statement_id")


BATCH_SQL = f"WITH {STATE_SQL}, batch AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY line_no) AS place FROM state WHERE status = 'needs_review' QUALIFY place <= 5)"


@query("srt2_next_batch", BATCH_SQL + " SELECT statement_id, line_no, place FROM batch")
def srt2(spark, d):
    return next_batch(_state(spark, d)).select("statement_id", "line_no", F.col("place").cast("bigint").alias("place"))


@query("prj8_review_items", BATCH_SQL + """ SELECT upper(event_type) AS raw, [event_type] AS original_examples, amount, entity AS suggested_name,
 account AS suggested_category, confidence FROM batch""")
def prj8(spark, d):
    return review_items(next_batch(_state(spark, d))).drop("date")


@query("srt4_discovery_batches", """SELECT user_id AS statement_id, event_id AS line_no,
 (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50 AS batch_id FROM events""")
def srt4(spark, d):
    return discovery_batches(V.event_rows(spark, d)).select("statement_id", "line_no", "batch_id")


@query("set1_merge_processed", "SELECT method, count(*) AS n_rows FROM (SELECT 'vector_search' AS method FROM events WHERE event_type IN ('purchase', 'signup') UNION ALL SELECT 'setfit_v2' FROM events WHERE event_type IN ('click', 'error')) GROUP BY 1")
def set1(spark, d):
    state = _state(spark, d)
    before = state.filter("status = 'processed'")
    newly = accept_predictions(state.filter("status = 'needs_review'"), _predictions(spark, d)).filter("status = 'processed'")
    return merge_processed(before, newly).groupBy("method").agg(F.count(F.lit(1)).alias("n_rows"))


@query("prj6_uncategorized", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'")
def prj6(spark, d):
    category = F.when(F.col("o_orderpriority") == "5-LOW", "Uncategorized").otherwise(F.col("o_orderpriority"))
    return uncategorized(table(spark, d, "orders").withColumn("category", category)).select("o_orderkey")
