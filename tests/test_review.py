from pyspark.sql import functions as F

from sparkledger.functions.text import clean_text
from sparkledger.operators.classify import Categorizer
from sparkledger.operators.ledger import generate_splits
from sparkledger.operators.review import (
    apply_feedback, attach_entities, completed_rows, completion, discovery_batches, next_batch, review_items, review_round, route, summarize,
)

TEXTS = [
    "TEAHOUSE GRAZ", "Wages of March", "Fuel Depot Lind", "Kiosk 77", "Corner Greengrocer",
    "Radhaus.de*Order", "TEAHOUSE GRAZ #9", "Lind Fuel Depot #31", "Radhaus Spare Parts", "Nimbus Hosting Plan",
]


def state_of(spark):
    rows = spark.createDataFrame([("s", i, f"t{i}", float(-i), t) for i, t in enumerate(TEXTS)], "statement_id string, line_no bigint, transaction_id string, amount double, description string")
    rows = rows.withColumns({"date": F.lit(None).cast("timestamp"), "cleaned_description": clean_text(F.col("description"))})
    known = spark.createDataFrame([("WAGES OF MARCH", "Employer", "Income", 0.95)], "cleaned_description string, canonical_name string, default_category string, similarity double")
    return route(rows, known)


def test_route_batch_and_feedback(spark):
    state = state_of(spark)
    s = summarize(state).first()
    assert (s["total"], s["auto_processed"], s["needs_review"]) == (10, 1, 9)
    batch = next_batch(state)
    assert sorted(r["line_no"] for r in batch.collect()) == [0, 2, 3, 4, 5]
    assert "original_examples" in review_items(batch).columns
    said = spark.createDataFrame([("teahouse graz", "Cafe", "Food")], "raw string, name string, category string")
    after = apply_feedback(state, said)
    rows = {r["line_no"]: r for r in after.collect()}
    assert rows[0]["method"] == "manual_user" and rows[0]["entity"] == "Cafe" and rows[0]["confidence"] == 1.0
    assert rows[6]["status"] == "needs_review"  # 'TEAHOUSE GRAZ 9' is another text
    assert not completion(after).first()["completed"] and completed_rows(after).count() == 0


def test_labelling_every_row_finishes_the_statement(spark):
    state = state_of(spark)
    said = state.select(F.lower("cleaned_description").alias("raw"), F.lit("E").alias("name"), F.lit("Cat").alias("category")).distinct()
    done = review_round(state, said, Categorizer())
    assert done.count() == 10 and completion(done).first()["completed"]
    ledger = attach_entities(generate_splits(completed_rows(done)), done)
    assert ledger.count() == 20 and {r["short_description"] for r in ledger.collect()} == {"E", "Employer"}


def test_round_with_trained_model(spark):
    labels = spark.createDataFrame([("LIND FUEL", "Fuel"), ("FUEL DEPOT", "Fuel"), ("NIMBUS HOSTING", "Tech"), ("NIMBUS PLAN", "Tech")], "cleaned_description string, category string")
    out = review_round(state_of(spark), spark.createDataFrame([], "raw string, name string, category string"), Categorizer.train(labels), threshold=0.0)
    rows = {r["description"]: r for r in out.collect()}
    assert rows["Nimbus Hosting Plan"]["account"] == "Tech" and rows["Nimbus Hosting Plan"]["method"] == "setfit_v2"
    assert rows["Wages of March"]["method"] == "vector_search"


def test_batches_of_a_long_statement(spark):
    rows = spark.range(230).select(F.lit("s").alias("statement_id"), (F.col("id") * 3).alias("line_no"))
    sizes = discovery_batches(rows).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in sizes] == [50, 50, 50, 50, 30]
