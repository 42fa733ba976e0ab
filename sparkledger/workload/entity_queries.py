"""Queries over vectors, classifiers and knowledge: JON1, JON2, FEA*, CLS*, KNW1-3, AGG1, AGG4, AGG7, SRT1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..functions.vectors import best_class
from ..operators.classify import Categorizer, LetterEncoder, TextEmbedder, char_grams, class_centroids, count_runs, label_ids, predict_by_centroid, uncertain_items
from ..operators.knowledge import (
    complete_feedback,
    counted_feedback,
    distinct_categories,
    resolve_entities,
    update_knowledge,
    upsert_merchants,
    merchants_from_text,
)
from ..operators.nearest import nearest_merchant, split_by_dimension
from ..session import stage_table
from . import views as V
from .registry import query, table
from .statement_queries import work_dir

DIM = V.VECTOR_SIZE

NEAREST_SQL = f"""WITH {V.MERCHANTS_SQL}, {V.QUERIES_SQL},
pairs AS (SELECT query_id, canonical_name, default_category, round(list_cosine_similarity(vector_embedding, vector), 9) AS similarity
  FROM queries, merchants),
best AS (SELECT * FROM pairs WHERE similarity >= {{threshold}}
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, canonical_name) = 1)
SELECT query_id, canonical_name, default_category, round(similarity, 6) AS similarity FROM best"""


def _nearest(spark, d, threshold, **kw):
    found = nearest_merchant(V.noisy_queries(spark, d), V.merchants(spark, d), DIM, threshold, **kw)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("jon1_nearest_merchant", NEAREST_SQL.format(threshold=0.85))
def jon1(spark, d):
    """Every noisy vector against every merchant, threshold 0.85."""
    return _nearest(spark, d, 0.85)


@query("jon1_nearest_merchant_tiles", NEAREST_SQL.format(threshold=0.85))
def jon1_tiles(spark, d):
    """The form for merchant tables too large to send to every task."""
    return _nearest(spark, d, 0.85, broadcast_bytes=100_000)


@query("srt1_top_similarity", NEAREST_SQL.format(threshold=-1.0))
def srt1(spark, d):
    """Top one whatever the similarity."""
    return _nearest(spark, d, -1.0)




@query("fea1_text_vector", f"""
WITH c AS (SELECT doc_id, {V.clean_sql('text')} AS clean FROM documents)
SELECT doc_id, length(clean)::double AS n_grams, CASE WHEN clean = '' THEN 0.0 ELSE 1.0 END AS norm FROM c""")
def fea1(spark, d):
    """Hashed character runs of whole documents: run counts and unit length."""
    docs = table(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("cleaned_description"))
    v = F.col("vector")
    grams = F.size(char_grams(F.col("cleaned_description"))).cast("double")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    counted = stage_table(count_runs(docs.withColumn("n_grams", grams)).drop("cleaned_description"), "runs")
    return TextEmbedder.fit(counted).transform(counted).select("doc_id", "n_grams", F.round(norm, 6).alias("norm"))


@query("udf3_encoder", f"""
WITH c AS (SELECT doc_id, {V.clean_sql('text')} AS clean FROM documents),
counts AS (SELECT doc_id, clean, [(length(clean) - length(replace(clean, chr((65 + i)::int), '')))::double FOR i IN range(26)] AS v FROM c),
norms AS (SELECT *, sqrt(list_sum([x * x FOR x IN v])) AS n FROM counts)
SELECT doc_id, CASE WHEN n > 0 THEN [round(x / n, 6) FOR x IN v] ELSE v END AS letters, true AS same_when_loaded, clean <> '' AS other_when_refit FROM norms""")
def udf3(spark, d):
    """Two encoders for one text: letter counts in value; hashed runs as saved and loaded, and against a model fitted on other texts."""
    docs = table(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("cleaned_description"))
    docs = stage_table(count_runs(docs), "runs")
    path = work_dir(spark) + "/encoder"
    hashed = TextEmbedder.fit(docs)
    hashed.save(path)
    refit = TextEmbedder.fit(table(spark, d, "benchmark").select(clean_text(F.col("text")).alias("cleaned_description")))
    rows = LetterEncoder().transform(docs, "letters")
    for name, encoder in {"own": hashed, "loaded": TextEmbedder.load(path), "refit": refit}.items():
        rows = encoder.transform(rows, name)
    return rows.select(
        "doc_id", F.transform("letters", lambda x: F.round(x, 6)).alias("letters"), (F.col("own") == F.col("loaded")).alias("same_when_loaded"),
        (F.col("own") != F.col("refit")).alias("other_when_refit"),
    )


@query("fea2_dimension_check", """
SELECT vec_id, vec_id % 9 <> 0 AS right_dimension FROM embeddings""")
def fea2(spark, d):
    e = table(spark, d, "embeddings")
    cut = F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, DIM - 1)).otherwise(F.col("embedding"))
    right, wrong = split_by_dimension(e.select("vec_id", cut.alias("embedding")), "embedding", DIM)
    tag = lambda df, ok: df.select("vec_id", F.lit(ok).alias("right_dimension"))
    return tag(right, True).unionByName(tag(wrong, False))


def _labelled_texts(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    category = F.concat(F.lit("Q"), F.col("quality").cast("string"), F.lit("T"), F.col("toxic").cast("string"))
    return docs.select("doc_id", F.col("lang"), clean_text(F.col("text")).alias("cleaned_description"), category.alias("label"))


@query("cls1_train_centroids", """
WITH parts AS (SELECT label, unnest(embedding)::double AS x, unnest(range(64)) AS pos FROM embeddings)
SELECT label::varchar AS canonical_name, pos::bigint AS pos, round(avg(x), 6) AS mean FROM parts GROUP BY ALL""")
def cls1(spark, d):
    """Mean vector per class."""
    c = class_centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("canonical_name", F.posexplode("vector_embedding")).select(
        "canonical_name", F.col("pos").cast("bigint").alias("pos"), F.round("col", 6).alias("mean")
    )


CENTROID_SQL = """WITH parts AS (SELECT label, unnest(embedding)::double AS x, unnest(range(64)) AS pos FROM embeddings),
means AS (SELECT label, pos, avg(x) AS m FROM parts GROUP BY ALL),
centroids AS (SELECT label::varchar AS label, list(m ORDER BY pos) AS c FROM means GROUP BY 1),
pairs AS (SELECT vec_id AS item_id, c.label, round(list_cosine_similarity(c, embedding::double[]), 9) AS confidence FROM embeddings, centroids c),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC, label) = 1)"""


def _centroid_predictions(spark, d, threshold):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")
    found = predict_by_centroid(e, class_centroids(e), DIM, threshold)
    return found.withColumn("confidence", F.round("confidence", 6))


@query("cls2_predict_centroid", CENTROID_SQL + " SELECT item_id, CASE WHEN confidence >= 0.7 THEN label END AS category, round(confidence, 6) AS confidence FROM best")
def cls2(spark, d):
    return _centroid_predictions(spark, d, 0.7)


@query("cls3_uncertain_items", CENTROID_SQL + " SELECT item_id, round(confidence, 6) AS confidence FROM best WHERE confidence < 0.7")
def cls3(spark, d):
    return uncertain_items(_centroid_predictions(spark, d, 0.7)).select("item_id", "confidence")


@query("cls1_cls2_logistic_regression")
def cls_lr(spark, d):
    """Train on the labelled documents, predict all documents."""
    model = Categorizer.train(_labelled_texts(spark, d), label="lang")
    docs = table(spark, d, "documents").select("doc_id", "lang", clean_text(F.col("text")).alias("cleaned_description"))
    return model.predict(docs).select("doc_id", "lang", "category", F.round("confidence", 4).alias("confidence"))


@query("cls1_cls2_regression_by_marker", "SELECT o_orderkey, o_orderpriority AS category, true AS sure FROM orders")
def cls_marked(spark, d):
    """Texts that carry their label in words: learned from the orders of even customers, predicted for all."""
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.concat("o_orderpriority", F.lit(" ORDER OF "), (F.col("o_custkey") % 100).cast("string")).alias("cleaned_description")
    )
    model = Categorizer.train(orders.filter("o_custkey % 2 = 0"), label="o_orderpriority")
    found = orders.join(model.predict_texts(orders), "cleaned_description")
    return found.select("o_orderkey", "category", (F.col("confidence") >= 0.7).alias("sure"))


@query("cls2_untrained", "SELECT doc_id, NULL::varchar AS category, 0.0::double AS confidence FROM documents")
def cls2_untrained(spark, d):
    return Categorizer().predict(table(spark, d, "documents").select("doc_id"))


@query("agg1_distinct_categories", "SELECT DISTINCT 'c' || label::varchar AS default_category FROM embeddings")
def agg1(spark, d):
    return distinct_categories(V.merchants(spark, d))


@query("agg4_label_ids", "SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT source AS label FROM documents)")
def agg4(spark, d):
    return label_ids(table(spark, d, "documents"), "source").withColumnRenamed("source", "label")


@query("agg7_best_class", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::bigint AS best, list_max(embedding)::double AS value FROM embeddings")
def agg7(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", best_class(v).cast("bigint").alias("best"), F.array_max(v).cast("double").alias("value"))


@query("knw1_upsert_merchants", f"""WITH {V.MERCHANTS_SQL}, {V.QUERIES_SQL}
SELECT 'm' || lpad(g.query_id::varchar, 9, '0') AS canonical_name,
 CASE WHEN query_id % 2 = 0 THEN 'second' ELSE 'c' || label::varchar END AS default_category,
 round(CASE WHEN query_id % 2 = 0 THEN vector[1] ELSE embedding[1] END, 6)::double AS first_value
FROM queries g JOIN embeddings ON vec_id = query_id
UNION ALL SELECT 'x' || vec_id::varchar, 'new', round(embedding[1]::double, 6) FROM embeddings""")
def knw1(spark, d):
    """Replace every other merchant, add as many new ones; two changes per name, the later wins."""
    q = V.noisy_queries(spark, d)
    even = q.filter(F.col("query_id") % 2 == 0)
    name = F.format_string("m%09d", F.col("query_id"))
    change = lambda category, version: even.select(
        name.alias("canonical_name"), F.lit(category).alias("default_category"), F.col("vector").alias("vector_embedding"), F.lit(version).alias("version")
    )
    new = table(spark, d, "embeddings").select(
        F.concat(F.lit("x"), F.col("vec_id").cast("string")).alias("canonical_name"), F.lit("new").alias("default_category"),
        F.col("embedding").cast("array<double>").alias("vector_embedding"), F.lit(1).alias("version"),
    )
    changes = change("first", 1).unionByName(change("second", 2)).unionByName(new)
    return upsert_merchants(V.merchants(spark, d), changes, DIM, "version").select(
        "canonical_name", "default_category", F.round(F.get("vector_embedding", F.lit(0)), 6).alias("first_value")
    )


def _seed_merchants(spark, d):
    """Every benchmark item as a merchant described by its text."""
    return table(spark, d, "benchmark").select(
        F.format_string("B%06d", F.col("item_id")).alias("name"), F.concat(F.lit("Cat"), (F.col("item_id") % 7).cast("string")).alias("category"),
        F.when(F.col("item_id") % 5 != 0, F.col("text")).alias("description"),
    )


@query("knw2_add_merchants", f"""SELECT 'B' || lpad(item_id::varchar, 6, '0') AS canonical_name, 'Cat' || (item_id % 7)::varchar AS default_category,
 384::bigint AS dim, 1.0 AS norm FROM benchmark""")
def knw2(spark, d):
    """Merchant vectors from descriptions, or from names where there is none."""
    seeds = _seed_merchants(spark, d)
    embedder = TextEmbedder.fit(table(spark, d, "benchmark").select(clean_text(F.col("text")).alias("cleaned_description")))
    v = F.col("vector_embedding")
    return merchants_from_text(seeds, embedder).select(
        "canonical_name", "default_category", F.size(v).cast("bigint").alias("dim"),
        F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"),
    )


def _feedback(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    category = F.concat(F.lit("Q"), F.col("quality").cast("string"))
    return docs.select(
        F.concat(F.lit("Doc"), F.col("doc_id").cast("string")).alias("entity"), category.alias("category"), F.col("text").alias("description"), F.col("doc_id").alias("version")
    )


@query("prj9_complete_feedback", "SELECT 'Doc' || doc_id::varchar AS entity, 'Q' || quality::varchar AS category FROM documents JOIN labels USING (doc_id) WHERE text <> ''")
def prj9(spark, d):
    """Documents without a label have no category and are left out."""
    return complete_feedback(_feedback(spark, d)).select("entity", "category")


@query("knw3_update_knowledge", """
SELECT 'Doc' || doc_id::varchar AS canonical_name, 'Q' || quality::varchar AS default_category, 384::bigint AS dim FROM documents JOIN labels USING (doc_id) WHERE text <> ''
UNION ALL SELECT 'B' || lpad(item_id::varchar, 6, '0'), 'Cat' || (item_id % 7)::varchar, 384 FROM benchmark""")
def knw3(spark, d):
    """A round of labels over the merchants known so far."""
    labels = counted_feedback(_feedback(spark, d))
    embedder = TextEmbedder.fit(labels)
    merchants = merchants_from_text(_seed_merchants(spark, d), embedder)
    return update_knowledge(merchants, labels, embedder, version="version").select(
        "canonical_name", "default_category", F.size("vector_embedding").cast("bigint").alias("dim")
    )


@query("jon2_resolve_entities", f"""
WITH items AS (SELECT item_id, {V.clean_sql('text')} AS clean FROM benchmark),
owners AS (SELECT clean, 'B' || lpad(min(item_id)::varchar, 6, '0') AS canonical_name FROM items WHERE clean <> '' GROUP BY 1)
SELECT item_id, canonical_name, CASE WHEN canonical_name IS NOT NULL THEN 1.0 END::double AS similarity FROM items LEFT JOIN owners USING (clean)
UNION ALL SELECT -1 - item_id, NULL, NULL FROM benchmark""")
def jon2(spark, d):
    """Descriptions with other case, card numbers and dates resolve to their merchant;
    blank texts to none. Merchants are described by the same texts."""
    items = table(spark, d, "benchmark")
    noise = F.concat(F.lit("pos visa 12/10/2023 "), F.lower("text"), F.lit(" XXXX4444 88291029384756"))
    rows = items.select("item_id", noise.alias("description")).unionByName(
        items.select((-1 - F.col("item_id")).alias("item_id"), F.lit(" \t ").alias("description"))
    )
    embedder = TextEmbedder.fit(items.select(clean_text(F.col("text")).alias("cleaned_description")))
    seeds = items.select(F.format_string("B%06d", F.col("item_id")).alias("name"), F.lit("Item").alias("category"), F.col("text").alias("description"))
    found = resolve_entities(rows, "description", merchants_from_text(seeds, embedder), embedder)
    return found.select("item_id", "canonical_name", F.round("similarity", 6).alias("similarity"))
