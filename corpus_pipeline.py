"""A corpus from raw documents to a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
stage's rows as Parquet to the shared folder and reads them back as the next docs.
All stages but the last return the columns they were given. Empty tables give empty
results; rows without text go at the first stage; rows without an id stay and link
with nothing; repeated rows count as copies. No SQL twin: language scores, shingle
links and edit distances are beyond SQL; the tests hold ``run`` against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkledger.llm import decontaminate, language, mixing, neardup, substrings
from sparkledger.llm.registry import prepare
from sparkledger.session import stage_table

SIMILARITY_PERCENT = 80


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars of texts that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from all rows with a language; texts go in which none holds a third of the letters, or that are in none of them."""
    prepare(spark)
    return language.keep_learned(docs, language.learn(docs), language.learn_background(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    prepare(spark)
    return neardup.drop_near_copies(docs, SIMILARITY_PERCENT)


def cut_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document of a smaller id holds are cut out; emptied documents go."""
    prepare(spark)
    return _recount(substrings.cut_repeats(docs).filter("text is null or text <> ''"))


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a close edit of one, go."""
    prepare(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: sources at their target weights, repeated documents with their epoch."""
    return _recount(mixing.mix(docs))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_substrings),
    ("decontamination", decontaminate_documents),
    ("mix", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
