"""Text vectors and the classifier for what alias and vector search leave over
(FEA1, CLS1-CLS3, AGG4, AGG7)."""

from __future__ import annotations

import hashlib

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PREDICT_THRESHOLD, VECTOR_DIM
from ..functions.binding import let
from ..functions.vectors import best_class
from ..session import stage_table
from .nearest import nearest_merchant

GRAM = 3
COUNTS = "_counts"


# --- features -------------------------------------------------------------

def char_grams(text: Column, size: int = GRAM) -> Column:
    """Runs of ``size`` characters of the text between two blanks."""
    # Each match takes one character and looks ahead for its run: one compiled pass over the text.
    run = "(?s)(?=(" + "." * size + "))."
    runs = F.regexp_extract_all(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(run), 1)
    return F.coalesce(runs, F.array().cast("array<string>"))


def count_runs(df: DataFrame, text: str = "cleaned_description", dim: int = VECTOR_DIM) -> DataFrame:
    """Adds the counts of the text's hashed runs.

    This is the dear part of a vector, and no model is needed for it: texts that are learned from and then
    encoded, or read in several rounds, are counted and staged first, without the text.
    """
    return _feature_stages(dim)[0].transform(df.withColumn("_grams", char_grams(F.col(text)))).drop("_grams")


def _feature_stages(dim: int) -> list:
    return [
        HashingTF(inputCol="_grams", outputCol=COUNTS, numFeatures=dim),
        IDF(inputCol=COUNTS, outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_features"),
    ]


class TextEmbedder:
    """Cleaned text to a unit vector of hashed character runs.

    Another encoder takes its place by offering the same ``transform``, ``text`` and
    ``version``. Vectors of different versions are not comparable: merchant rows carry theirs.
    """

    def __init__(self, model: PipelineModel, text: str):
        self.model, self.text = model, text
        # The weights are as many numbers as a vector has.
        weights = model.stages[1].idf.toArray()
        self.version = hashlib.md5(f"{GRAM}:{len(weights)}:".encode() + weights.tobytes()).hexdigest()

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, text: str = "cleaned_description") -> TextEmbedder:
        return cls(PipelineModel.load(path), text)

    @classmethod
    def fit(cls, texts: DataFrame, text: str = "cleaned_description", dim: int = VECTOR_DIM) -> TextEmbedder:
        """Learn the weights from texts, or from rows of ``count_runs``."""
        hashing, *weighing = _feature_stages(dim)
        counted = texts if COUNTS in texts.columns else count_runs(texts, text, dim)
        fitted = Pipeline(stages=weighing).fit(counted.select(COUNTS))
        return cls(PipelineModel([hashing, *fitted.stages]), text)

    def transform(self, df: DataFrame, vector: str = "vector") -> DataFrame:
        """Adds the vector of the text; rows of ``count_runs`` need no text."""
        hashing, *weighing = self.model.stages
        counted = df if COUNTS in df.columns else count_runs(df, self.text, hashing.getNumFeatures())
        out = PipelineModel(weighing).transform(counted)
        made = [c for c in (COUNTS, "_weights", "_features") if c not in df.columns]
        return out.withColumn(vector, vector_to_array("_features")).drop(*made)


class LetterEncoder:
    """Cleaned text to a unit vector of its counts of the letters A to Z: nothing to learn, nothing hashed."""

    ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    version = "letters-1"

    def __init__(self, text: str = "cleaned_description"):
        self.text = text

    def transform(self, df: DataFrame, vector: str = "vector") -> DataFrame:
        text = F.upper(F.coalesce(F.col(self.text), F.lit("")))
        counts = F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in self.ALPHABET])
        norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        unit = let(counts, lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))
        return df.withColumn(vector, unit)


# --- labels ---------------------------------------------------------------

def label_ids(labelled: DataFrame, label: str = "label") -> DataFrame:
    """(label, label_id): distinct labels numbered in sorted order from 0.

    Labels are dealt to key ranges, numbered in their range and moved on by the counts of the ranges
    before; only these counts, one row a range, meet in order. Null is no label.
    """
    names = labelled.select(F.col(label).cast("string").alias(label)).filter(F.col(label).isNotNull()).distinct()
    # Ranges are drawn from a sample, so they are written once.
    ranged = stage_table(names.repartitionByRange(label).withColumn("_range", F.spark_partition_id()), "label-ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    numbered = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(label)))
    return numbered.join(shifts, "_range").select(label, (F.col("_shift") + F.col("_place") - 1).cast("bigint").alias("label_id"))


# --- logistic regression --------------------------------------------------

class Categorizer:
    """Few-shot classifier over all labels known so far."""

    def __init__(self, model: PipelineModel | None = None, text: str = "cleaned_description"):
        self.model, self.text = model, text

    @property
    def trained(self) -> bool:
        return self.model is not None

    @classmethod
    def train(
        cls, labelled: DataFrame, text: str = "cleaned_description", label: str = "category", dim: int = VECTOR_DIM
    ) -> Categorizer:
        """Fit on (text, label). Equal examples become one weighted row first; their runs are counted once for all rounds."""
        examples = (
            labelled.filter(F.col(text).isNotNull() & F.col(label).isNotNull())
            .groupBy(F.col(text).alias("_text"), F.col(label).cast("string").alias("_label"))
            .agg(F.count(F.lit(1)).cast("double").alias("_weight"))
        )
        examples = stage_table(count_runs(examples, "_text", dim).drop("_text"), "examples")
        if examples.isEmpty():
            return cls(None, text)
        hashing, *weighing = _feature_stages(dim)
        stages = [
            *weighing,
            StringIndexer(inputCol="_label", outputCol="_target", stringOrderType="alphabetAsc"),
            LogisticRegression(
                featuresCol="_features", labelCol="_target", weightCol="_weight", probabilityCol="_probability",
                rawPredictionCol="_raw", predictionCol="_prediction", family="multinomial", regParam=0.001, maxIter=50,
            ),
        ]
        return cls(PipelineModel([hashing, *Pipeline(stages=stages).fit(examples).stages]), text)

    def predict(self, df: DataFrame, threshold: float = PREDICT_THRESHOLD) -> DataFrame:
        """Adds category (null below the threshold) and confidence."""
        if not self.trained:
            return df.withColumns({"category": F.lit(None).cast("string"), "confidence": F.lit(0.0)})
        features = PipelineModel([*self.model.stages[:3], self.model.stages[4]])
        scored = features.transform(df.withColumn("_grams", char_grams(F.coalesce(F.col(self.text), F.lit("")))))
        labels = F.array(*[F.lit(name) for name in self.model.stages[3].labels])
        probabilities = F.col("_p")
        out = scored.withColumn("_p", vector_to_array("_probability")).withColumns(
            {
                "confidence": F.array_max(probabilities),
                "category": F.when(
                    F.array_max(probabilities) >= threshold, F.get(labels, best_class(probabilities).cast("int"))
                ),
            }
        )
        return out.select(*df.columns, "category", "confidence")

    def predict_texts(self, df: DataFrame, threshold: float = PREDICT_THRESHOLD) -> DataFrame:
        """(text, category, confidence), each distinct text scored once."""
        return self.predict(df.select(self.text).distinct(), threshold)


def uncertain_items(predicted: DataFrame) -> DataFrame:
    """Rows whose category stayed open."""
    return predicted.filter(F.col("category").isNull())


# --- nearest class centroid ----------------------------------------------

def class_centroids(labelled: DataFrame, label: str = "label", vector: str = "vector") -> DataFrame:
    """Mean vector per class, shaped as a merchant table. Partial means are
    combined, so a class of any size sends one vector per task."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    name = F.col(label).cast("string")
    return (
        labelled.groupBy(name.alias("canonical_name"))
        .agg(vector_to_array(mean).alias("vector_embedding"))
        .select("canonical_name", F.col("canonical_name").alias("default_category"), "vector_embedding")
    )


def predict_by_centroid(
    items: DataFrame, centroids: DataFrame, dim: int, threshold: float = PREDICT_THRESHOLD,
    key: str = "item_id", vector: str = "vector",
) -> DataFrame:
    """(key, category, confidence): nearest centroid, no category below the threshold."""
    best = nearest_merchant(items, centroids, dim, -1.0, key, vector)
    scored = items.select(key).join(best, key, "left")
    confidence = F.coalesce("similarity", F.lit(0.0))
    return scored.select(
        key, F.when(confidence >= threshold, F.col("default_category")).alias("category"), confidence.alias("confidence")
    )
