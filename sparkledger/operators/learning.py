"""Rounds that learn: a cumulative label table, merchants and a model registry (KNW3, RVW3).

What a user says in one round is kept for all later ones. A round adds its labels to the
label table, upserts the merchants they name, trains the classifier on every label known so
far, registers it, and only then predicts what is still open: labels count in the round
that brings them. Everything is a versioned commit; a round with a tag that has been
committed changes nothing.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import REVIEW_THRESHOLD, VECTOR_DIM
from ..session import stage_table
from ..sources.tables import CommitLog, VersionedTable, upsert
from .classify import Categorizer, TextEmbedder
from .knowledge import ENCODED_SCHEMA, complete_feedback, update_knowledge
from .review import feedback_table, review_round

LABELS_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in ("raw_key", "name", "category")])


class ModelRegistry:
    """Trained classifiers under numbered commits, each tagged with the version of the labels it learned from."""

    def __init__(self, spark: SparkSession, path: str, text: str = "cleaned_description"):
        self.path, self.text = path.rstrip("/"), text
        self.log = CommitLog(spark, path)

    def register(self, model: Categorizer, labels_version: int) -> int:
        folder = f"model-{uuid.uuid4().hex}"
        if model.trained:
            model.model.save(f"{self.path}/{folder}")
        else:
            folder = ""
        while True:
            version = (self.log.versions() or [0])[-1] + 1
            if self.log.commit(version, folder, str(labels_version)):
                return version

    def trained_on(self, labels_version: int) -> Categorizer | None:
        """The newest model that learned from this version of the labels."""
        version = self.log.tagged(str(labels_version))
        return None if version is None else self._load(version)

    def latest(self) -> Categorizer:
        """The newest model; an untrained one where there is none."""
        versions = self.log.versions()
        return self._load(versions[-1]) if versions else Categorizer(None, self.text)

    def _load(self, version: int) -> Categorizer:
        folder, _ = self.log.entry(version)
        return Categorizer(PipelineModel.load(f"{self.path}/{folder}") if folder else None, self.text)


class Knowledge(NamedTuple):
    """What rounds have taught so far, in one folder."""

    labels: VersionedTable
    merchants: VersionedTable
    models: ModelRegistry
    embedder: TextEmbedder
    dim: int = VECTOR_DIM

    @classmethod
    def at(cls, spark: SparkSession, path: str, embedder: TextEmbedder, dim: int = VECTOR_DIM) -> Knowledge:
        path = path.rstrip("/")
        return cls(
            VersionedTable(spark, f"{path}/labels", LABELS_SCHEMA),
            VersionedTable(spark, f"{path}/merchants", ENCODED_SCHEMA),
            ModelRegistry(spark, f"{path}/models", embedder.text),
            embedder,
            dim,
        )

    def learn(self, feedback: DataFrame, tag: str = "") -> Categorizer:
        """Take in (raw, name, category[, version]) and train on all labels known then.

        Labels and merchants are upserts by text and by name, so labels given twice count once. Where a
        round dies between its commits, running it again completes it.
        """
        said = stage_table(feedback_table(feedback), "labels")
        version = self.labels.update(lambda stored: upsert(stored, said, "raw_key"), tag)
        named = said.select(F.col("name").alias("entity"), "category", F.col("raw_key").alias("description"))
        # Of several texts of one name the smallest describes it.
        named = complete_feedback(named).groupBy("entity").agg(F.min_by("category", "description").alias("category"), F.min("description").alias("description"))
        self.merchants.update(lambda stored: update_knowledge(stored, named, self.embedder, self.dim), tag)
        model = self.models.trained_on(version)
        if model is None:
            known = self.labels.read(version).select(F.col("raw_key").alias(self.embedder.text), "category")
            model = Categorizer.train(known, self.embedder.text, dim=self.dim)
            self.models.register(model, version)
        return model


def learning_round(
    state: DataFrame, feedback: DataFrame, knowledge: Knowledge, threshold: float = REVIEW_THRESHOLD, tag: str = ""
) -> DataFrame:
    """State after a round: every label known by now first, then the new model's confident predictions."""
    model = knowledge.learn(feedback, tag)
    known = knowledge.labels.read().withColumnRenamed("raw_key", "raw")
    return review_round(state, known, model, threshold)
