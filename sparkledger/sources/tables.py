"""Small knowledge tables kept as versioned parquet folders (SRC7-SRC9, KNW1)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text_fields(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


POLARITY_TYPE = T.StructType(
    _text_fields("type", "direction_col", "outgoing_value", "incoming_value", "credit_col", "debit_col")
)
MAPPING_TYPE = T.StructType(
    [
        *_text_fields("date_col", "amount_col", "desc_col", "decimal_separator"),
        T.StructField("polarity", POLARITY_TYPE),
    ]
)
MAPPINGS_SCHEMA = T.StructType([T.StructField("header_hash", T.StringType()), T.StructField("mapping", MAPPING_TYPE)])


class CommitLog:
    """Numbered commits of a folder, each the name of a subfolder that is written in full.

    A number is taken by creating its file exclusively, so of two writers with the same base
    one wins and the other sees that it must start again from the newer one. A commit may carry a
    ``tag``, such as a micro-batch: what has been committed under it is not committed again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        folder = self._path("")
        self._fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(self._path(""))]
        return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith("commit="))

    def entry(self, version: int) -> tuple[str, str]:
        """(subfolder, tag) of a commit."""
        stream = self._fs.open(self._path(f"commit={version}"))
        try:
            folder, _, tag = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").partition("\n")
        finally:
            stream.close()
        return folder, tag

    def tagged(self, tag: str) -> int | None:
        """The version committed under ``tag``."""
        return next((v for v in reversed(self.versions()) if self.entry(v)[1] == tag), None)

    def commit(self, version: int, folder: str, tag: str = "") -> bool:
        """Take ``version`` for ``folder``; false if another writer has it."""
        try:
            stream = self._fs.create(self._path(f"commit={version}"), False)
        except Py4JJavaError:
            if self._fs.exists(self._path(f"commit={version}")):
                return False
            raise
        stream.write(bytearray(f"{folder}\n{tag}".encode()))
        stream.close()
        return True


class VersionedTable:
    """A small table of which every write is a new version; readers take the newest commit.

    A job that dies half-way leaves the last good version in place. ``update`` makes the
    new version from the newest; when another writer commits in between, it is made again from theirs, so
    no change is lost.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.log = CommitLog(spark, path)

    def versions(self) -> list[int]:
        return self.log.versions()

    def read(self, version: int | None = None) -> DataFrame:
        versions = self.versions()
        if version is None and not versions:
            return self.spark.createDataFrame([], self.schema)
        folder, _ = self.log.entry(versions[-1] if version is None else version)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}")

    def write(self, df: DataFrame) -> int:
        """A version that does not build on the one before."""
        return self.update(lambda _: df)

    def update(self, change: Callable[[DataFrame], DataFrame], tag: str = "") -> int:
        """Commit ``change`` of the newest version; under a ``tag`` only once."""
        columns = [F.col(f.name).cast(f.dataType) for f in self.schema.fields]
        while True:
            done = self.log.tagged(tag) if tag else None
            if done is not None:
                return done
            base = (self.versions() or [0])[-1]
            folder = f"data-{uuid.uuid4().hex}"
            change(self.read(base) if base else self.read()).select(*columns).write.parquet(f"{self.path}/{folder}")
            if self.log.commit(base + 1, folder, tag):
                return base + 1


def upsert(
    current: DataFrame, changes: DataFrame, key: str | Sequence[str], version: str | None = None
) -> DataFrame:
    """Insert or replace by key: a change wins over the stored row.

    Several changes of one key are settled by the highest ``version`` column.
    """
    keys = [key] if isinstance(key, str) else list(key)
    columns = current.columns
    rank = lambda new, v: F.struct(F.lit(new).alias("new"), v.cast("bigint").alias("v")).alias("_rank")
    stored = current.select(*columns, rank(0, F.lit(0)))
    fresh = changes.select(*columns, rank(1, F.col(version) if version else F.lit(0)))
    rest = [c for c in columns if c not in keys]
    return (
        stored.unionByName(fresh)
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col("_rank")).alias("_row"))
        .select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in columns])
    )


def read_mappings(table: VersionedTable) -> DataFrame:
    return table.read()


def save_mappings(table: VersionedTable, mapped: DataFrame) -> int:
    """Insert or replace the mappings of all header hashes in ``mapped``."""
    fresh = mapped.groupBy("header_hash").agg(F.max("mapping").alias("mapping"))
    return table.update(lambda stored: upsert(stored, fresh, "header_hash"))
