"""Incremental statement ingest (STR1)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import generate_splits
from ..operators.quality import split_quarantine
from ..operators.review import PROCESSED
from ..plans.statements import normalize_statements, route_statements
from ..session import list_in_few_tasks, stage_table
from ..sources.files import list_files, local_roots
from ..sources.statements import number_file_lines, read_listed, select_files
from ..sources.tables import VersionedTable

Resolver = Callable[[DataFrame], DataFrame]
LISTING = "statement_id string, modified double"
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def statement_fingerprints(lines: DataFrame) -> DataFrame:
    """(statement_id, fingerprint): equal for files of equal content.

    Line hashes are added up, so partial results are one number per statement.
    """
    line_hash = F.xxhash64("line_no", "line").cast("decimal(20,0)")
    return lines.groupBy("statement_id").agg(
        F.concat_ws("-", F.count(F.lit(1)).cast("string"), F.sum(line_hash).cast("string")).alias("fingerprint")
    )


def first_copies(prints: DataFrame) -> DataFrame:
    """One statement per content, the one with the smallest id."""
    return prints.groupBy("fingerprint").agg(F.min("statement_id").alias("statement_id"))


class Learner(NamedTuple):
    """Merchants that grow while files come in.

    ``feedback`` gives what users have said by now, or None; ``learn`` makes the new merchants of the stored ones
    and the feedback, an upsert by name; ``resolve`` gives (cleaned_description, canonical_name,
    default_category, similarity) of transactions by the merchants.
    """

    merchants: VersionedTable
    feedback: Callable[[], DataFrame | None]
    learn: Callable[[DataFrame, DataFrame], DataFrame]
    resolve: Callable[[DataFrame, DataFrame], DataFrame]

    def take_in(self, batch: str) -> None:
        """Commit the merchants once for each batch; a batch that is run again finds its commit."""
        said = self.feedback()
        # A batch without feedback commits too: run again later, it finds what it knew.
        self.merchants.update(lambda stored: stored if said is None else self.learn(stored, said), tag=batch)


def note_new_files(spark: SparkSession, path: str, listings: str, max_files: int | None = None) -> bool:
    """Write the names of the files that ``listings`` does not have as new Parquet files there, of ``max_files`` names
    at most, the oldest first. False where ``path`` is not in a mounted folder.

    A run that dies half-way leaves listings that are true as they are; the next one adds what they lack.
    """
    roots = local_roots(spark, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(listings)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if roots is None and not store.exists(folder):
        return False
    store.mkdirs(folder)
    if roots is not None:
        noted = spark.read.schema(LISTING).parquet(listings).select("statement_id")
        new = stage_table(list_files(spark, roots).join(noted, "statement_id", "left_anti"), "new-files")
        if max_files:
            new = new.coalesce(1).sortWithinPartitions("modified", "statement_id")
        # An empty listing would make a micro-batch.
        if not new.isEmpty():
            new.write.option("maxRecordsPerFile", max_files or 0).mode("append").parquet(listings)
    return True


def read_new_statements(spark: SparkSession, path: str, max_files: int | None = None, listings: str | None = None) -> DataFrame:
    """(statement_id, content) of the files that are new; ``number_file_lines`` gives a batch's lines.

    Spark's file stream holds all files it has seen in the driver. With a folder ``listings``, which belongs to the
    stream's checkpoint, tasks list a mounted ``path`` and what streams are the listings: the names that are new when this
    is called. Other stores are left to Spark's stream.
    """
    if listings and note_new_files(spark, path, listings, max_files):
        reader = spark.readStream.schema(LISTING)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", 1)
        return read_listed(reader.parquet(listings))
    reader = list_in_few_tasks(spark).readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return select_files(reader.load(path))


class StatementIngest:
    """New files to transactions, ledger, quarantine and review queue.

    Every micro-batch writes its own ``batch`` folder, named by the query's id and
    the batch number, so a repeated batch replaces itself. A file whose content was taken in before is left out
    and listed in ``skipped`` with its fingerprint. A ``Learner`` upserts merchants from what users have said when a
    batch starts and resolves by the version committed for that batch, so a batch run again gives the same.
    """

    def __init__(self, spark: SparkSession, out: str, resolver: Resolver | Learner, mappings: VersionedTable | None = None):
        self.spark, self.out, self.resolver, self.mappings = spark, out.rstrip("/"), resolver, mappings

    def _resolved(self, transactions: DataFrame, batch: str) -> DataFrame:
        if not isinstance(self.resolver, Learner):
            return self.resolver(transactions)
        merchants = self.resolver.merchants
        return self.resolver.resolve(transactions, merchants.read(merchants.log.tagged(batch)))

    def _seen(self, batch: str) -> DataFrame | None:
        if not self._exists("statements"):
            return None
        seen = self.spark.read.parquet(f"{self.out}/statements")
        return seen.filter(F.col("batch") != batch).select("fingerprint")

    def _exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.out}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _write(self, df: DataFrame, name: str, batch: str) -> DataFrame:
        path = f"{self.out}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __call__(self, files: DataFrame, batch_id: int) -> None:
        query_id = self.spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch = f"{query_id}-{batch_id}"
        lines = number_file_lines(files)
        if isinstance(self.resolver, Learner):
            self.resolver.take_in(batch)
        prints = stage_table(statement_fingerprints(lines), "fingerprints")
        fresh = first_copies(prints)
        seen = self._seen(batch)
        if seen is not None:
            fresh = fresh.join(seen, "fingerprint", "left_anti")
        fresh = self._write(fresh, "statements", batch)
        self._write(prints.join(fresh, "statement_id", "left_anti"), "skipped", batch)
        lines = lines.join(fresh.select("statement_id"), "statement_id", "left_semi")
        cached = self.mappings.read() if self.mappings else None
        transactions = self._write(normalize_statements(lines, cached), "transactions", batch)
        state = self._write(route_statements(transactions, self._resolved(transactions, batch)), "state", batch)
        ledger, rejected = split_quarantine(generate_splits(state.filter(F.col("status") == PROCESSED)))
        self._write(ledger, "ledger", batch)
        self._write(rejected, "quarantine", batch)


def ingest_statements(
    spark: SparkSession,
    incoming: str,
    out: str,
    checkpoint: str,
    resolver: Resolver | Learner,
    mappings: VersionedTable | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Take in everything waiting in ``incoming``, then stop."""
    return (
        read_new_statements(spark, incoming, max_files, f"{checkpoint.rstrip('/')}/listings")
        .writeStream.foreachBatch(StatementIngest(spark, out, resolver, mappings))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
