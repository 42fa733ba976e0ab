"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_DEFAULT = 10_000
OPEN_COST = "spark.sql.files.openCostInBytes"


def build_session(app: str = "sparkledger", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime options results depend on (dates are read in UTC)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def list_in_few_tasks(spark: SparkSession) -> SparkSession:
    """Let file listings run as a few tasks for each core, and one task read up to a thousand small files.

    Spark makes a task for each folder, up to 10,000, and starting a task takes far longer than reading a folder
    of one file. It takes opening a file for as much work as reading 4 MB, which makes a task for 32 files. Numbers that
    were set are kept. A stream reads by its session's settings after it has started, so they stay.
    """
    if spark.conf.get(OPEN_COST, None) is None:
        spark.conf.set(OPEN_COST, 128 * 1024)
    if int(spark.conf.get(LISTING_TASKS)) == LISTING_DEFAULT:
        spark.conf.set(LISTING_TASKS, 4 * spark.sparkContext.defaultParallelism)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. In local mode one is made where none is named;
    on a cluster that is an error, as executors would write to their own disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sparkledger-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: work that several
    later steps need is done once, and lost executors do not repeat it."""
    path = f"{shared_dir(df.sparkSession)}/stage/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``keys`` and read it back.

    Joins, windows and groups on the keys then read the buckets where they are; only
    the other side of a join is shuffled to meet them. This is a table of the session's
    catalog with files of its own; it is not dropped, as plans read it later.
    """
    spark = df.sparkSession
    table = f"sparkledger_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/stage/{table}"
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).option("path", path).saveAsTable(table)
    return spark.table(table)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors, once for each application.

    Functions that run in tasks are imported there by name; without this (or
    ``--py-files``) executors that lack the package fail on import.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="sparkledger-src-"), "sparkledger.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(root)))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark
