"""Reading raw statements as ordered lines (SRC1, SRC2) and dense numbering.

A statement file may be larger than any executor, so only small files are read
whole: Spark splits the others, and exact line numbers come from the line counts of
the splits. Lines are laid out once, in buckets of statement and chunk.
"""

from __future__ import annotations

import os
import re
import sys
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import list_in_few_tasks, stage_bucketed
from .files import list_files, local_roots, read_small

# The functions below that run inside tasks travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINE_BREAK = r"\r\n|\n|\r"
BOM = b"\xef\xbb\xbf"
#: Larger files, in bytes, are split.
SMALL_FILE = 1 << 20
#: What Hadoop would read as a pattern in the name of a file.
GLOB = re.compile(r"[{}\[\]*?\\]")
#: What Spark writes as %XX in the name of a partition's folder, and the folder of null.
ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def write_statements(lines: DataFrame, path: str) -> None:
    """Write lines(statement_id, line_no, line) as one text file for each statement, in a folder ``statement_id=...`` of its own.

    Hadoop's local file system starts ``chmod`` several times for each file, which takes longer than all the rest; where
    ``path`` is in a mounted folder, tasks write the files themselves. A file gets its name when it is complete, and the
    same one when a task is run again. Other stores are left to Spark's writer.
    """
    spark = lines.sparkSession
    dealt = lines.repartition("statement_id").sortWithinPartitions("statement_id", "line_no").select(F.col("statement_id").cast("string"), "line")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        dealt.write.partitionBy("statement_id").text(path)
        return
    root = target.toUri().getPath()
    os.makedirs(root)
    dealt.mapInArrow(lambda batches: _write_files(batches, root), "files bigint").write.format("noop").mode("overwrite").save()


def _write_files(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    files = 0
    for statement_id, group in groupby(rows, key=itemgetter(0)):
        name = ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", statement_id) if statement_id else NULL_FOLDER
        folder = f"{root}/statement_id={name}"
        os.makedirs(folder, exist_ok=True)
        # Spark's readers pass over names that begin with a dot.
        open_file = f"{folder}/.{uuid.uuid4().hex}"
        with open(open_file, "w", encoding="utf-8", newline="") as out:
            out.writelines(f"{line or ''}\n" for _, line in group)
        os.replace(open_file, f"{folder}/part-0.txt")
        files += 1
    yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])


def packed_endings(spark: SparkSession) -> list[str]:
    """Endings of the names of files that Hadoop unpacks when it reads their lines."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    codecs = hadoop.io.compress.CompressionCodecFactory.getCodecClasses(conf)
    return sorted({hadoop.util.ReflectionUtils.newInstance(c, conf).getDefaultExtension() for c in codecs})


def small_file(spark: SparkSession) -> int:
    """Bytes up to which a file is read in one piece: ``SMALL_FILE`` or the size of Spark's splits."""
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return min(SMALL_FILE, split)


def read_listed(files: DataFrame) -> DataFrame:
    """``select_files`` of ``list_files``, read by tasks."""
    spark = files.sparkSession
    return read_small(files, small_file(spark), packed_endings(spark))


def select_files(files: DataFrame) -> DataFrame:
    """(statement_id, content) of Spark's ``binaryFile``; null for packed files and for those over ``small_file``
    bytes, which are not read here."""
    spark = files.sparkSession
    limit = small_file(spark)
    named = files.select(F.col("_metadata.file_path").alias("statement_id"), "path", "length", "content")
    packed = reduce(lambda a, b: a | b, [F.lower("path").endswith(e) for e in packed_endings(spark)], F.lit(False))
    whole = named.filter(F.col("length") <= limit).filter(~packed).select("statement_id", "content")
    others = named.filter((F.col("length") > limit) | packed)
    return whole.unionByName(others.select("statement_id", F.lit(None).cast("binary").alias("content")))


def _place(pieces: DataFrame) -> DataFrame:
    """(statement_id, chunk, position, line) from (statement_id, block_start, line) in scan order."""
    return pieces.select("statement_id", F.col("block_start").cast("bigint").alias("chunk"), F.monotonically_increasing_id().alias("position"), "line")


def stage_lines(files: DataFrame) -> DataFrame:
    """Lines of all ``select_files`` in buckets of statement and split, each with its position in scan order.

    Lines that were read already, (statement_id, block_start, line) in scan order, are laid out as they are.
    Spark's text reader takes some 3 ms of a task for each file, far longer than to read a small one. Small files
    come as one value each and are cut where Hadoop cuts; the others are left to the text reader, which splits or
    unpacks them. Latin-1 has a character for every byte, so bytes that are no UTF-8 stay.
    """
    spark, keys = files.sparkSession, ["statement_id", "chunk"]
    if "line" in files.columns:
        return stage_bucketed(_place(files), "lines", keys)
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), r"\A" + BOM.decode("ISO-8859-1"), "")
    parts = F.split(F.regexp_replace(text, "(?:" + LINE_BREAK + r")\z", ""), LINE_BREAK, -1)
    other = F.array(F.lit(None).cast("string"))
    filled = files.filter(F.col("content").isNull() | ~F.col("content").isin(bytearray(), bytearray(BOM)))
    cut = filled.select("statement_id", F.lit(0).alias("block_start"), F.explode(F.when(F.col("content").isNull(), other).otherwise(parts)).alias("line"))
    placed = stage_bucketed(_place(cut.withColumn("line", F.encode("line", "ISO-8859-1").cast("string"))), "lines", keys)
    jvm = spark._jvm
    others = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r[0])).toString() for r in placed.filter("line is null").select("statement_id").collect()]
    if not others:
        return placed
    read = list_in_few_tasks(spark).read.option("recursiveFileLookup", "true").text([GLOB.sub(r"\\\g<0>", p) for p in others])
    pieces = read.select(F.col("_metadata.file_path").alias("statement_id"), F.col("_metadata.file_block_start").alias("block_start"), F.col("value").alias("line"))
    return stage_bucketed(placed.filter("line is not null").unionByName(_place(pieces)), "lines", keys)


def read_statements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """lines(statement_id, line_no, line, chunk) of all text files under ``path``.

    In a mounted folder tasks list and read the files, so the driver does not hold their names. Other stores are
    left to Spark's reader, whose listing is in the driver.
    """
    roots = local_roots(spark, path)
    if roots is not None:
        return number_file_lines(read_listed(list_files(spark, roots)))
    files = list_in_few_tasks(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return number_file_lines(select_files(files))


def number_file_lines(files: DataFrame) -> DataFrame:
    """lines(statement_id, line_no, line, chunk) of ``select_files`` or of lines as ``stage_lines`` takes them.

    Inside a split the row position counts lines one by one, so a line's number
    is the number of lines in the earlier splits of its file plus its offset in
    its own split. The lines are read and written once (``stage_lines``); one small row per split
    is summed up in order and meets them there. The
    split stays as ``chunk``: all later steps join and group on it in place.
    """
    placed = stage_lines(files)
    blocks = placed.groupBy("statement_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first_position"))
    before = Window.partitionBy("statement_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("statement_id", "chunk", "first_position", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    line_no = F.col("offset") + F.col("position") - F.col("first_position")
    return placed.join(offsets, ["statement_id", "chunk"]).select(
        "statement_id",
        line_no.cast("bigint").alias("line_no"),
        F.when(line_no == 0, F.ltrim(F.col("line"), F.lit("\ufeff"))).otherwise(F.col("line")).alias("line"),
        "chunk",
    )


def lines_from_content(df: DataFrame, statement_id: str, content: str) -> DataFrame:
    """lines(...) of statements held as one text each; empty text has no lines."""
    text = F.regexp_replace(F.col(content), "(?:" + LINE_BREAK + r")\z", "")
    return (
        df.filter(F.col(content) != "")
        .select(F.col(statement_id).alias("statement_id"), F.posexplode(F.split(text, LINE_BREAK, -1)))
        .select("statement_id", F.col("pos").cast("bigint").alias("line_no"), F.col("col").alias("line"))
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "row_number", width: int = 1 << 20
) -> DataFrame:
    """Dense 1-based numbers per key in ``order`` (a whole number, unique in a key).

    A key may hold most of the rows: the rows of a key are cut into ranges of
    ``width`` order values, numbered inside their range, and shifted by the
    counts of the earlier ranges.
    """
    keys = list(keys)
    ranged = df.withColumn("_range", F.floor(F.col(order) / width))
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    return (
        ranged.withColumn("_inside", F.row_number().over(inside))
        .join(shifts, [*keys, "_range"])
        .withColumn(name, (F.col("_shift") + F.col("_inside")).cast("bigint"))
        .drop("_range", "_inside", "_shift")
    )
