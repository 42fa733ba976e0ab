"""Listing and reading files in a mounted folder inside tasks.

Spark's file sources hold every file they list in the driver's memory, some kilobytes each. Here names
pass from task to task as rows; the driver holds the roots only.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from contextlib import suppress
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_table

# The functions below that run inside tasks travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTED = "statement_id string, modified double, folder boolean"
CONTENT = "statement_id string, content binary"
#: Folders that a task lists below one it was given, before it hands on the others.
FOLDERS_AT_ONCE = 1000
ROWS_AT_ONCE = 10_000
BYTES_AT_ONCE = 8 << 20
#: What java.net.URI leaves as it is in a path.
PLAIN = re.compile(r"[A-Za-z0-9_\-!.~'()*,;:$&+=/@]*\Z")


def local_roots(spark: SparkSession, path: str | list[str]) -> list[str] | None:
    """The files and folders that ``path`` names, patterns resolved; None unless all are there, in a mounted folder."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    roots = []
    for name in [path] if isinstance(path, str) else path:
        named = hadoop.Path(name)
        store = named.getFileSystem(conf)
        if store.getUri().getScheme() != "file":
            return None
        found = store.globStatus(store.makeQualified(named))
        if not found or any(store.exists(hadoop.Path(status.getPath(), "_spark_metadata")) for status in found):
            return None
        roots += [status.getPath().toUri().getPath() for status in found]
    return roots


def list_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(statement_id, modified) of all files in ``roots``: the URI that Spark gives them and seconds since 1970.

    Names that Spark passes over are left out. Each round lists the folders that the one before handed on.
    """
    tasks = 4 * spark.sparkContext.defaultParallelism
    found, level = [], spark.createDataFrame([(_uri(r), 0.0, not os.path.isfile(r)) for r in roots], LISTED)
    while True:
        # A root that is a file keeps the rules for names.
        named = level.filter(~F.col("folder"))
        found.append(named if found else named.filter(~F.element_at(F.split("statement_id", "/"), -1).rlike(r"^(\.|_[^=]*$)|\._COPYING_$")))
        waiting = level.filter("folder")
        if waiting.isEmpty():
            break
        level = stage_table(waiting.repartition(tasks, "statement_id").mapInArrow(_list_folders, LISTED), "listing")
    files = found[0]
    for more in found[1:]:
        files = files.unionByName(more)
    files = files.select("statement_id", "modified")
    return files.dropDuplicates(["statement_id"]) if len(roots) > 1 else files


def read_small(files: DataFrame, limit: int, packed: list[str]) -> DataFrame:
    """(statement_id, content) of ``list_files``; null for files over ``limit`` bytes and names that end like ``packed``."""
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    dealt = files.select("statement_id").repartition(tasks, "statement_id")
    return dealt.mapInArrow(lambda batches: _read_files(batches, limit, tuple(packed)), CONTENT)


def _uri(path: str) -> str:
    """``path`` as java.net.URI writes it."""
    if PLAIN.match(path):
        return f"file:{path}"
    quoted = []
    for c in path:
        odd = not PLAIN.match(c) if c < "\x80" else "\udc80" <= c <= "\udcff" or unicodedata.category(c) in ("Cc", "Zs", "Zl", "Zp")
        quoted.append("".join(f"%{b:02X}" for b in os.fsencode(c)) if odd else c)
    return "file:" + "".join(quoted)


def _path(uri: str) -> bytes:
    return unquote_to_bytes(uri.removeprefix("file:"))


def _passed_over(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("statement_id", pa.string()), ("modified", pa.float64()), ("folder", pa.bool_())])
    out: list[tuple[str, float, bool]] = []
    rows = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            waiting, listed = [os.fsdecode(_path(uri))], 0
            while waiting and listed < FOLDERS_AT_ONCE:
                listed += 1
                with os.scandir(waiting.pop()) as entries:
                    for entry in entries:
                        if _passed_over(entry.name):
                            continue
                        if entry.is_dir():
                            if len(waiting) < FOLDERS_AT_ONCE:
                                waiting.append(entry.path)
                            else:
                                out.append((_uri(entry.path), 0.0, True))
                        elif entry.is_file():
                            with suppress(FileNotFoundError):  # a file may go meanwhile
                                out.append((_uri(entry.path), entry.stat().st_mtime, False))
                        if len(out) >= ROWS_AT_ONCE:
                            yield rows()
                            out.clear()
            out += [(_uri(folder), 0.0, True) for folder in waiting]
    if out:
        yield rows()


def _read_files(batches: Iterator[pa.RecordBatch], limit: int, packed: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("statement_id", pa.string()), ("content", pa.binary())])
    ids: list[str] = []
    contents: list[bytes | None] = []
    rows = lambda: pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(contents, pa.binary())], schema=schema)
    size = 0
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            path, content = _path(uri), None
            if not os.fsdecode(path).lower().endswith(packed):
                with open(path, "rb") as file:
                    content = file.read(limit + 1)
                if len(content) > limit:
                    content = None
            ids.append(uri)
            contents.append(content)
            size += len(content or b"")
            if size >= BYTES_AT_ONCE or len(ids) >= ROWS_AT_ONCE:
                yield rows()
                ids.clear()
                contents.clear()
                size = 0
    if ids:
        yield rows()
