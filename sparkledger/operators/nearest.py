"""Nearest merchant by cosine similarity (JON1, SRT1, FEA2).

Exact. Merchants of one block go to every task, where each batch of queries meets them in place. More
of them are shuffled in one job instead: queries are dealt into as many chunks as there are cores, or more where a chunk
would not fit a task, and all merchants pass by each chunk in the order of their names, an Arrow batch at a
time. A task holds its chunk, the best of each of its queries so far, and one batch.

Within a block most products are never finished. The first part of the components gives a
partial product, and the norms of the remaining components bound what the rest can add; only
pairs that may reach the threshold, or a query's best so far, are multiplied in full.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import RESOLVE_THRESHOLD
from ..functions.vectors import has_dimension
from ..session import stage_table

# The functions below run inside tasks. They travel with the job, so executors
# need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BROADCAST_BYTES = 64 << 20
#: Vectors of the queries that a task holds where merchants pass by, and how many queries are compared at once.
CHUNK_BYTES = 32 << 20
SLICE = 2048
#: Merchants that are compared at once, and the part of the components that is multiplied first.
STRIP = 1024
HEAD = 0.25
#: Room for rounding in the bound; similarities count to nine digits.
SLACK = 1e-8


def split_by_dimension(df: DataFrame, vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the right dimension, rows to report)."""
    right = has_dimension(F.col(vector), dim)
    return df.filter(right), df.filter(~right)


def _unit(vectors: pd.Series) -> np.ndarray:
    return _unit_rows(np.stack(vectors.to_numpy()).astype(np.float64))


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm > 0, norm, np.nan)


def best_in_block(
    queries: np.ndarray, block: np.ndarray, threshold: float, known: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, int]:
    """Row number of each query's best vector in ``block`` (-1 for none), its similarity, and how many pairs were multiplied in full.

    Both sides are unit vectors (nan: none). Merchants come sorted by name, so the first of equal
    similarities, to 9 digits, is the smallest name. ``known`` has each query's best of earlier blocks, which is
    given back where this block has none above it.
    """
    head = max(1, int(block.shape[1] * HEAD))
    queries, block = np.nan_to_num(queries), np.nan_to_num(block)
    usable_q, usable_m = queries.any(axis=1), np.flatnonzero(block.any(axis=1))
    # The norm of the rest as one more component: a product is then the bound itself.
    bound_q, bound_m = (np.column_stack([x[:, :head], np.linalg.norm(x[:, head:], axis=1)]) for x in (queries, block))
    place, best, full = np.full(len(queries), -1), np.full(len(queries), -np.inf) if known is None else known.copy(), 0
    for low in range(0, len(usable_m), STRIP):
        strip = usable_m[low : low + STRIP]
        floor = np.where(usable_q, np.maximum(best, threshold) - SLACK, np.inf)
        may = bound_q @ bound_m[strip].T >= floor[:, None]
        rows, columns = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        if not len(rows):
            continue
        full += len(rows) * len(columns)
        sims = np.round(queries[rows] @ block[strip[columns]].T, 9)
        sims[~may[np.ix_(rows, columns)] | (sims < threshold)] = -np.inf
        at = sims.argmax(axis=1)
        top = sims[np.arange(len(at)), at]
        better = top > best[rows]
        best[rows[better]] = top[better]
        place[rows[better]] = strip[columns[at[better]]]
    return place, best, full


def nearest_merchant(
    queries: DataFrame,
    merchants: DataFrame,
    dim: int,
    threshold: float = RESOLVE_THRESHOLD,
    key: str = "query_id",
    vector: str = "vector",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(key, canonical_name, default_category, similarity) of queries with a hit, one row for each query row.

    ``merchants`` is (canonical_name, default_category, vector_embedding). Rows
    of another dimension take no part; ``split_by_dimension`` reports them. Up to ``broadcast_bytes`` of
    merchants, names and categories included, go to every task; more are shuffled.
    """
    asked, _ = split_by_dimension(queries.select(key, vector), vector, dim)
    known, _ = split_by_dimension(merchants.select("canonical_name", "default_category", "vector_embedding"), "vector_embedding", dim)
    texts = F.length("canonical_name") + F.coalesce(F.length("default_category"), F.lit(0))
    rows, size = known.agg(F.count(F.lit(1)), F.sum(texts.cast("bigint") + 8 * dim + 32)).first()
    blocks = min(rows, -(-(size or 0) // max(1, broadcast_bytes))) or 1
    if blocks == 1:
        return _compare(asked, known, threshold, key, vector)
    return _compare_chunks(asked, known, dim, threshold, key, vector)


def _compare_chunks(
    queries: DataFrame, merchants: DataFrame, dim: int, threshold: float, key: str, vector: str
) -> DataFrame:
    """``_compare`` with any number of merchants, in one job: all of them pass by each chunk of the queries, an Arrow batch at a time."""
    spark = queries.sparkSession
    # Staged, as the row number of a query must be the same when a task is run again.
    asked = stage_table(queries.withColumn("_row", F.monotonically_increasing_id()), "questions")
    rows = asked.count()
    chunks = max(-(-rows * 8 * dim // CHUNK_BYTES), min(spark.sparkContext.defaultParallelism, -(-rows // SLICE)), 1)
    names = ["canonical_name", "default_category"]
    kind, absent = asked.schema[key].dataType, [F.lit(None).cast("string").alias(c) for c in names]
    dealt = asked.select(
        F.pmod(F.xxhash64("_row"), F.lit(chunks)).cast("int").alias("_chunk"), F.lit(0).alias("_kind"),
        F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_vector"), *absent,
    )
    passing = merchants.select(
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk"), F.lit(1).alias("_kind"),
        F.lit(None).cast(kind).alias("_key"), F.col("vector_embedding").cast("array<double>").alias("_vector"), *names,
    )
    met = dealt.unionByName(passing).repartitionById(chunks, "_chunk")
    met = met.sortWithinPartitions("_chunk", "_kind", F.asc_nulls_last("canonical_name"))
    schema = f"_key {kind.simpleString()}, canonical_name string, default_category string, similarity double"
    compare = lambda batches: _stream_chunks(batches, dim, threshold)
    return met.mapInArrow(compare, schema).withColumnRenamed("_key", key)


def _stream_chunks(batches: Iterator[pa.RecordBatch], dim: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Best merchant of each query, of rows in the order of chunk, queries before merchants."""
    held: _Chunk | None = None
    for batch in batches:
        runs = batch.column("_chunk").to_numpy().astype(np.int64) * 2 + batch.column("_kind").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1), len(runs)]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            part, number, is_merchants = batch.slice(low, high - low), int(runs[low]) // 2, runs[low] % 2
            if held is None or held.number != number:
                if held is not None:
                    yield from held.found()
                held = _Chunk(number)
            if is_merchants:
                held.meet(part, dim, threshold)
            else:
                held.hold(part, dim)
    if held is not None:
        yield from held.found()


def _vectors(part: pa.RecordBatch, dim: int) -> np.ndarray:
    flat = part.column("_vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit_rows(flat.reshape(-1, dim))


class _Chunk:
    """Queries of one chunk in slices, with the best of each so far."""

    def __init__(self, number: int):
        self.number = number
        self.slices: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def hold(self, part: pa.RecordBatch, dim: int) -> None:
        vectors = _vectors(part, dim)
        for low in range(0, len(vectors), SLICE):
            some = vectors[low : low + SLICE]
            texts = [np.full(len(some), None, dtype=object) for _ in range(2)]
            self.slices.append((part.column("_key").slice(low, len(some)), some, np.full(len(some), -np.inf), *texts))

    def meet(self, part: pa.RecordBatch, dim: int, threshold: float) -> None:
        block = _vectors(part, dim)
        texts = [part.column(c).to_numpy(zero_copy_only=False) for c in ("canonical_name", "default_category")]
        for _, vectors, best, *chosen in self.slices:
            place, top, _ = best_in_block(vectors, block, threshold, best)
            hit = place >= 0
            best[hit] = top[hit]
            for mine, theirs in zip(chosen, texts):
                mine[hit] = theirs[place[hit]]

    def found(self) -> Iterator[pa.RecordBatch]:
        for keys, _, best, names, categories in self.slices:
            hit = np.isfinite(best)
            columns = [keys.filter(pa.array(hit)), pa.array(names[hit], pa.string()), pa.array(categories[hit], pa.string()), pa.array(best[hit], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "canonical_name", "default_category", "similarity"])


def _compare(queries: DataFrame, merchants: DataFrame, threshold: float, key: str, vector: str) -> DataFrame:
    """(key, canonical_name, default_category, similarity) of queries with a hit among a block of merchants, which goes to every task."""
    table = merchants.toPandas().sort_values("canonical_name", ignore_index=True)
    schema = f"`{key}` {queries.schema[key].dataType.simpleString()}, canonical_name string, default_category string, similarity double"
    if table.empty:
        return queries.sparkSession.createDataFrame([], schema)
    shared = queries.sparkSession.sparkContext.broadcast(
        (table["canonical_name"].to_numpy(), table["default_category"].to_numpy(), _unit(table["vector_embedding"]))
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, categories, matrix = shared.value
        for batch in batches:
            if len(batch):
                place, best, _ = best_in_block(_unit(batch[vector]), matrix, threshold)
                hit = place >= 0
                found = {"canonical_name": names[place[hit]], "default_category": categories[place[hit]], "similarity": best[hit]}
                yield pd.DataFrame({key: batch[key].to_numpy()[hit], **found})

    return queries.mapInPandas(compare, schema)
