"""Exact top k by inner product, with a three-phase uniform threshold.

A score is the sum of LISTS local scores, one for each run of components. For a
block of queries:

1. Gather: every task takes, for each query, the k best rows of each of its local
   lists, and the k best totals among these. The k-th best over all tasks is a
   score that k rows reach: a safe cutoff for the query.
2. Collect: the cutoffs go to all tasks. A row of that score or more has at least
   one local score of cutoff / LISTS or more, so only such entries are collected;
   a row whose known local scores, with that threshold in place of the others,
   stay below the cutoff goes.
3. Resolve: the remaining local scores of what stays are added, rows below the
   cutoff go, and the k best of each task meet for the ranking.

The queries are a stated set; they go to the tasks in blocks of at most BLOCK_BYTES,
each against one scan of all rows. Components are floor(1024 x). Products of sums
up to 2^53 are exact in doubles; beyond, Python integers are used and the result
is held to the range of a long.

Rows with a null vector or a null or non-finite component take no part. A shorter
vector counts as filled up with 0. Rows that share a query's vec_id are its own and
no candidates; a repeated query row gets its list again, and a repeated candidate row is
listed as often as it occurs. A row without vec_id is a candidate that sorts last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import pieces

LISTS = 4
SCALE = 1024
BLOCK_BYTES = 16 << 20
_CELLS = 1 << 21
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def integers(vector: str) -> Column:
    """floor(1024 x) of every component, as doubles."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))


def usable(vector: str) -> Column:
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & finite


def _matrix(column: pa.ListArray, wide: int) -> np.ndarray:
    at = column.offsets.to_numpy()
    size = np.diff(at)
    out = np.zeros((len(size), wide))
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(at[0], at[-1]) - np.repeat(at[:-1], size)
    values = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    fits = place < wide  # beyond the longest query all products are 0
    out[row[fits], place[fits]] = values[fits]
    return out


class _Block:
    """Some queries: numbers, ids and vectors; later their cutoffs."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.parts = np.array_split(vectors, LISTS, axis=1)
        self.edges = np.cumsum([0] + [p.shape[1] for p in self.parts])
        self.longest = np.abs(vectors).sum(axis=1).max() if len(ids) else 0.0
        self.cutoff = None

    def local(self, rows: np.ndarray) -> list[np.ndarray]:
        """LISTS matrices (queries x rows) of local scores."""
        cut = [rows[:, a:b] for a, b in zip(self.edges, self.edges[1:])]
        if self.longest * (np.abs(rows).max() if rows.size else 0.0) < _EXACT:
            return [p @ c.T for p, c in zip(self.parts, cut)]
        whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
        return [whole(p) @ whole(c).T if p.shape[1] else np.zeros((len(p), len(c)), dtype=object) for p, c in zip(self.parts, cut)]


def _best(query: np.ndarray, ids: np.ndarray, known: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: by score, then smaller id, rows without id last."""
    order = np.lexsort((ids, ~known, -score, query))
    q = query[order]
    begin = np.searchsorted(q, q, side="left")
    return order[np.arange(len(q)) - begin < k]


def _scan(block: _Block, batches: Iterator[pa.RecordBatch], gather: bool) -> Iterator[pa.RecordBatch]:
    """The best entries of one task, few at any time."""
    k, n = block.k, len(block.ids)
    wide, step = block.edges[-1], max(1, _CELLS // n)
    kept = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0)]
    for batch in batches:
        for low in range(0, batch.num_rows, step):
            part = batch.slice(low, step)
            known = np.asarray(part.column(0).is_valid())
            ids = part.column(0).fill_null(0).to_numpy()
            lists = block.local(_matrix(part.column(1), wide))
            own = (block.ids[:, None] == ids[None, :]) & known
            if gather:
                take = np.zeros(own.shape, dtype=bool)
                for scores in lists:
                    scores = np.where(own, -np.inf, scores) if scores.dtype != object else scores
                    top = np.argpartition(scores, max(0, scores.shape[1] - k), axis=1)[:, -k:]
                    take[np.arange(n)[:, None], top] = True
            else:
                threshold = block.cutoff / LISTS
                take, bound = np.zeros(own.shape, dtype=bool), 0.0
                for scores in lists:
                    high = scores >= threshold[:, None]
                    take |= high
                    bound = bound + np.where(high, scores, threshold[:, None])
                take &= bound + 1e-6 * (1 + np.abs(bound)) >= block.cutoff[:, None]
            q, r = np.nonzero(take & ~own)
            total = sum(scores[q, r] for scores in lists)
            if not gather:
                reach = np.asarray(total >= block.cutoff[q], dtype=bool)
                q, r, total = q[reach], r[reach], total[reach]
            kept = [np.concatenate([a, b]) for a, b in zip(kept, (q, ids[r], known[r], total))]
            best = _best(*kept, k)
            kept = [x[best] for x in kept]
    scores = [max(-_LONG - 1, min(_LONG, int(x))) for x in kept[3]]
    yield pa.record_batch([pa.array(kept[0]), pa.array(kept[1], mask=~kept[2]), pa.array(scores, pa.int64())], names=["q", "vec_id", "score"])


def _ranked(entries: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return entries.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _query_blocks(queries: DataFrame, k: int) -> Iterator[_Block]:
    """The queries, a bounded block at a time."""
    size = queries.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for part in range(n):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == part).orderBy("vec_id", "v").collect()
        if rows:
            wide = max(1, max(len(r.v) for r in rows))
            yield _Block(np.array([r.vec_id for r in rows], dtype=np.int64), np.array([r.v + [0.0] * (wide - len(r.v)) for r in rows]), k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of each row that ``is_query`` marks (over columns vec_id, v)."""
    rows = vectors.filter(usable(vector)).select(F.col(vec_id).cast("long").alias("vec_id"), integers(vector).alias("v"))
    out = None
    for block in _query_blocks(rows.filter(is_query), k):
        share = rows.sparkSession.sparkContext.broadcast
        first = share(block)
        gathered = rows.mapInArrow(lambda batches, b=first: _scan(b.value, batches, True), "q long, vec_id long, score long")
        safe = _ranked(gathered, k).groupBy("q").agg(F.min("score").alias("cutoff"), F.count("*").alias("n")).collect()
        block.cutoff = np.full(len(block.ids), -np.inf)
        for r in safe:
            if r.n == k:
                block.cutoff[r.q] = r.cutoff
        second = share(block)
        found = _ranked(rows.mapInArrow(lambda batches, b=second: _scan(b.value, batches, False), "q long, vec_id long, score long"), k)
        ids = rows.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(block.ids)], "q long, query_id long")
        part = found.join(ids, "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).filter("false")
