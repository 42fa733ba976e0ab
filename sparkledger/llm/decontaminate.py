"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit distance.

Distance is counted in words, lower-cased A-Z. A document is contaminated by an
item of L words if one of its windows of L words (the whole text, if shorter)
is at most EDIT_SHARE * L word edits away from it.

1. Windows: a window within k edits of an item shares L - q + 1 - k q of its
   q-word runs, so only windows with that many runs go on. This loses nothing.
2. CGK: each window takes random walks that step on or stay by a hash of step
   and word; edit distance becomes Hamming distance between the walks' outputs.
3. LSH: each of REPEATS walks is sampled at BITS places, all of which a walk reaches
   before its last word but for a small chance; a window meets an item if all samples of
   one walk agree, and a walk that is at its end agrees with nothing.
4. Verification: the exact edit distance decides.

The items go to every task in blocks of at most BLOCK_WORDS words; documents are
scanned once for each block and never shuffled. Items without words match nothing.
Items below 6 words must occur exactly. Null texts hold no passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, mix, pieces, runs

EDIT_SHARE = 0.2
#: With these, a window at the largest distance meets its item with a chance of 0.99 or more, and an
#: unrelated one with a chance below 0.05 (both measured on the LSH alone in the tests, 8 to 400 words).
REPEATS, BITS = 96, 2
GRAM = 3
BLOCK_WORDS = 1_000_000
_FILTER_BITS = 20
_UNIFORM = (mix(np.arange(1, REPEATS * BITS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).reshape(REPEATS, BITS) / 2.0**53
_WALK = mix(np.arange(7, REPEATS + 7, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_END = np.uint64(0)
#: Cells of a table of windows.
_CELLS = 1 << 17


def walk(text: np.ndarray, size: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Samples (REPEATS x BITS x windows) of the walks over windows; 0 where a walk is at its end.

    ``text`` (windows x longest) holds word hashes, ``size`` the words of each. A walk over ``steps``
    words has about twice as many places; samples keep two standard deviations off its end.
    """
    n = len(text)
    at = np.zeros((REPEATS, n), dtype=np.int64)
    places = np.maximum(1, 2 * steps - 2 * np.sqrt(2 * steps)).astype(np.int64)
    wanted = (_UNIFORM[:, :, None] * places).astype(np.int64)
    out = np.zeros((REPEATS, BITS, n), dtype=np.uint64)
    column = np.arange(n)
    padded = np.concatenate([text, np.zeros((n, 1), dtype=np.uint64)], axis=1)
    for step in range(int(wanted.max()) + 1 if n else 0):
        word = np.where(at < size, padded[column, np.minimum(at, size)], _END)
        take = wanted == step
        if take.any():
            out = np.where(take, word[:, None, :], out)
        at += (mix(word ^ (_WALK[:, None] + np.uint64(step))) >> np.uint64(63)).astype(np.int64)
    return out


def meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which windows have all samples of one walk in common."""
    return ((a == b) & (a != _END)).all(axis=1).any(axis=0)


def alike(size: np.ndarray) -> Iterator[np.ndarray]:
    """Places of sizes in groups that are at most twice as long as each other, of a bounded table each: none is filled up to a far longer one."""
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        low = max(1, int(size[order[at]]))
        end = int(np.searchsorted(size[order], 2 * low, side="left"))
        end = min(end, at + max(1, _CELLS // (2 * low)))
        yield order[at : max(end, at + 1)]
        at = max(end, at + 1)


def edits(windows: np.ndarray, size: np.ndarray, items: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Word edit distance of window i (its first ``size`` words) and item i (its first ``length``)."""
    n, wide = windows.shape
    column = np.arange(wide + 1)
    row = np.broadcast_to(column, (n, wide + 1)).copy()
    done = np.where(length == 0, size, 0)
    for i in range(items.shape[1]):
        step = np.empty_like(row)
        step[:, 0] = i + 1
        step[:, 1:] = np.minimum(row[:, :-1] + (windows != items[:, i : i + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(step - column, axis=1) + column
        last = length == i + 1
        done[last] = row[last, size[last]]
    return done


class Items:
    """A block of benchmark items as arrays, with the postings of their word runs."""

    def __init__(self, ids: list, texts: list[str]):
        words = Words(pa.array(texts, pa.string()), lower=True)
        self.ids, self.first, self.hash = ids, words.first, words.hash
        size = words.counts
        self.size = size
        self.gram = np.minimum(GRAM, size)
        self.most = np.where(size > 0, np.minimum((EDIT_SHARE * size).astype(np.int64), (size - self.gram) // np.maximum(1, self.gram)), 0)
        self.least = size - self.gram + 1 - self.most * self.gram
        self.postings = {}
        for q in range(1, GRAM + 1):
            grams, counts = words.grams(q)
            item = np.repeat(np.arange(len(size)), counts)
            keep = self.gram[item] == q
            grams, item = grams[keep], item[keep]
            order = np.lexsort((item, grams))
            grams, item = grams[order], item[order]
            if len(grams):
                new = np.ones(len(grams), dtype=bool)
                new[1:] = (grams[1:] != grams[:-1]) | (item[1:] != item[:-1])
                grams, item = grams[new], item[new]
                keys, begin = np.unique(grams, return_index=True)
                maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
                maybe[keys >> np.uint64(64 - _FILTER_BITS)] = True
                self.postings[q] = keys, np.append(begin, len(grams)), item, maybe
        self.samples = np.zeros((REPEATS, BITS, len(size)), dtype=np.uint64)
        for part in alike(size):
            self.samples[:, :, part] = walk(self.words(part), size[part], size[part])

    def words(self, items: np.ndarray) -> np.ndarray:
        return table(self.hash, self.first[items], self.size[items])

    def candidates(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first word in the batch) of every window that shares enough runs with an item."""
        found = []
        for q, (keys, begin, item, maybe) in self.postings.items():
            grams, counts = words.grams(q)
            at = np.flatnonzero(maybe[grams >> np.uint64(64 - _FILTER_BITS)])
            slot = np.searchsorted(keys, grams[at])
            same = keys[np.minimum(slot, len(keys) - 1)] == grams[at]
            at, slot = at[same], slot[same]
            text = np.searchsorted(np.cumsum(counts), at, side="right")
            place = at - (np.cumsum(counts) - counts)[text] + words.first[text]
            n = begin[slot + 1] - begin[slot]
            hit = item[runs(begin[slot], n)]
            text, place = np.repeat(text, n), np.repeat(place, n)
            order = np.lexsort((place, hit, text))
            text, hit, place = text[order], hit[order], place[order]
            edge = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (hit[1:] != hit[:-1])])) if len(text) else np.zeros(0, dtype=np.int64)
            size = np.diff(np.append(edge, len(text)))
            for e, m in zip(edge[size >= self.least[hit[edge]]], size[size >= self.least[hit[edge]]]):
                d, i, p = text[e], hit[e], place[e : e + m]
                c, reach = self.least[i], self.size[i] - q
                head, tail = p[: m - c + 1], p[c - 1 :]
                fits = tail - head <= reach
                low, high = words.first[d], max(words.first[d], words.first[d + 1] - self.size[i])
                a, b = np.clip(tail[fits] - reach, low, high), np.clip(head[fits], low, high)
                starts = np.unique(runs(a, b - a + 1))
                found.append((np.full(len(starts), d), np.full(len(starts), i), starts))
        if not found:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*found))

    def leaks(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first word in the text, edits): for each text and item its closest window, the first of equals."""
        text, item, start = self.candidates(words)
        kept = []
        for part in alike(self.size[item]):
            t, i, s = text[part], item[part], start[part]
            size = np.minimum(self.size[i], words.first[t + 1] - s)
            windows = table(words.hash, s, size)
            met = meets(walk(windows, size, self.size[i]), self.samples[:, :, i])
            t, i, s, size, windows = t[met], i[met], s[met], size[met], windows[met]
            distance = edits(windows, size, self.words(i), self.size[i])
            ok = distance <= self.most[i]
            kept.append((t[ok], i[ok], s[ok] - words.first[t[ok]], distance[ok]))
        if not kept:
            return text, item, start, start
        t, i, s, e = (np.concatenate(x) for x in zip(*kept))
        order = np.lexsort((s, e, i, t))
        t, i, s, e = t[order], i[order], s[order], e[order]
        best = np.ones(len(t), dtype=bool)
        best[1:] = (t[1:] != t[:-1]) | (i[1:] != i[:-1])
        return t[best], i[best], s[best], e[best]


def table(hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Word hashes from each start, one row each, filled up with 0."""
    wide = int(size.max()) if len(size) else 0
    out = np.zeros((len(size), wide), dtype=np.uint64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, runs(np.zeros(len(size), dtype=np.int64), size)] = hashes[runs(start, size)]
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """The items, a bounded block at a time."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).filter("text is not null")
    words = rows.agg(F.sum(F.size(F.split("text", "[\\x20\\x09-\\x0D]+")))).first()[0] or 0
    n = -(-words // BLOCK_WORDS)
    for k in range(n):
        block = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield Items([r.item_id for r in block], [r.text for r in block])


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_edits): the closest window for each document row and item it holds."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for items in _blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                t, i, s, e = shared.value.leaks(Words(batch.column(1), lower=True))
                ids = pa.array([shared.value.ids[k] for k in i], pa.int64())
                yield pa.record_batch([batch.column(0).take(pa.array(t)), ids, pa.array(s), pa.array(e)], names=["doc_id", "item_id", "first_word", "n_edits"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, first_word long, n_edits long")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("item_id", "first_word", "n_edits")]).filter("false")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of ``docs`` that hold no benchmark passage; columns unchanged."""
    kept = docs
    for items in _blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, text):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[shared.value.leaks(Words(batch.column(batch.schema.get_field_index(text)), lower=True))[0]] = False
                yield batch.filter(pa.array(clean))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
