"""Exact repeats of WINDOW words or more across documents, found by fixed-block anchors.

A word goes if it lies in a window of WINDOW words that also starts in a
document of a smaller id. All windows are judged on the input.

1. Index: every document is cut into blocks of BLOCK words that do not overlap.
   Two blocks of that size fit any window, so a window that occurs in a document
   holds one of its blocks whole.
2. Probe: every rolling window of BLOCK words looks its content up. Block and
   rolling window are looked up by the smallest hash of the GRAM-word runs inside,
   which neighbouring rolling windows share, so a document sends a key about
   every tenth word and equal content always has equal keys.
3. Extend: around hits, and around the blocks that were hit, all full windows
   are hashed (96 bits) and meet by hash; a window goes if its smallest document
   is smaller. Neighbouring windows together are the maximal repeats.

Whole copies (equal word sequences) are recognised first and need no windows.
Minima are taken before rows meet, and joins on a hot key can be split by Spark,
so a passage may occur in any share of the documents.

Rows without id keep all words and are no reference. Rows of one id are one
document: none is smaller than the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage_table
from .arrays import Words, mix, pieces, runs, signed, sliding_min

WINDOW = 50
BLOCK = WINDOW // 2
GRAM = 8


def _keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Key of every rolling block, text after text, and how many each text has (none below WINDOW words)."""
    grams, counts = words.grams(GRAM)
    lowest = sliding_min(grams, BLOCK - GRAM + 1)
    per = np.where(words.counts >= WINDOW, words.counts - BLOCK + 1, 0)
    return lowest[runs(np.cumsum(counts) - counts, per)], per


def _rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, Words]:
    return batch.column(0), Words(batch.column(1))


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        ids, words = _rows_of(batch)
        keep = words.counts >= WINDOW
        one, two = words.sequences()
        yield pa.record_batch([ids.filter(pa.array(keep)), pa.array(words.counts[keep]), pa.array(signed(one[keep])), pa.array(signed(two[keep]))], names=["doc_id", "n", "s1", "s2"])


def _lookups(aligned: bool) -> Callable:
    """Distinct (key, sequence, doc_id) of each text's blocks, or of its rolling windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, words = _rows_of(batch)
            keys, per = _keys(words)
            doc = np.repeat(np.arange(len(per)), per)
            if aligned:
                keep = (np.arange(len(keys)) - np.repeat(np.cumsum(per) - per, per)) % BLOCK == 0
            else:
                keep = np.ones(len(keys), dtype=bool)
                keep[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
            keys, doc = keys[keep], doc[keep]
            order = np.lexsort((keys, doc))
            keys, doc = keys[order], doc[order]
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
            keys, doc = keys[new], doc[new]
            yield pa.record_batch([pa.array(signed(keys)), pa.array(signed(words.sequences()[0][doc])), ids.take(pa.array(doc))], names=["key", "s1", "doc_id"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows that hold a rolling block whose key was hit."""
    for batch in pieces(batches):
        ids, words = _rows_of(batch)
        row, hits = batch.column(2), batch.column(3)
        at, values = hits.offsets.to_numpy(), hits.values.to_numpy().view(np.uint64)
        keys, per = _keys(words)
        full, counts = words.grams(WINDOW)
        check = mix(words.hash[runs(words.first[:-1], counts)] + full) >> np.uint64(32)
        begin, key_begin = np.cumsum(counts) - counts, np.cumsum(per) - per
        chosen = []
        for d in np.flatnonzero(per):
            hit = np.isin(keys[key_begin[d] : key_begin[d] + per[d]], values[at[d] : at[d + 1]])
            met = np.concatenate([[0], np.cumsum(hit)])
            inside = met[WINDOW - BLOCK + 1 :] > met[: -(WINDOW - BLOCK + 1)]
            chosen.append(begin[d] + np.flatnonzero(inside))
        pick = np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)[pick]
        yield pa.record_batch(
            [pa.array(signed(full[pick])), pa.array(check[pick].astype(np.uint32).view(np.int32)), ids.take(pa.array(doc)), row.take(pa.array(doc)), pa.array((pick - begin[doc]).astype(np.int32))],
            names=["h1", "h2", "doc_id", "row", "pos"],
        )


def _digest(words: Words, d: int, keep: np.ndarray | None) -> tuple:
    n = int(words.counts[d])
    removed = 0 if keep is None else n - int(keep.sum())
    return n, removed, hashlib.sha256(words.joined(d, keep)).hexdigest()


def _text(words: Words, d: int, keep: np.ndarray | None) -> tuple:
    """Words and text of a document without what goes; the white space between kept words stays as it was."""
    a, b = words.first[d], words.first[d + 1]
    if a == b:
        return 0, 0, ""
    low, high = int(words.start[a]), int(words.end[b - 1])
    data = words.data[low:high]
    if keep is not None and not keep.all():
        stays = np.ones(high - low, dtype=bool)
        gone = np.flatnonzero(~keep)
        ends = np.append(words.start[a + 1 : b], high)
        for s, e in zip(words.start[a:b][gone] - low, ends[gone] - low):
            stays[s:e] = False
        data = data[stays]
    n = b - a
    return int(n), 0 if keep is None else int(n - keep.sum()), bytes(data).decode()


_SHAPES = {"digest": (_digest, "kept_sha256"), "text": (_text, "kept_text")}


def _first_pass(shape: str) -> Callable:
    """Finish every row that keeps all words or none; suspects go on with their text."""
    finish, name = _SHAPES[shape]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, words = _rows_of(batch)
            raw, hits, copies = batch.column(1), batch.column(2), batch.column(3).to_pylist()
            s1 = signed(words.sequences()[0])
            suspect = np.zeros(len(ids), dtype=bool)
            out = []
            for d in range(len(ids)):
                if copies[d] and words.counts[d] >= WINDOW and int(s1[d]) in copies[d]:
                    out.append(finish(words, d, np.zeros(words.counts[d], dtype=bool)))
                elif hits[d].is_valid and len(hits[d]) and words.counts[d] >= WINDOW:
                    suspect[d] = True
                    out.append((None, None, None))
                else:
                    out.append(finish(words, d, None))
            n, removed, result = zip(*out)
            if shape == "text":
                result = [r if ok else None for r, ok in zip(result, raw.is_valid().to_pylist())]
            only = pa.array(np.arange(len(ids)), mask=~suspect)
            yield pa.record_batch(
                [ids, pa.array((s1 & 0x7FFFFFFF).astype(np.int32)), raw.take(only), hits.take(only), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(result, pa.string()), batch.column(4)],
                names=["doc_id", "row", "text", "hits", "n_words", "n_removed", name, "doc"],
            )

    return run


def _last_pass(shape: str) -> Callable:
    finish, name = _SHAPES[shape]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            _, words = _rows_of(batch)
            out = []
            for d, found in enumerate(batch.column(2)):
                edge = np.zeros(words.counts[d] + 1, dtype=np.int64)
                if found.is_valid:
                    at = found.values.to_numpy()
                    edge[at] += 1
                    edge[at + WINDOW] -= 1
                out.append(finish(words, d, np.cumsum(edge[:-1]) == 0))
            n, removed, result = zip(*out)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(result, pa.string()), batch.column(3)], names=["doc_id", "n_words", "n_removed", name, "doc"])

    return run


def find_repeats(docs: DataFrame, shape: str = "digest", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, the outcome, and ``doc``, a struct
    of all columns but the text. The outcome is kept_sha256 (``digest``: of the kept words joined by
    one space) or kept_text (``text``: the text without the repeats). Null text counts as empty."""
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.struct(*others).alias("doc"))
    known = rows.select("doc_id", "text").filter("doc_id is not null")

    sequences = stage_table(known.mapInArrow(_sequences, "doc_id long, n long, s1 long, s2 long"), "sequences")
    first = sequences.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("first"))
    copies = sequences.join(first, ["s1", "s2", "n"]).filter("first < doc_id").select("doc_id", "s1")

    found = "key long, s1 long, doc_id long"
    blocks, probes = known.mapInArrow(_lookups(True), found), known.mapInArrow(_lookups(False), found)
    index = blocks.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("s1").alias("low"), F.max("s1").alias("high"))
    hits = stage_table(probes.join(index, "key").filter("first < doc_id and (low <> s1 or high <> s1)").select("key", "doc_id"), "hits")
    hit_blocks = blocks.join(hits.select("key").distinct(), "key").select("key", "doc_id")
    around = hits.unionByName(hit_blocks).select("doc_id", "key", F.lit(None).cast("long").alias("copy"))
    known_about = around.unionByName(copies.select("doc_id", F.lit(None).cast("long").alias("key"), F.col("s1").alias("copy")))
    per_doc = known_about.groupBy("doc_id").agg(F.collect_set("key").alias("hits"), F.collect_set("copy").alias("copies"))

    outcome = _SHAPES[shape][1]

    def schema(start: str) -> T.StructType:
        ddl = f"{start}, n_words long, n_removed long, {outcome} string"
        return T.StructType.fromDDL(ddl).add("doc", rows.schema["doc"].dataType)

    marked = rows.join(per_doc, "doc_id", "left").select("doc_id", "text", "hits", "copies", "doc")
    marked = stage_table(marked.mapInArrow(_first_pass(shape), schema("doc_id long, row int, text string, hits array<long>")), "marked")

    suspects = marked.filter("hits is not null")
    windows = stage_table(suspects.select("doc_id", "text", "row", "hits").mapInArrow(_windows, "h1 long, h2 int, doc_id long, row int, pos int"), "windows")
    repeated = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    repeated = stage_table(repeated, "repeated")  # so that the join reads two plain shuffles, whose hot partitions Spark can split
    covered = windows.join(repeated, ["h1", "h2"]).filter("first < doc_id").groupBy("doc_id", "row").agg(F.collect_list("pos").alias("positions"))
    last = suspects.join(covered, ["doc_id", "row"], "left").select("doc_id", "text", "positions", "doc").mapInArrow(_last_pass(shape), schema("doc_id long"))
    done = marked.filter("hits is null").select("doc_id", "n_words", "n_removed", outcome, "doc")
    return done.unionByName(last)


def cut_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of their texts; other columns unchanged. Null texts stay null."""
    found = find_repeats(docs, "text", text=text)
    return found.select(*[F.col("kept_text").alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns])
