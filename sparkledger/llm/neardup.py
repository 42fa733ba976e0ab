"""Near copies: an inverted join on the coordinates of MinHash signatures.

Texts whose sets of five-word shingles are equal form a class; the rest of the
work is on classes. A signature has COORDINATES coordinates, each joining ROWS
min-wise hashes (so texts that only share a passage seldom meet). A class is
posted under each coordinate-value pair of its prefix: two signatures with
``needed`` equal coordinates must share one of the first COORDINATES - needed + 1.
Collisions become candidate pairs, pairs whose sizes rule out the similarity
are skipped, equal coordinates are counted over the whole signature, pairs
below ``needed`` go, and what stays is confirmed on the full shingle sets.

A posting of many classes is never expanded into all its pairs. First every class meets one
leader of each posting, then the most central class of each, the one with the smallest
share of shingles that no other open class has; confirmed links join them to components. Two
classes of one component need no further proof, so what is left are pairs of *different*
components. An intersection has at most what either side shares with the centre, and besides it at most
what either has that some open class has too; pairs that this rules out are skipped, as are pairs
already met under an earlier coordinate. So every linked pair ends in one component, whatever the
size of a group.

Rows without an id, and texts without words, link with nothing. Rows of one id
are one document: links of any of its texts count for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .arrays import Words, lists, mix, pieces, signed
from .graph import components

SHINGLE_WORDS = 5
COORDINATES = 24
ROWS = 3
#: Chance that a pair exactly at the threshold has too few equal coordinates.
MISS = 1e-6
LEADER_ROUNDS = 1
_SEEDS = mix(np.arange(1, 2 * COORDINATES * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SLICE = 1 << 16


def needed(percent: int) -> int:
    """Most equal coordinates that a pair of this similarity reaches but for a chance of MISS; one at least."""
    p, tail, k = (percent / 100) ** ROWS, 0.0, 0
    while True:
        tail += comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if tail > MISS:
            return max(1, k)
        k += 1


def _coordinates(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Signatures (texts x COORDINATES) of shingle sets laid end to end, all filled."""
    out = np.empty((len(counts), COORDINATES), dtype=np.uint64)
    ends = np.cumsum(counts)
    d = 0
    while d < len(counts):
        low = ends[d] - counts[d]
        e = max(d + 1, int(np.searchsorted(ends, low + _SLICE, side="right")))
        part, begin = grams[low : ends[e - 1]], (ends[d:e] - counts[d:e]) - low
        for c in range(COORDINATES):
            value = np.full(e - d, c, dtype=np.uint64)
            for r in range(c * ROWS, (c + 1) * ROWS):
                value = mix(value + np.minimum.reduceat((part ^ _SEEDS[2 * r]) * _SEEDS[2 * r + 1], begin))
            out[d:e, c] = value
        d = e
    return out


def _fingerprints(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit values of every set that depend on its shingles only; 0 for an empty set."""
    out, filled = np.zeros((2, len(counts)), dtype=np.uint64), counts > 0
    if filled.any():
        begin = (np.cumsum(counts) - counts)[filled]
        out[0, filled] = mix(np.add.reduceat(mix(grams ^ _SEEDS[0]), begin))
        out[1, filled] = mix(np.bitwise_xor.reduceat(mix(grams ^ _SEEDS[1]), begin))
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        grams, counts = Words(batch.column(1), lower=True).sets(SHINGLE_WORDS)
        filled = counts > 0
        first, second = _fingerprints(grams, counts)
        values = _coordinates(grams, counts[filled])
        sig = lists(signed(values.reshape(-1)), np.where(filled, COORDINATES, 0), pa.int64())
        yield pa.record_batch([batch.column(0), pa.array(counts), pa.array(signed(first)), pa.array(signed(second)), sig], names=["doc_id", "n", "f1", "f2", "sig"])


def _sizes_fit(percent: int):
    return (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)


def _intersections(batch: pa.RecordBatch) -> tuple[dict[str, pa.Array], np.ndarray, list[list[np.ndarray]], list[int]]:
    """Columns of a batch of text pairs, which rows hold the texts of their classes, the sets, and how many shingles both have."""
    col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    sets, own = [], []
    for side in "ab":
        grams, counts = Words(col[f"text_{side}"], lower=True).sets(SHINGLE_WORDS)
        own.append(signed(_fingerprints(grams, counts)[0]) == col[f"f_{side}"].to_numpy())
        sets.append(np.split(grams, np.cumsum(counts)[:-1]))
    valid = own[0] & own[1]
    return col, valid, sets, [len(np.intersect1d(a, b, assume_unique=True)) if ok else 0 for a, b, ok in zip(*sets, valid)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text_a"):
        col, valid, _, both = _intersections(batch)
        columns = [*(col[c] for c in ("a", "f_a", "b", "f_b")), pa.array(both, pa.int64())]
        yield pa.record_batch([c.filter(pa.array(valid)) for c in columns], names=["a", "f_a", "b", "f_b", "both"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text_a"):
            col, valid, (a, b), both = _intersections(batch)
            linked = np.array([ok and 100 * k >= percent * (len(x) + len(y) - k) for x, y, k, ok in zip(a, b, both, valid)], dtype=bool)
            keep = pa.array(linked)
            yield pa.record_batch([col["a"].filter(keep), col["b"].filter(keep)], names=["u", "v"])

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        grams, counts = Words(batch.column(2), lower=True).sets(SHINGLE_WORDS)
        own = np.repeat(signed(_fingerprints(grams, counts)[0]) == batch.column(1).to_numpy(), counts)
        doc = pa.array(np.repeat(np.arange(len(counts)), counts)[own])
        yield pa.record_batch([batch.column(0).take(doc), batch.column(1).take(doc), pa.array(signed(grams[own]))], names=["doc_id", "f1", "shingle"])


def _own_shingles(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, f1, own): how many shingles of each class (doc_id, f1) no other of these classes has."""
    rows = classes.join(texts, "doc_id").select("doc_id", "f1", "text").mapInArrow(_shingles, "doc_id long, f1 long, shingle long")
    single = rows.groupBy("shingle").agg(F.count("*").alias("k"), F.min("doc_id").alias("doc_id"), F.min("f1").alias("f1")).filter("k = 1")
    found = single.groupBy("doc_id", "f1").agg(F.count("*").alias("own"))
    return classes.join(found, ["doc_id", "f1"], "left").select("doc_id", "f1", F.coalesce("own", F.lit(0)).alias("own"))


def _links(pairs: DataFrame, signatures: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Confirmed (u, v) of candidate pairs (a, f_a, b, f_b)."""
    for side in "ab":
        pairs = pairs.join(signatures.select(F.col("doc_id").alias(side), F.col("f1").alias(f"f_{side}"), F.col("sig").alias(f"sig_{side}")), [side, f"f_{side}"])
    equal = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = pairs.filter(equal >= needed(percent)).select("a", "f_a", "b", "f_b")
    return _with_texts(near, texts).mapInArrow(_confirm(percent), "u long, v long")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")), side)
    return pairs.select("a", "f_a", "text_a", "b", "f_b", "text_b")


def _kept_of_centre(now: DataFrame, texts: DataFrame) -> DataFrame:
    """``now`` with ``both``: how many shingles a class shares with the most central class of the posting."""
    centre = now.groupBy("posting").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("r"), "doc_id", "f1")).alias("c"))
    centred = now.join(centre.select("posting", F.col("c.doc_id").alias("b"), F.col("c.f1").alias("f_b")), "posting")
    pairs = centred.select(F.col("doc_id").alias("a"), F.col("f1").alias("f_a"), "b", "f_b").distinct()
    kept = _with_texts(pairs, texts).mapInArrow(_shared, "a long, f_a long, b long, f_b long, both long").distinct()
    kept = stage_table(kept.withColumnsRenamed({"a": "doc_id", "f_a": "f1"}), "centres")
    return centred.join(kept, ["doc_id", "f1", "b", "f_b"])


def _side(rows: DataFrame, side: str, *more: str) -> DataFrame:
    return rows.select("posting", *[F.col(c).alias(f"{c}_{side}") for c in ("place", "doc_id", "n", "f1", "comp", *more)])


def near_components(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``: documents linked, directly or by
    others, at ``percent`` of shared shingles or more have one component_id, the smallest doc_id."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed_rows = stage_table(rows.mapInArrow(_sign, "doc_id long, n long, f1 long, f2 long, sig array<long>"), "signatures")
    sets = signed_rows.filter("n > 0 and doc_id is not null")
    classes = sets.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"))
    members = stage_table(signed_rows.select("doc_id", "n", "f1", "f2").join(classes, ["f1", "f2", "n"], "left"), "members")
    reps = members.filter("doc_id = rep").select("doc_id", "f1", "f2").distinct()
    signatures = stage_table(signed_rows.join(reps, ["doc_id", "f1", "f2"]).dropDuplicates(["doc_id", "f1", "f2"]).select("doc_id", "n", "f1", "sig"), "classes")

    prefix = COORDINATES - needed(percent) + 1
    postings = signatures.select("doc_id", "n", "f1", F.posexplode(F.slice("sig", 1, prefix)).alias("place", "posting"))
    shared = postings.groupBy("posting").agg(F.count("*").alias("k")).filter("k > 1").select("posting")
    met = stage_table(postings.join(shared, "posting"), "postings")
    texts = stage_table(rows.join(met.select("doc_id").distinct(), "doc_id"), "texts")

    # Rows of one id with different texts tie their classes together.
    tied = members.filter("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("top")).filter("v <> top")
    edges = members.join(tied.select("doc_id", "v"), "doc_id").select(F.col("rep").alias("u"), "v").filter("u <> v")

    edges = stage_table(edges, "links")
    tested = own = None
    for turn in range(LEADER_ROUNDS + 2):
        comp = components(edges)
        now = met.join(comp, met.doc_id == comp.node, "left").select("posting", "place", "doc_id", "n", "f1", F.coalesce("component", "doc_id").alias("comp"))
        open_ = now.groupBy("posting").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("posting")
        now = stage_table(now.join(open_, "posting"), "open")
        if now.isEmpty():
            break
        last = turn == LEADER_ROUNDS + 1
        if turn == LEADER_ROUNDS:
            # Classes that are still open only get fewer: what no other has now, none of them has later.
            own = stage_table(_own_shingles(now.select("doc_id", "f1").distinct(), texts), "own")
        if own is not None:
            more = own.join(signatures.select("doc_id", "f1", "sig"), ["doc_id", "f1"])
            now = now.join(more, ["doc_id", "f1"])
        possible = F.lit(True)
        if last:
            now = _kept_of_centre(now, texts)
            mine, other = (_side(now, side, "own", "both", "sig") for side in "ab")
            before_a, before_b = (F.slice(f"sig_{side}", 1, F.col("place_a")) for side in "ab")
            possible = F.expr("doc_id_a > doc_id_b or (doc_id_a = doc_id_b and f1_a > f1_b)") & ~F.arrays_overlap(before_a, before_b)
        else:
            # The last leader is the most central class of a posting: the one with the smallest share of shingles of its own.
            rank = F.col("doc_id") if not turn else F.xxhash64("doc_id", F.lit(turn)) if own is None else F.col("own") / F.col("n")
            fields = ["place", "doc_id", "n", "f1", "comp", *(["own"] if own is not None else [])]
            lead = now.groupBy("posting").agg(F.min(F.struct(rank.alias("rank"), *fields)).alias("x")).select("posting", "x.*")
            mine, other = (_side(rows_, side, *fields[5:]) for rows_, side in ((now, "a"), (lead, "b")))
        if own is not None:
            most = F.least(F.col("n_a") - F.col("own_a"), F.col("n_b") - F.col("own_b"))
            if last:  # shingles of the centre that both have, and others that both have
                beside = F.least(*(F.col(f"n_{x}") - F.col(f"both_{x}") - F.when(F.col(f"both_{x}") < F.col(f"n_{x}"), F.col(f"own_{x}")).otherwise(0) for x in "ab"))
                most = F.least(most, F.least("both_a", "both_b") + beside)
            possible = possible & (most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
        pairs = mine.join(other, "posting").filter(possible & (F.col("comp_a") != F.col("comp_b")) & _sizes_fit(percent))
        swap = F.col("doc_id_a") < F.col("doc_id_b")
        pairs = pairs.select(
            F.greatest("doc_id_a", "doc_id_b").alias("a"), F.when(swap, F.col("f1_b")).otherwise(F.col("f1_a")).alias("f_a"),
            F.least("doc_id_a", "doc_id_b").alias("b"), F.when(swap, F.col("f1_a")).otherwise(F.col("f1_b")).alias("f_b"),
        ).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "f_a", "b", "f_b"], "left_anti")
        pairs = stage_table(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        edges = stage_table(edges.unionByName(_links(pairs, signatures, texts, percent)), "links")
        if last:
            comp = components(edges)
    found = members.join(comp, members.rep == comp.node, "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without near copies: the row of the smallest doc_id of each component stays
    (of rows that repeat that id, one). Rows without id stay. Columns unchanged."""
    names = docs.columns
    found = near_components(docs, percent)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.filter("doc_id is not null").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return kept.select(*names).unionByName(docs.filter("doc_id is null").select(*names))
