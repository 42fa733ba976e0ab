"""Byte-level BPE over Arrow batches: ids with character offsets, and back to bytes.

The vocabulary is a file of ranks (base64 of a token's bytes, its id) and a pattern whose
matches are encoded separately. The tokenizers library does the merges. It wants tokens as
characters and merges as pairs: every byte gets a printable character of its own, and a
token's pair is what lower ranks make of its bytes. A match that is a token as a whole is
that token. So the ids are those that the ranks give directly.

Texts go through the library in pieces, so memory does not follow a text's length. A piece
ends where a match ends for certain: after a character that is no white space, before white
space. Between two such places a task encodes each distinct stretch once. Long runs without such a place are cut inside a match, between two tokens of a window. That is
right if the two tokens at the cut are what their joined bytes give: a row of tokens is the
encoding of its bytes when every two neighbours are. Where they are not, the pieces are joined.

Offsets count code points: a token covers the characters its bytes lie in, so tokens that
share a split character have overlapping offsets. Decoding looks ids up in the byte table;
its text form puts a split character where its last byte comes, and U+FFFD for bytes that are
no UTF-8.

A null or empty text has no tokens and decodes to no bytes; bytes of a text that are no UTF-8 count
as U+FFFD; null ids, or an id outside the vocabulary, decode to null. Every row counts by
itself: repeated rows, rows without an id and empty tables are nothing special, and other
columns of the input take no part. No special token is ever produced.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from .arrays import lists, pieces, runs

#: Characters of a text that are encoded at once.
PIECE_CHARS = 1 << 18
#: Characters of new stretches that go through the library in one call.
JOINED_CHARS = 1 << 15
#: Characters of stretches that a task remembers; with more it forgets them all and goes on.
REMEMBERED_CHARS = 1 << 23
#: The characters that Unicode calls white space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A match never goes on from other characters to white space.
_STRETCH = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_WHOLE = re.compile(f"[{_WHITE}].*[^{_WHITE}]\\Z", re.DOTALL)
_BEFORE_SPACE = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
#: A place inside a match, whose rest would match by itself: away from apostrophes, and two spaces at least.
_MARK = r"[!-&(-/:-@\[-`{-~]"
_INSIDE = re.compile(rf"(?<=[^\W\d_]{{3}})(?=[^\W\d_])|(?<=[0-9])(?=[0-9])|(?<={_MARK})(?={_MARK})|(?<=[ \t\r\n])(?=[ \t\r\n]{{2}})")
#: Characters around a cut inside a match that are looked at.
_AROUND = 200

FORMS = {"ids": "array<int>", "packed": "binary", "starts": "array<int>", "ends": "array<int>"}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next free one from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    own = {b: chr(b) for b in plain}
    others = iter(range(0x100, 0x200))
    return [own[b] if b in own else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged(raw: bytes, ranks: dict[bytes, int], limit: float = float("inf")) -> list[bytes]:
    """What merges of a rank below ``limit`` make of a few bytes."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        pairs = [(ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(pairs)
        if rank >= limit:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class ByteBPE:
    """One vocabulary, ready to encode and decode."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        chars = byte_characters()

        def spelled(token: bytes) -> str:
            return "".join(chars[b] for b in token)

        ordered = sorted(ranks, key=ranks.get)
        merges = [pair for pair in (merged(t, ranks, ranks[t]) for t in ordered if len(t) > 1) if len(pair) == 2]
        model = models.BPE(vocab={spelled(t): i for t, i in ranks.items()}, merges=[(spelled(a), spelled(b)) for a, b in merges], ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        split = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.length = np.full(max(ranks.values(), default=-1) + 1, -1, dtype=np.int64)
        by_id = [b""] * len(self.length)
        for token, i in ranks.items():
            by_id[i], self.length[i] = token, len(token)
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.begin = np.cumsum(np.maximum(self.length, 0)) - np.maximum(self.length, 0)
        self.ranks = ranks
        self._forget()

    def cuts(self, text: str) -> list[tuple[str, bool]]:
        """Pieces of about PIECE_CHARS, each with whether it begins inside a match."""
        out, at, inside = [], 0, False
        while len(text) - at > PIECE_CHARS:
            found = _BEFORE_SPACE.search(text, at + PIECE_CHARS, at + 2 * PIECE_CHARS)
            end = found.start() if found else self._between_tokens(text, at + PIECE_CHARS, at + 2 * PIECE_CHARS)
            if end is None:
                break
            out.append((text[at:end], inside))
            at, inside = end, not found
        return [*out, (text[at:], inside)] if at < len(text) else out

    def _between_tokens(self, text: str, at: int, end: int) -> int | None:
        """The first place inside a match that divides two tokens of the text around it."""
        for low in range(at, min(end, len(text)), _AROUND):
            window = text[max(0, low - _AROUND) : low + 2 * _AROUND]
            ids = self._raw(window)
            begin, over = self.offsets(ids, window)
            clean = {int(b) + max(0, low - _AROUND) for b, o in zip(begin[1:], over[:-1]) if b == o}
            for found in _INSIDE.finditer(text, low, min(low + _AROUND, end)):
                if found.start() in clean:
                    return found.start()
        return None

    def _raw(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32)

    def _fits(self, left: int, right: int) -> bool:
        both = [self.decode(np.array([i])) for i in (left, right)]
        return merged(both[0] + both[1], self.ranks) == both

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        parts = [(row, piece, inside) for row, t in enumerate(texts) if t for piece, inside in self.cuts(t)]
        rows: list[list[tuple[str, np.ndarray]]] = [[] for _ in texts]
        at = 0
        while at < len(parts):
            end, chars = at, 0
            while end < len(parts) and chars < PIECE_CHARS:
                chars += len(parts[end][1])
                end += 1
            for (row, piece, inside), ids in zip(parts[at:end], self._pieces([p for _, p, _ in parts[at:end]])):
                while inside and rows[row] and not self._fits(rows[row][-1][1][-1], ids[0]):
                    piece = rows[row].pop()[0] + piece
                    ids = self._raw(piece)
                rows[row].append((piece, ids))
            at = end
        return [np.concatenate([np.zeros(0, np.int32), *(ids for _, ids in row)]) for row in rows]

    def _pieces(self, pieces_: list[str]) -> list[np.ndarray]:
        """Ids of pieces; every distinct stretch of spaces and what follows them goes through the library once."""
        found = [_STRETCH.findall(p) for p in pieces_]
        if self.chars > REMEMBERED_CHARS:
            self._forget()
        new = list(set().union(*found).difference(self.known))
        encoded = self._stretches(new)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.chars += sum(map(len, new))
        self.sizes = np.concatenate([self.sizes, np.array([len(x) for x in encoded], dtype=np.int64)])
        self.store = np.concatenate([self.store, *encoded])
        starts = np.cumsum(self.sizes) - self.sizes
        out = []
        for stretches in found:
            at = np.fromiter(map(self.known.__getitem__, stretches), dtype=np.int64, count=len(stretches))
            out.append(self.store[runs(starts[at], self.sizes[at])])
        return out

    def _stretches(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of stretches: those from white space to another character lie end to end in a few calls."""
        whole = [_WHOLE.match(t) is not None for t in texts]
        out, run, chars = {}, [], 0
        for text in [t for t, w in zip(texts, whole) if w] + [None]:
            if run and (text is None or chars >= JOINED_CHARS):
                ids = self._raw("".join(run))
                ends = np.cumsum([len(t.encode()) for t in run])
                cut = np.searchsorted(np.cumsum(self.length[ids]), ends, side="right")
                out.update(zip(run, np.split(ids, cut[:-1])))
                run, chars = [], 0
            if text is not None:
                run.append(text)
                chars += len(text)
        rest = [t for t, w in zip(texts, whole) if not w]
        out.update(zip(rest, (np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))))
        return [out[t] for t in texts]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars, self.sizes, self.store = 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def offsets(self, ids: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last, from byte lengths."""
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum(self.length[ids])
        return (char[end - self.length[ids]].astype(np.int32), (char[end - 1] + 1).astype(np.int32)) if len(ids) else (ids, ids)

    def decode(self, ids: np.ndarray) -> bytes | None:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length) or (self.length[ids] < 0).any()):
            return None
        return self.bytes[runs(self.begin[ids], self.length[ids])].tobytes()

    def texts(self, ids: np.ndarray) -> list[str] | None:
        """Each token's text; a split character belongs to the token with its last byte."""
        raw = self.decode(ids)
        if raw is None:
            return None
        reader, end = codecs.getincrementaldecoder("utf-8")("replace"), np.cumsum(self.length[ids]).tolist()
        return [reader.decode(raw[a:b], b == len(raw)) for a, b in zip([0, *end], end)]


@lru_cache(maxsize=2)
def _vocabulary(name: str, pattern: str) -> ByteBPE:
    """One vocabulary for each Python worker, from the file that Spark has sent."""
    return ByteBPE(read_ranks(SparkFiles.get(name)), pattern)


def _sent(df: DataFrame, ranks: str) -> str:
    df.sparkSession.sparkContext.addFile(ranks)
    return ranks.rsplit("/", 1)[-1]


def _strings(column: pa.Array) -> list[str | None]:
    return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def encode(docs: DataFrame, ranks: str, pattern: str, forms: Sequence[str] = ("ids",), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens and the ``forms`` asked for) of every row of ``docs``.

    Forms: ``ids``; ``packed``, the ids as little-endian unsigned 32-bit integers;
    ``starts`` and ``ends``, the offsets. ``ranks`` is a path on the driver.
    """
    name, forms = _sent(docs, ranks), list(forms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(name, pattern)
        for batch in pieces(batches):
            texts = _strings(batch.column(1))
            ids = vocabulary.encode(texts)
            counts = np.array([len(x) for x in ids], dtype=np.int64)
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(counts)}
            if {"starts", "ends"} & set(forms):
                spans = [vocabulary.offsets(x, t or "") for x, t in zip(ids, texts)]
            for form in forms:
                if form == "packed":
                    columns[form] = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
                else:
                    laid = ids if form == "ids" else [s[form == "ends"] for s in spans]
                    columns[form] = lists(np.concatenate(laid), counts, pa.int32())
            yield pa.record_batch(list(columns.values()), names=list(columns))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", "n_tokens long", *(f"{f} {FORMS[f]}" for f in forms)]))


def decode(rows: DataFrame, ranks: str, ids: str = "ids", forms: Sequence[str] = ("decoded",)) -> DataFrame:
    """``rows`` with the bytes of their ids (an array, or packed) as a column ``decoded``.

    Forms: ``decoded`` binary, ``decoded_text`` string, ``token_texts`` an array with each
    token's text. They take the place of columns of these names.
    """
    name, forms = _sent(rows, ranks), list(forms)
    kinds = {"decoded": BinaryType(), "decoded_text": StringType(), "token_texts": ArrayType(StringType())}
    kept = [c for c in rows.columns if c not in forms]
    at = kept.index(ids)
    # Columns go by plain names on their way: a name may hold a dot.
    rows = rows.select([F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)])
    schema = StructType([*rows.schema.fields, *(StructField(f, kinds[f]) for f in forms)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(name, "")
        for batch in batches:
            column = batch.column(at)
            packed = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
            if packed:
                found = [None if x is None or len(x) % 4 else np.frombuffer(x, "<u4").astype(np.int64) for x in column.to_pylist()]
            else:
                found = [None if x is None or None in x else np.array(x, dtype=np.int64) for x in column.to_pylist()]
            out = {}
            raw = [None if x is None else vocabulary.decode(x) for x in found]
            if "decoded" in forms:
                out["decoded"] = pa.array(raw, pa.binary())
            if "decoded_text" in forms:
                out["decoded_text"] = pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw], pa.string())
            if "token_texts" in forms:
                out["token_texts"] = pa.array([None if x is None else vocabulary.texts(x) for x in found], pa.list_(pa.string()))
            yield pa.record_batch([*batch.columns, *(out[f] for f in forms)], names=[*batch.schema.names, *forms])

    return rows.mapInArrow(run, schema).toDF(*kept, *forms)
