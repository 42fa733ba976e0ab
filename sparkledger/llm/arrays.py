"""Words, shingles and their hashes over whole Arrow batches, as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D. All hashes
are fixed functions of the bytes, so every task and every retry agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BATCH_BYTES = 1 << 20
_BLOCK = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95
_GRAM = 0x9E3779B97F4A7C15
_U64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (one to one)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _U64, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GRAM))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BREAK = np.zeros(256, dtype=bool)  # for letter runs: all of ASCII but letters
_BREAK[:128] = [not chr(c).isalpha() for c in range(128)]
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _block_powers() -> tuple[np.ndarray, np.ndarray]:
    if _BLOCK not in _tables:
        _tables[_BLOCK] = powers(_BASE, _BLOCK), powers(pow(_BASE, -1, 1 << 64), _BLOCK)
    return _tables[_BLOCK]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that one piece holds about BATCH_BYTES of text, or one long text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + BATCH_BYTES, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its texts; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """Byte range and hash of every word of a column of texts.

    ``first[d]`` is the index of text d's first word, ``first[d + 1]`` ends it.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, letters: bool = False):
        """``letters``: words are runs of letters and of bytes beyond ASCII instead."""
        self.data, offsets = utf8(texts)
        self.offsets = offsets
        n = len(self.data)
        filled = ~(_BREAK if letters else _SPACE)[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        begins = filled.copy()
        begins[1:] &= ~filled[:-1] | edge[1:n]
        ends = filled.copy()
        ends[:-1] &= ~filled[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.lower = lower
        self.hash = self.hash_until(self.end)

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hash_until(self, end: np.ndarray) -> np.ndarray:
        """Polynomial hash of every word's bytes before ``end``, a block of bytes at a time: a word may be of any length."""
        power, inverse = _block_powers()
        at_start, at_end = (np.empty(len(self.start), dtype=np.uint64) for _ in range(2))
        carry, scale, unscale = 0, 1, 1
        for low in range(0, len(self.data), _BLOCK):
            block = self.data[low : low + _BLOCK]
            sums = np.empty(len(block) + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE[_LOWER[block] if self.lower else block] * power[: len(block)], out=sums[1:])
            sums = sums * np.uint64(scale) + np.uint64(carry)
            a, b = np.searchsorted(self.start, [low, low + len(block)])
            at_start[a:b] = sums[self.start[a:b] - low]
            c, d = np.searchsorted(end, [low, low + len(block)], side="right")
            at_end[c:d] = sums[end[c:d] - low]
            carry = int(sums[-1])
            scale = scale * pow(_BASE, _BLOCK, 1 << 64) & _U64
        back = np.array([pow(_BASE, -_BLOCK * k, 1 << 64) for k in range(len(self.data) // _BLOCK + 1)], dtype=np.uint64)
        return mix((at_end - at_start) * inverse[self.start % _BLOCK] * back[self.start // _BLOCK])

    def grams(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from every position that has k words of one text, and how many each text has.

        Hashes lie text after text; text d has max(0, words - k + 1) of them. With
        ``short``, a text of fewer words (but one) has one: its whole sequence.
        """
        counts = np.maximum(self.counts - k + 1, 0)
        if short:
            counts[(self.counts > 0) & (self.counts < k)] = 1
        at = runs(self.first[:-1], counts)
        size = np.repeat(np.minimum(self.counts, k), counts)
        n = len(self.hash)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hash * powers(_GRAM, n), out=sums[1:])
        return mix((sums[at + size] - sums[at]) * powers(pow(_GRAM, -1, 1 << 64), n)[at] + size.astype(np.uint64)), counts

    def sets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles of every text, text after text, and how many each has."""
        grams, counts = self.grams(k, short=True)
        end = np.cumsum(counts)
        found = [np.unique(grams[e - c : e]) for e, c in zip(end, counts)]
        return (np.concatenate(found) if found else grams), np.array([len(x) for x in found], dtype=np.int64)

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of every text's whole word sequence (0 for no words)."""
        filled, n = self.counts > 0, len(self.hash)
        out = np.zeros((2, len(self)), dtype=np.uint64)
        if n:
            begin = self.first[:-1][filled]
            for k, word in enumerate((self.hash, mix(self.hash ^ np.uint64(_GRAM)))):
                total = np.add.reduceat(word * powers(_GRAM, n), begin) * powers(pow(_GRAM, -1, 1 << 64), n)[begin]
                out[k, filled] = mix(total + self.counts[filled].astype(np.uint64))
        return out[0], out[1]

    def joined(self, d: int, keep: np.ndarray | None = None) -> bytes:
        """Words of text d (all, or those that ``keep`` marks) with one space between."""
        a, b = self.first[d], self.first[d + 1]
        if a == b:
            return b""
        words = bytes(self.data[self.start[a] : self.end[b - 1]]).split()
        return b" ".join(words if keep is None else [w for w, k in zip(words, keep.tolist()) if k])


def runs(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (counts[0] of them), start[1], ..."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(start - before, counts)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:]) if step < len(out) else out[:0]
        done += step
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from values laid end to end."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
