import random

import numpy as np
import pyarrow as pa
import pytest

from sparkledger.llm import arrays


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_words_and_grams(monkeypatch, block):
    monkeypatch.setattr(arrays, "_BLOCK", block)
    rng = random.Random(1)
    texts = [None, "", "  a b\tc\n", "é ü x" * 7, "hello world hello", "w" * 300 + " z", " \x1f\x85 a"]
    texts += [" ".join(rng.choice("ab c d\n") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(50)]
    words = arrays.Words(pa.array(texts))
    split = [(t or "").encode().split() for t in texts]
    assert words.counts.tolist() == [len(w) for w in split]
    flat = [w for ws in split for w in ws]
    known = dict(zip(flat, words.hash.tolist()))
    assert [known[w] for w in flat] == words.hash.tolist() and len(set(known.values())) == len(known)
    for k in (1, 3, 5):
        grams, counts = words.grams(k)
        assert counts.tolist() == [max(0, len(w) - k + 1) for w in split]
        runs = [tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1)]
        assert len(set(runs)) == len(set(grams.tolist())) == len(set(zip(runs, grams.tolist())))
    assert [words.joined(d) for d in range(len(texts))] == [b" ".join(w) for w in split]


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    for width in (1, 2, 3, 18, 25, 50, 51):
        assert arrays.sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


def test_pieces_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(arrays, "BATCH_BYTES", 10)
    batch = pa.record_batch([pa.array(["a" * 4, None, "b" * 30, "", "c" * 9])], names=["text"])
    cut = list(arrays.pieces(iter([batch])))
    assert [t for p in cut for t in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert max(len(p) for p in cut) < 4
