import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkledger.llm import mixing, tokens, topk

from .conftest import messy_rows, words_of


def targets(sizes, share=1.5, most=2):
    """Share by weight again and again until nothing is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, left = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        part = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest} if rest else {}
        over = [s for s in rest if part[s] > most * sizes[s]]
        if not over:
            return full | part
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def test_mix_reaches_targets(crowded):
    rows = messy_rows()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words_of(t))
    want = targets(sizes)
    out = mixing.mix_words(crowded).collect()
    assert len(out) == len(rows)
    by = defaultdict(int)
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source_size, round(r.target, 6)] += r.taken
    for source, size in sizes.items():
        assert by[size, round(want[source], 6)] == pytest.approx(math.floor(want[source]), abs=2)
    assert Counter(map(tuple, out)) == Counter(map(tuple, mixing.mix_words(crowded.repartition(2)).collect()))


def test_mix_rows_hold_the_words_taken(crowded, nothing):
    mixed = mixing.mix(crowded)
    assert mixed.columns == [*crowded.columns, "epoch"]
    taken = Counter()
    for r in mixing.mix_words(crowded).collect():
        taken[r.doc_id] += r.taken
    held = Counter()
    for r in mixed.collect():
        held[r.doc_id] += len(words_of(r.text))
    assert +taken == +held
    assert mixing.mix(nothing).count() == 0 and mixing.mix_words(nothing).count() == 0


def test_many_ranges(shipped, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    df = shipped.createDataFrame([(i, "w " * (i % 7), "hot" if i % 3 else "cold") for i in range(300)], "doc_id long, text string, source string")
    a = mixing.mix_words(df)
    assert a.groupBy("source_size").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).filter("t <> floor(g)").count() == 0
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10**6)
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, mixing.mix_words(df).collect()))


def brute_top(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q is not None and q % 100 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), i is None, i or 0, i) for i, w in ok if i != q]
            out += [(q, n + 1, s[3], -s[0]) for n, s in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("dims,n,scale", [(64, 500, 1.0), (3, 40, 1e5), (5, 6, 1.0)])
def test_top_k(shipped, monkeypatch, dims, n, scale):
    rng = random.Random(dims)
    f32 = lambda x: __import__("numpy").float32(x).item()
    rows = [(i, [f32(rng.gauss(0, scale)) for _ in range(dims)]) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2100, [1.0, None]), (2101, [float("nan")] * dims), (2102, [float("inf")] * dims), (None, rows[2][1]), (2103, [1.0]), (2200, [])]
    rows += [rows[5], rows[0]]
    df = shipped.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, 10)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_top(rows, 10), key=str)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 1)  # every query a block of its own
    if n < 50:
        assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, 10).collect()), key=str) == sorted(brute_top(rows, 10), key=str)
    assert topk.top_k(df.filter("false"), F.col("vec_id") % 100 == 0).count() == 0


VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def test_token_counts_equal_the_public_model(shipped):
    tokenizers = pytest.importorskip("tokenizers")
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    public = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unk_id=0, byte_fallback=True))
    rng = random.Random(1)
    texts = ["", None, " ", "a  b", "漢字 ﷺ é\n\n", "x" * 5000, " lead", "trail ", "▁▁ a"]
    texts += ["".join(rng.choice("abcdethe  \néß漢.,1") for _ in range(rng.randrange(400))) for _ in range(60)]
    df = shipped.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, VOCABULARY).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (len(public.encode("▁" + t.replace(" ", "▁")).ids) if t else 0), t


def test_ties_keep_the_longest_last_piece(monkeypatch):
    counter = tokens.UnigramCounter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("▁a", -2.0), ("ab", -2.0)])
    assert counter.count("ab") == 2  # ▁ + ab beats ▁a + b: equal scores, ab starts first
    monkeypatch.setattr(tokens, "REMEMBERED", 1)
    assert [counter.count(t) for t in ("ab ab", "ab a b", "é")] == [4, 5, 3]
    with pytest.raises(ValueError):
        tokens.UnigramCounter([("a▁b", 0.0)])
