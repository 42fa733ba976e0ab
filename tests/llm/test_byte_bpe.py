import hashlib
import random
import struct

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from sparkledger.llm import bytebpe
from sparkledger.llm.queries import RANKS

from .conftest import SCHEMA, messy_rows

PATTERN = public_tokenizers.PATTERN
ranks = bytebpe.read_ranks(RANKS)
public = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
vocabulary = bytebpe.ByteBPE(ranks, PATTERN)
AWKWARD = [
    "it's we'll 'stuff 're'x  two   spaces \n\n lines\t\tend  ",
    "Straße Łódź ελληνικά русский 漢字かな交じり한국어 עברית ไทย 12345½²",
    "👩‍👩‍👧‍👦 é \u0000\u001c\u0085 x　﻿",
    "<|endoftext|><|startoftext|>",
    "a" * 5000,
    "-" * 700 + "=" * 900,
    "漢字" * 900,
]


def awkward_rows():
    return [(i, t, "en", "s", 0) for i, t in enumerate(AWKWARD)] + messy_rows()


def test_ids_equal_the_public_library():
    for text in AWKWARD:
        (ids,) = vocabulary.encode([text])
        assert ids.tolist() == public.encode_ordinary(text)
        assert vocabulary.decode(ids) == text.encode() and "".join(vocabulary.texts(ids)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=200))
def test_any_text(text):
    (ids,) = vocabulary.encode([text])
    assert ids.tolist() == public.encode_ordinary(text)
    starts, ends = vocabulary.offsets(ids, text)
    covered = set()
    for token, a, b, (shown, first) in zip(ids.tolist(), starts.tolist(), ends.tolist(), zip(vocabulary.texts(ids), public.decode_with_offsets(ids.tolist())[1])):
        assert vocabulary.decode(ids[:0]) == b"" and public.decode_single_token_bytes(token) in text[a:b].encode()
        assert a == first
        covered |= set(range(a, b))
    assert covered == set(range(len(text)))


def test_pieces_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(bytebpe, "PIECE_CHARS", 7)
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßλжш漢字" + "  \n'.,19"
    monkeypatch.setattr(bytebpe, "_AROUND", 5)
    for text in [*AWKWARD, " " * 300 + "x", "ab" * 400, "9" * 500, "'s" * 300, "it''s'll" * 90, *("".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(200))]:
        assert vocabulary.encode([text])[0].tolist() == public.encode_ordinary(text)
    assert len(vocabulary.cuts("some words in a row " * 50)) > 50
    assert all(len(vocabulary.cuts(t)) > 20 for t in ("漢λж字ßш" * 200, "a" * 5000, "-" * 5000, "9" * 5000, " " * 5000))


def test_whole_table_there_and_back(shipped, nothing):
    docs = shipped.createDataFrame(awkward_rows(), SCHEMA).repartition(3).selectExpr("*", "1 as ids", "2 as packed", "3 as n_tokens", "4 as `a.b`")
    forms = ["ids", "packed", "starts", "ends"]
    encoded = bytebpe.encode(docs, RANKS, PATTERN, forms)
    back = bytebpe.decode(encoded, RANKS, forms=["decoded", "decoded_text", "token_texts"])
    rows = back.collect()
    want = [(i, t or "", public.encode_ordinary(t or "")) for i, t, *_ in awkward_rows()]
    assert sorted((str(r.doc_id), r.decoded_text, r.ids) for r in rows) == sorted((str(i), t, ids) for i, t, ids in want)
    for r in rows:
        assert r.n_tokens == len(r.ids) == len(r.starts) == len(r.ends) == len(r.token_texts)
        assert bytes(r.packed) == struct.pack(f"<{len(r.ids)}I", *r.ids)
        assert bytes(r.decoded).decode() == r.decoded_text == "".join(r.token_texts)
    assert bytebpe.encode(nothing, RANKS, PATTERN, forms).count() == 0


def test_ids_that_are_none(shipped):
    rows = shipped.createDataFrame([(1, [72, 105], "x"), (2, None, "x"), (3, [5, None], "x"), (4, [10**6], "x"), (5, [-1], "x"), (6, [50256], "x"), (7, [], "x")], "doc_id long, ids array<int>, `odd.name` string")
    out = {r.doc_id: r for r in bytebpe.decode(rows, RANKS).collect()}
    assert out[1]["odd.name"] == "x" and bytes(out[1].decoded) == vocabulary.decode(vocabulary.encode([""])[0]) + public.decode_bytes([72, 105])
    assert bytes(out[7].decoded) == b"" and all(out[i].decoded is None for i in (2, 3, 4, 5, 6))
    split = public.encode_ordinary("漢")[:1]
    cut = shipped.createDataFrame([(1, split)], "doc_id long, ids array<int>")
    (row,) = bytebpe.decode(cut, RANKS, forms=["decoded_text", "token_texts"]).collect()
    assert row.decoded_text == "".join(row.token_texts) and (len(public.encode_ordinary("漢")) == 1 or "�" in row.decoded_text)


def test_query_equals_the_public_library(shipped, tmp_path):
    shipped.createDataFrame(awkward_rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t, *_ in awkward_rows():
        ids = public.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = entry.queries()["op13_byte_bpe"](shipped, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
