"""Registered corpus queries against their SQL twins, and the pipeline against plain Python."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sparkledger.llm import language

from .conftest import messy_rows, shingle_set, words_of
from .test_near_and_repeats import linked

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def shown(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", ["op2_mixing", "op3_exact_top_k", "op6_url_filter", "op7_license_scan"])
def test_query_equals_sql(shipped, name):
    con = duckdb.connect()
    for t in "documents embeddings pages labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    df = entry.queries()[name](shipped, SF)
    assert sorted(names) == sorted(df.columns)
    want = sorted([shown(row[names.index(c)]) for c in sorted(names)] for row in result.fetchall())
    assert sorted([shown(r[c]) for c in sorted(names)] for r in df.collect()) == want


def test_every_operator_has_a_query():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "substrings", "decontamination", "mix"]


def cut(rows):
    """(id, words kept) after removing windows of 50 words that start in a smaller id."""
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - 49) if i is not None else []:
            key = tuple(w[k : k + 50])
            first[key] = min(i, first.get(key, i))
    for i, t in rows:
        w = words_of(t)
        keep = [True] * len(w)
        for k in range(len(w) - 49) if i is not None else []:
            if first[tuple(w[k : k + 50])] < i:
                keep[k : k + 50] = [False] * 50
        yield i, [x for x, ok in zip(w, keep) if ok]


def test_pipeline_stages_equal_plain_python(shipped, messy, tmp_path):
    leak = " ".join(messy_rows()[5][1].split()[100:130])  # a piece of document 6, and of its near copy
    shipped.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    judged = language.identify(messy, language.learn(messy)).collect()
    want = [(r.doc_id, r.text) for r in judged if r.lang_pred != "und" and r.lang_score >= 1 / 3]
    docs = corpus_pipeline.STAGES[0][1](shipped, messy, str(tmp_path))
    assert docs.columns == messy.columns and sorted(map(str, ((r.doc_id, r.text) for r in docs.collect()))) == sorted(map(str, want))

    smallest = linked([(*r, None) for r in want], 80)
    docs = corpus_pipeline.STAGES[1][1](shipped, docs, str(tmp_path))
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(i for i, _ in kept if i is not None) == sorted(i for i, c in smallest.items() if i == c)
    assert sum(i is None for i, _ in kept) == sum(i is None for i, _ in want)

    docs = corpus_pipeline.STAGES[2][1](shipped, shipped.createDataFrame(docs.collect(), docs.schema), str(tmp_path))
    rows = docs.collect()
    assert sorted(str((r.doc_id, words_of(r.text))) for r in rows) == sorted(str(x) for x in cut(kept) if x[1])
    assert all(r.n_chars == len(r.text) for r in rows)

    docs = corpus_pipeline.STAGES[3][1](shipped, shipped.createDataFrame(rows, docs.schema), str(tmp_path))
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in rows} - {6}

    mixed = corpus_pipeline.STAGES[4][1](shipped, shipped.createDataFrame(docs.collect(), docs.schema), str(tmp_path))
    assert mixed.columns == [*messy.columns, "epoch"] and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in docs.collect()}


def test_pipeline_runs_whole_and_empty(shipped, nothing, tmp_path):
    out = corpus_pipeline.run(shipped, SF)
    assert out.count() > 0 and shingle_set(out.first().text)
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    shipped.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(shipped, str(tmp_path)).count() == 0
