import pyarrow as pa

from sparkledger.llm import language, toxicity

LATIN = [("the cat and the house of the king with this thing", "en"), ("der hund und das haus von dem mann nicht auf die", "de")] * 8
GREEK = [("το σπίτι και ο σκύλος της πόλης", "el")] * 8


def model_of(spark, rows):
    return language.learn(spark.createDataFrame(rows, "text string, lang string"))


def test_languages_and_spans(shipped):
    model = model_of(shipped, LATIN + GREEK + [(None, "en"), ("lost", None)])
    assert model.langs == ["de", "el", "en"]
    mixed = "the king and the house of the cat " * 4 + "und das haus von dem mann nicht auf die " * 4
    texts = [("the house of the king", "x"), ("σκύλος και σπίτι", "x"), (mixed, "x"), (None, "x"), ("", "x"), ("12 !!", "x"), ("текст", "x"), ("и", "x")]
    df = shipped.createDataFrame([(*t, i) for i, t in enumerate(texts)], "text string, lang_pred string, i int")
    out = {r.i: r for r in language.identify(df, model).collect()}
    assert [out[i].lang_pred for i in range(6)] == ["en", "el", out[2].lang_pred, "und", "und", "und"]
    assert out[2].lang_pred in ("de", "en") and [s.lang for s in out[2].lang_spans] == ["en", "de"]
    assert [(s.start, s.end) for s in out[2].lang_spans] == [(0, 32), (32, 68)]
    assert out[6].lang_pred in model.langs and all(0 <= r.lang_score <= 1 for r in out.values())
    kept = language.keep_identified(df, model)
    assert kept.columns == df.columns and sorted((r.i, r.text, r.lang_pred) for r in kept.collect()) == [(i, *texts[i]) for i in (0, 1, 2, 6, 7)]


def test_stage_rejects_what_was_not_learned(shipped):
    import random

    import corpus_pipeline

    rng = random.Random(3)
    junk = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(60))
    finnish = "olipa kerran pieni tyttö joka asui metsän laidalla vanhan talon vieressä ja hänellä oli punainen takki"
    learned = ["the king and the house of the cat", "und das haus von dem mann", "the house of the king und der hund", "σκύλος και σπίτι", "the king текст"]
    strange = ["текст на другом языке", "漢字仮名交じり文", junk, finnish, finnish * 50, "the король и дом из слов"]
    rows = [*LATIN, *GREEK, *[(t, None) for t in learned + strange]]
    docs = shipped.createDataFrame(rows, "text string, lang string")
    kept = corpus_pipeline.identify_language(shipped, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == sorted([t for t, _ in LATIN + GREEK] + learned)


def test_long_text_equals_short_slices(shipped, monkeypatch):
    model = model_of(shipped, LATIN)
    texts = ["the king und das haus " * 500, "x" * 500 + " the king"]
    want = language._judge(model, 12.0, texts)
    monkeypatch.setattr(language, "_STEP", 64)
    got = language._judge(model, 12.0, texts)
    assert got[0] == want[0] and got[1].tolist() == want[1].tolist()


def test_nothing_learned(shipped, nothing):
    model = language.learn(nothing)
    out = language.identify(shipped.createDataFrame([("abc",)], "text string"), model).first()
    assert (out.lang_pred, out.lang_score, out.lang_spans) == ("und", 0.0, [])
    assert language.identify(nothing, model).count() == 0


def toxic_rows():
    import random

    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rng.randrange(200)}" for _ in range(40)]
        if i % 5 == 0:
            words[rng.randrange(40)] = rng.choice(["grumpface", "moron,", "Snotface!"])
            words[rng.randrange(40)] = rng.choice(["grumpface", "idiot", "snotface"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    return rows, labels


def test_toxicity_learns_and_generalises(shipped):
    rows, labels = toxic_rows()
    docs = shipped.createDataFrame([*rows, (900, None), (901, ""), (None, "idiot grumpface"), (902, "fine " * 5000)], "doc_id long, text string")
    known = shipped.createDataFrame([x for x in labels if x[0] % 4] + [(None, 1), (7, None)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.learn(docs, known)).collect()
    assert len(out) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4 == 0]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert {r.doc_id: r.predicted for r in out if r.doc_id is None or r.doc_id >= 900} == {None: 1, 900: 0, 901: 0, 902: 0}


def test_toxicity_without_labels(shipped):
    docs = shipped.createDataFrame([(1, "idiot"), (2, None)], "doc_id long, text string")
    for rows, score in (([], 0), ([(1, 0)], 0), ([(1, 1)], 1)):
        labels = shipped.createDataFrame(rows, "doc_id long, toxic int")
        assert [round(r.score) for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()] == [score, score]


def test_correlated_voters_share_their_say():
    import numpy as np

    rng = np.random.default_rng(1)
    y = rng.random(20000) < 0.3
    votes = [np.where(rng.random(20000) < 0.85, y, ~y) for _ in range(3)]
    votes += [votes[0]] * 2
    v = np.stack(votes, axis=1).astype(float)
    model = toxicity.LabelModel(v.mean(axis=0), v.T @ v / len(v), 0.3, np.full(5, 0.65))
    assert model.correlated[0, 3] and model.correlated[3, 4] and not model.correlated[1, 2]
    assert np.allclose(model.toxic[1], 0.85, atol=0.05) and np.allclose(model.other[1], 0.15, atol=0.05)


def test_voter_patterns():
    text = toxicity._Text(pa.array(["STOP SHOUTING NOW", "a a a a a a", "plain words only", None, "you idiot"]))
    empty = toxicity.np.zeros(0, dtype=toxicity.np.uint64)
    votes = toxicity.Lexicons(empty, empty).votes(text)[:, -6:-1]
    assert votes.tolist() == [[0, 1, 0, 0, 0], [0, 0, 0, 0, 1], [0] * 5, [0] * 5, [1, 0, 0, 0, 0]]
