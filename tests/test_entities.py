import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkledger.operators import nearest as N
from sparkledger.operators.classify import Categorizer, TextEmbedder, label_ids, uncertain_items
from sparkledger.operators.entities import alias_table, categorize, discover_entities, match_aliases, register_entities
from sparkledger.operators.fuzzy import FUZZY_MIN_SCORE, find_similar, find_similar_inside, rank_similar, text_grams
from sparkledger.operators.knowledge import merchants_from_text, resolve_entities

ENTITY = "canonical_name string, default_category string, aliases array<string>"


def entities(spark, *rows):
    return spark.createDataFrame(list(rows), ENTITY)


def categories(spark, ents, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, description string")
    return [r["category"] for r in categorize(df, alias_table(ents)).orderBy("i").collect()]


def test_alias_spellings(spark):
    rad = entities(spark, ("radhaus.de", "Shopping", ["radhaus.de gmbh", "rad haus", "radhausde"]))
    texts = ["radhaus.de gmbh", "SEPA PROBDE77 radhaus.de gmbh", "order at radhaus.de", "tyres from rad haus", "RADHAUSDE_LINZ_OST"]
    assert categories(spark, rad, texts) == ["Shopping"] * 5
    boehm = entities(spark, ("Böhm & Töchter", "Services", ["bohm & tochter", "bohm and tochter", "böhm&töchter"]))
    assert categories(spark, boehm, ["Invoice of BÖHM & TÖCHTER", "bohm and tochter", "Order @ Böhm&Töchter"]) == ["Services"] * 3


def test_near_misses_and_blanks(spark):
    ents = entities(spark, ("Lind", "Fuel", []), ("Bank of Linz", "Finance", []), ("Radhaus", "Shopping", []))
    texts = ["Rosalind's Bakery", "The New Bank of Graz", "Radhausen Stadtamt", "Linden", None, "", "   ", "\n\t"]
    assert categories(spark, ents, texts) == ["Uncategorized"] * 8


def test_longest_alias_wins(spark):
    ents = entities(spark, ("Radhaus", "Shopping", []), ("Radhaus Bike Rental", "Travel", []), ("Brot Oost", "Groceries", ["brot oost"]))
    texts = ["invoice of Radhaus Bike Rental for April", "order at Radhaus", "kaart, probe brot oost 7703,pas907 nr:qq110z"]
    assert categories(spark, ents, texts) == ["Travel", "Shopping", "Groceries"]


def test_learn_and_run_again(spark):
    texts = ["Kiosk Nord", "Laden Sued", "Kiosk Nord", "Laden Sued", "One more counter"]
    df = spark.createDataFrame([(t,) for t in texts], "description string")
    known = entities(spark, ("Else", "Misc", ["else"]))

    def unknown():
        found = discover_entities(categorize(df, alias_table(known)))
        return {r["raw"]: r for r in found.collect()}

    first = unknown()
    assert sorted(first) == ["kiosk nord", "laden sued", "one more counter"]
    assert first["kiosk nord"]["n_rows"] == 2 and first["kiosk nord"]["original_examples"] == ["Kiosk Nord"]
    change = lambda *row: spark.createDataFrame([row], "canonical_name string, default_category string, alias string, version int")
    known = register_entities(known, change("Kiosk Nord", "Snacks", "kiosk nord", 1))
    assert sorted(unknown()) == ["laden sued", "one more counter"]
    known = register_entities(known, change("Laden Sued", "Skipped", "laden sued", 2))
    assert sorted(unknown()) == ["one more counter"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("score", [0.6, 0.8, 0.9])
def test_fuzzy_equals_all_pairs(spark, score):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abc ") for _ in range(rnd.randint(3, 18))).strip() or "a"
    names = sorted({word() for _ in range(60)})
    texts = sorted({*[word() for _ in range(40)], *[n[1:] + "b" for n in names if len(n) > 3], *[n + "a" for n in names]})
    df = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    got = {(r["candidate"], r["name"]) for r in find_similar(df(texts, "candidate"), df(names, "name"), min_score=score).collect()}
    want = {(t, n) for t in texts for n in names if 1 - distance(t, n) / max(len(t), len(n)) >= score - 1e-9}
    assert got == want and want


def test_bad_match_has_no_suggestion(spark):
    df = lambda v, c: spark.createDataFrame([(v,)], f"{c} string")
    found = find_similar(df("kaart, probe qorumix,pas907 nr:k771wq", "candidate"), df("fietsen van oost", "name"), min_score=0.5)
    assert rank_similar(found).count() == 0


def runs_of(text):
    words = text.split()
    return {" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}


@pytest.mark.parametrize("score", [0.5, 0.7, 0.8, 1.0])
def test_name_inside_a_line_equals_all_runs(spark, score):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 7)))
    names = sorted({" ".join(word() for _ in range(rnd.randint(1, 4))) for _ in range(40)})
    bent = lambda n: "".join(c for c in n if rnd.random() > 0.08)
    lines = sorted({" ".join([*[word() for _ in range(rnd.randint(0, 9))], bent(rnd.choice(names)), *[word() for _ in range(rnd.randint(0, 9))]]) for _ in range(60)} | set(names[:5]))
    df = lambda rows, c: spark.createDataFrame([(r,) for r in [*rows, None, "", " ,;"]], f"{c} string")
    rows = find_similar_inside(df(lines, "line"), df(names, "name"), min_score=score).collect()
    got = {(r["line"], r["name"]): r["score"] for r in rows}
    rate = lambda a, b: 1 - distance(a, b) / max(len(a), len(b))
    want = {(t, n): max(rate(run, n) for run in runs_of(t)) for t in lines for n in names if runs_of(t)}
    want = {pair: s for pair, s in want.items() if s >= score - 1e-9}
    assert got.keys() == want.keys() and want and all(got[p] == pytest.approx(s) for p, s in want.items())
    assert all(r["found"] in runs_of(r["line"]) and rate(r["found"], r["name"]) == pytest.approx(r["score"]) for r in rows)


def test_name_inside_a_bank_line(spark):
    df = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    lines = ["kaart, probe fietsen vann oost 4711,pas907 nr:k771wq", "kaart, probe qorumix,pas907 nr:k771wq"]
    found = find_similar_inside(df(lines, "line"), df(["Fietsen van Oost"], "name"), min_score=0.5).collect()
    assert [(r["line"], r["name"], r["found"]) for r in found] == [(lines[0], "Fietsen van Oost", "fietsen vann oost")]
    assert found[0]["score"] == pytest.approx(16 / 17)


def test_probes_grow_with_the_text(spark):
    rnd = random.Random(1)
    counts = {}
    for size in (20, 100, 200):
        texts = spark.createDataFrame([("".join(rnd.choice("abcdefgh ") for _ in range(size)),)], "t string")
        counts[size] = text_grams(texts, "t", "t", [3, 2, 1]).count()
    assert counts == {size: 3 * size - 3 for size in counts}


def test_aliases_of_many_lengths(spark):
    """Aliases of 1 to 12 words that share all their words but one."""
    words = [f"w{i}" for i in range(12)]
    ents = entities(spark, *[(f"E{n:02d}", "c", [" ".join(words[:n])]) for n in range(1, 13)], ("Other", "c", ["w3 w2 w1"]))
    texts = {n: "x " + " ".join(words[:n]) + " y " + " ".join(words[: n // 2]) for n in range(1, 13)} | {50: "w0 w0 w0 w1", 51: "w3 w2 w1 w0 w2", 52: "w1 w2", 53: None, 54: ""}
    df = spark.createDataFrame(list(texts.items()), "i int, text string")
    got = {r["i"]: r["canonical_name"] for r in match_aliases(df, alias_table(ents), "text", "i").collect()}
    assert got == {n: f"E{n:02d}" for n in range(1, 13)} | {50: "E02", 51: "Other"}


def merchants_and_queries(spark, n, dim, seed):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(6, dim))
    # One centre draws most vectors: its tiles and queries are split.
    pick = lambda k: centers[np.where(rnd.random(k) < 0.6, 0, rnd.integers(0, 6, k))] + rnd.normal(scale=0.35, size=(k, dim))
    m, q = pick(n), pick(n)
    ms = spark.createDataFrame([(f"m{i:05d}", f"c{i % 3}", v.tolist()) for i, v in enumerate(m)], "canonical_name string, default_category string, vector_embedding array<double>")
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, vector array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    return ms, qs, unit(q) @ unit(m).T


@pytest.mark.parametrize("threshold", [-1.0, 0.5, 0.9])
def test_nearest_equals_brute_force(spark, monkeypatch, threshold):
    ms, qs, sims = merchants_and_queries(spark, 300, 16, 3)
    want = {i: (f"m{row.argmax():05d}", round(row.max(), 6)) for i, row in enumerate(sims) if row.max() >= threshold}
    read = lambda df: {r["query_id"]: (r["canonical_name"], round(r["similarity"], 6)) for r in df.collect()}
    assert read(N.nearest_merchant(qs, ms, 16, threshold)) == want
    monkeypatch.setattr(N, "STRIP", 32)
    assert read(N.nearest_merchant(qs, ms, 16, threshold, broadcast_bytes=12_000)) == want


def test_one_block_and_many_answer_repeated_keys_alike(spark):
    ms, qs, _ = merchants_and_queries(spark, 60, 8, 5)
    other = qs.filter("query_id = 4").selectExpr("3 as query_id", "vector")
    asked = qs.unionByName(qs.filter("query_id < 5")).unionByName(other)
    rows = lambda df: sorted((r["query_id"], r["canonical_name"], round(r["similarity"], 6)) for r in df.collect())
    assert rows(N.nearest_merchant(asked, ms, 8, 0.2, broadcast_bytes=2000)) == rows(N.nearest_merchant(asked, ms, 8, 0.2))


def test_most_products_are_not_finished():
    """Vectors without clusters: norms of the remaining components rule nearly all pairs out."""
    rng = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    queries, merchants = unit(rng.normal(size=(400, 384))), unit(rng.normal(size=(5000, 384)))
    merchants[17] = queries[3]
    merchants[40] = unit(queries[5:6] + 0.3 * merchants[40])[0]
    place, best, full = N.best_in_block(queries, merchants, 0.85)
    assert full < 0.02 * 400 * 5000
    assert {i: p for i, p in enumerate(place) if p >= 0} == {3: 17, 5: 40} and best[3] == 1.0
    sims = np.round(queries @ merchants.T, 9)
    place, best, _ = N.best_in_block(queries, merchants, -1.0)
    assert (place == sims.argmax(axis=1)).all() and (best == sims.max(axis=1)).all()
    none, _, _ = N.best_in_block(np.full((2, 384), np.nan), merchants, -1.0)
    assert (none == -1).all()


def test_one_long_alias_makes_one_branch(spark):
    long = " ".join(f"word{i}" for i in range(200))
    ents = entities(spark, ("Long", "A", [long]), ("Short", "B", ["kiosk"]))
    assert categories(spark, ents, [f"see {long} there", "the kiosk", long[:-1]]) == ["A", "B", "Uncategorized"]


def test_unit_vectors_and_dimension(spark):
    basis = lambda i: [1.0 if k == i else 0.0 for k in range(384)]
    ms = spark.createDataFrame([("Radhaus", "Shopping", basis(0)), ("Lind", "Transport", basis(1)), ("Bad", "x", [1.0])], "canonical_name string, default_category string, vector_embedding array<double>")
    near = [0.99 if k == 1 else 0.01 if k == 2 else 0.0 for k in range(384)]
    qs = spark.createDataFrame([(0, basis(0)), (1, near), (2, basis(5)), (3, [0.0] * 384), (4, [1.0])], "query_id int, vector array<double>")
    for limit in (1 << 20, 0):
        found = {r["query_id"]: r["canonical_name"] for r in N.nearest_merchant(qs, ms, 384, 0.9, broadcast_bytes=limit).collect()}
        assert found == {0: "Radhaus", 1: "Lind"}


def test_resolve_by_text_vector(spark):
    seeds = spark.createDataFrame([("Radhaus", "Shopping", "RADHAUS.DE LINZ"), ("Lind", "Fuel", None)], "name string, category string, description string")
    embedder = TextEmbedder.fit(spark.createDataFrame([("RADHAUS DE LINZ",), ("LIND",), ("GREENGROCER",), ("TEA ROOM",)], "cleaned_description string"))
    rows = spark.createDataFrame([("visa radhaus.de linz",), ("CORNER GREENGROCER",), ("",), ("Lind",)], "Description string")
    found = resolve_entities(rows, "Description", merchants_from_text(seeds, embedder), embedder)
    assert {r["Description"]: r["canonical_name"] for r in found.collect()} == {
        "visa radhaus.de linz": "Radhaus", "CORNER GREENGROCER": None, "": None, "Lind": "Lind",
    }
    norm = embedder.transform(spark.createDataFrame([("TEA ROOM",)], "cleaned_description string")).first()["vector"]
    assert len(norm) == 384 and math.isclose(sum(x * x for x in norm), 1.0, rel_tol=1e-9)


def test_classifier(spark):
    labelled = spark.createDataFrame(
        [("CORNER GREENGROCER", "General"), ("OLD GREENGROCER", "General"), ("LIND FUEL DEPOT", "Transport"), ("FUEL PUMP", "Transport")],
        "cleaned_description string, category string",
    )
    model = Categorizer.train(labelled)
    texts = spark.createDataFrame([("CORNER GREENGROCER GRAZ",), ("LIND FUEL",), ("",)], "cleaned_description string")
    got = {r["cleaned_description"]: r for r in model.predict(texts, 0.0).collect()}
    assert got["CORNER GREENGROCER GRAZ"]["category"] == "General" and got["LIND FUEL"]["category"] == "Transport"
    strict = model.predict(texts, 1.01)
    assert uncertain_items(strict).count() == 3 and strict.first()["confidence"] > 0
    assert not Categorizer.train(labelled.limit(0)).trained
    assert Categorizer().predict(texts).first()["confidence"] == 0.0
    assert {r[0]: r[1] for r in label_ids(labelled, "category").collect()} == {"General": 0, "Transport": 1}


def test_a_million_labels(spark):
    labels = spark.range(1_000_000).selectExpr("concat('k', id * 7919 % 1000000) as label")
    ids = label_ids(labels.unionByName(labels.limit(10)).unionByName(spark.sql("select cast(null as string) as label")))
    assert ids.count() == 1_000_000
    order = ids.selectExpr("label", "label_id").orderBy("label_id").limit(3).collect()
    assert [tuple(r) for r in order] == [("k0", 0), ("k1", 1), ("k10", 2)]
    assert ids.agg(F.min("label_id"), F.max("label_id"), F.countDistinct("label_id")).first()[:] == (0, 999_999, 1_000_000)


def test_lines_do_not_meet_in_the_driver(spark, tmp_path):
    """Lines go to their hits by a shuffle, however small they are; a broadcast would pass them through the driver."""
    path = str(tmp_path / "lines")
    spark.range(50).selectExpr("concat('order at brot oost number ', id) as line").write.parquet(path)
    found = find_similar_inside(spark.read.parquet(path), spark.createDataFrame([("brot oost",)], "name string"), min_score=0.9)
    assert found.count() == 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [_id" not in plan and "SortMergeJoin [_id" in plan


def test_places_of_long_lines_are_found(spark):
    """Names lie across the cuts of a long line, at its start and at its end; one has an edit."""
    words = ["w%03d" % i for i in range(400)]
    line = " ".join(["kiosk noord", *words[:150], "brotoost laden", *words[150:], "letzte hale"])
    names = ["kiosk noord", "brotoost lader", "letzte halle", *[f"{a} {b}" for a, b in zip(words[20:40], words[21:41])]]
    df = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    got = {r["name"]: r["found"] for r in find_similar_inside(df([line], "line"), df(names, "name"), min_score=0.9).collect()}
    assert got == {**{n: n for n in names}, "brotoost lader": "brotoost laden", "letzte halle": "letzte hale"}


def test_jobs_do_not_grow_with_merchants(spark):
    """A table too large for one block took a job for each block; keys, null names and ties come out as with one block."""
    ms, qs, _ = merchants_and_queries(spark, 300, 16, 7)
    twins = ms.limit(40).selectExpr("cast(null as string) as canonical_name", "default_category", "vector_embedding")
    ms, qs = ms.unionByName(twins), qs.selectExpr("query_id + 9007199254740993L as query_id", "vector")
    rows = lambda df: sorted((r["query_id"], r["canonical_name"] or "", round(r["similarity"], 6)) for r in df.collect())
    want = rows(N.nearest_merchant(qs, ms, 16, 0.2))
    spark.sparkContext.setJobGroup("blocks", "blocks")
    try:
        got = rows(N.nearest_merchant(qs, ms, 16, 0.2, broadcast_bytes=2000))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("blocks")) < 12
    assert got == want
