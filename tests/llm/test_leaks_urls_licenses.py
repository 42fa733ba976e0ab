import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkledger.llm import decontaminate, licenses, urls

from .conftest import LOWER, messy_rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def most_edits(n):
    return min(int(0.2 * n), (n - min(3, n)) // min(3, n)) if n else 0


def brute_leaks(docs, items):
    out = {}
    for i, t in docs:
        w = (t or "").translate(LOWER).encode().split()
        for k, item in items:
            b = (item or "").translate(LOWER).encode().split()
            if b and w:
                best = min((distance(w[p : p + len(b)], b), p) for p in range(max(1, len(w) - len(b) + 1)))
                if best[0] <= most_edits(len(b)):
                    out[i, k] = best[0]
    return out


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        p, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[p] = f"zz{rng.randrange(10**6)}"
        elif kind == 1 and len(words) > 2:
            del words[p]
        else:
            words.insert(p, f"zz{rng.randrange(10**6)}")
    return words


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(n))) for i, n in enumerate([12, 20, 35, 60, 5])]
    items += [(10, None), (11, ""), (12, items[0][1])]
    docs = [(-1, None), (-2, ""), (-3, items[1][1].upper()), (-4, " ".join(items[2][1].split()[:30]))]
    for d in range(150):
        item = rng.choice(items[:5])[1].split()
        middle = edited(rng, item, rng.randrange(int(0.3 * len(item)) + 2)) if d % 3 else []
        docs.append((d, " ".join([f"w{rng.randrange(300)}" for _ in range(rng.randrange(60))] + middle + [f"v{rng.randrange(300)}" for _ in range(rng.randrange(60))])))
    return docs, items


def test_leaks_equal_brute_force(shipped, leaky):
    docs, items = leaky
    want = brute_leaks(docs, items)
    df = shipped.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = shipped.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_edits for r in decontaminate.find_leaks(df, bench).collect()}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and len(want) > 40
    assert sum(got[k] != want[k] for k in got) <= 0.05 * len(got)
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.find_leaks(df, bench.filter("false")).count() == 0
    assert decontaminate.drop_leaks(df.filter("false"), bench).count() == 0


def test_item_blocks_agree(shipped, leaky, monkeypatch):
    docs, items = leaky
    df, bench = shipped.createDataFrame(docs, "doc_id long, text string"), shipped.createDataFrame(items, "item_id long, text string")
    want = Counter(map(tuple, decontaminate.find_leaks(df, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    assert Counter(map(tuple, decontaminate.find_leaks(df, bench).collect())) == want


def windows_of(lists):
    wide = max(map(len, lists))
    out = np.zeros((len(lists), wide), dtype=np.uint64)
    for k, words in enumerate(lists):
        out[k, : len(words)] = [zlib.crc32(w.encode()) + 1 for w in words]
    return out, np.array([len(x) for x in lists])


@pytest.mark.parametrize("n", [8, 12, 20, 50, 100, 400])
def test_lsh_alone(n):
    """Windows at the largest distance meet their item, unrelated ones seldom do."""
    rng = random.Random(n)
    text = lambda: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items, steps = [text() for _ in range(200)], np.full(200, n)
    near = [edited(rng, item, most_edits(n))[:n] for item in items]
    walks = [decontaminate.walk(*windows_of(rows), steps) for rows in (items, near, [text() for _ in items])]
    assert decontaminate.meets(walks[0], walks[1]).mean() >= 0.99
    assert decontaminate.meets(walks[0], walks[2]).mean() < 0.05


def test_a_very_long_item_beside_short_ones():
    """Items are grouped by length: none is filled up to the longest."""
    import tracemalloc

    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in [*rng.choices(range(6, 14), k=10_000), 50_000]]
    tracemalloc.start()
    items = decontaminate.Items(list(range(len(texts))), texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20 and items.samples.shape[2] == 10_001
    sizes = np.array([5, 5, 6, 11, 50_000, 7, 1, 0])
    groups = [sizes[g].tolist() for g in decontaminate.alike(sizes)]
    assert sorted(x for g in groups for x in g) == sorted(sizes.tolist()) and all(max(g) <= 2 * max(1, min(g)) for g in groups)



def test_lsh_recall_at_the_largest_distance():
    import pyarrow as pa

    from sparkledger.llm.arrays import Words

    rng = random.Random(3)
    for n in (15, 40):
        item = [f"w{k}" for k in range(n)]
        docs = [" ".join(edited(rng, item, most_edits(n))) for _ in range(200)]
        found = decontaminate.Items([0], [" ".join(item)]).leaks(Words(pa.array(docs), lower=True))
        assert len(found[0]) >= 0.99 * len(brute_leaks(list(enumerate(docs)), [(0, " ".join(item))]))


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_own_labels_find_small_hosts(shipped):
    """A host of 8 block labels in 1,000 pages is blocked; verdicts of given rules block no other page."""
    rows = [(i, f"http://shop{i % 7}.org/a/{i}", "allow") for i in range(600)] + [(600 + i, f"http://net/es/{i}", None) for i in range(390)]
    rows += [(1000 + i, f"http://adult.org/a/{i}", "block" if i < 8 else None) for i in range(12)] + [(2000, "http://other.info/es/1", None)]
    pages = shipped.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = shipped.createDataFrame([(i, label) for i, _, label in rows if label], "page_id long, label string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labels, RULES, own_labels=True).collect()}
    assert got == {i: "block" if 600 <= i < 2000 else "allow" for i, _, _ in rows}


def test_urls(shipped):
    rows = [
        ("http://WWW.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        ("x://badexample.com/en/?a=/b", "badexample.com", "/en/", "com/", "allow"),
        ("http://a.com", "a.com", "", None, "allow"),
        ("http://a.com?x://b/", "a.com", "", None, "allow"),
        ("http://net/es/#f", "net", "/es/", "net/es/", "block"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("http://É.ORG/" + "x" * 5000, "É.org", "/" + "x" * 5000, None, "allow"),
    ]
    pages = shipped.createDataFrame([(i, r[0], 1) for i, r in enumerate(rows)] + [(None, rows[0][0], 1)], "page_id long, url string, verdict int")
    none = shipped.createDataFrame([], "page_id long, label string")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(pages, none, RULES).collect()}
    assert got == {**{i: r[1:] for i, r in enumerate(rows)}, None: rows[0][1:]}
    assert urls.judge(pages.filter("false"), none, RULES).count() == 0


def test_mined_rules(shipped):
    bad = [f"https://spam{i % 3}.site.org/buy/{i}.php?track={i}" for i in range(30)]
    good = [f"https://news{i % 5}.site.org/read/{i}" for i in range(60)] + [f"https://shop.site.org/buy/{i}" for i in range(30)]
    addresses = bad + good + ["https://new.org/buy/x.php?track=7", "https://new.org/buy/x"]
    pages = shipped.createDataFrame(list(enumerate(addresses)), "page_id long, url string")
    labels = shipped.createDataFrame([(i, "block" if i < 30 else "allow") for i in range(120)], "page_id long, label string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labels, []).collect()}
    assert got == {i: "block" if i < 30 or i == 120 else "allow" for i in range(122)}
    rules = urls.mine(urls.with_parts(pages).join(labels, "page_id").select("tokens", "label"))
    kept = [set(r.tokens) for r in urls.minimal(rules).collect()]
    assert kept and all(r.confidence >= 0.8 for r in rules.collect())
    assert not any(a < b for a in kept for b in kept) and all(any(k <= set(r.tokens) for k in kept) for r in rules.collect())


def test_licenses(shipped, nothing):
    notice = dict(licenses.NOTICES)
    long = notice["apache-2.0-header"].split()
    damaged = " ".join(long[:15] + ["other"] + long[16:])
    texts = {
        1: "Some code. " + notice["mit"] + " End.",
        2: "x " * 700 + notice["gpl-3.0"].upper() + " y" * 500,
        3: " ".join(long),
        4: damaged,
        5: " ".join(long[:10]),
        6: None,
        7: "",
        8: notice["isc"] + " " + notice["mit"],
        9: "released under the mit rules",
    }
    df = shipped.createDataFrame([(i, t, 1, 2) for i, t in texts.items()] + [(1, texts[1], 1, 2), (None, notice["mit"], 1, 2)], "doc_id long, text string, size int, row int")
    got = {(r.doc_id, r.license): (round(r.containment, 6), r.first_word) for r in licenses.scan(df).collect()}
    n = len(long) - 4
    assert got == {
        (1, "mit"): (1.0, 2), (2, "gpl-3.0"): (1.0, 700), (3, "apache-2.0-header"): (1.0, 0),
        **({(4, "apache-2.0-header"): (round((n - 5) / n, 6), 0)} if (n - 5) / n >= 0.8 else {}),
        (8, "isc"): (1.0, 0), (8, "mit"): (1.0, len(notice["isc"].replace("/", " ").split())), (None, "mit"): (1.0, 0),
    }
    assert licenses.scan(nothing).count() == 0 and licenses.scan(df, []).count() == 0


def test_bands_guarantee():
    for similarity in (0.2, 0.36, 0.8):
        for rows in (1, 2, 3):
            assert (1 - similarity**rows) ** licenses.bands(similarity, rows) <= licenses.MISS
    assert licenses.BANDS == math.ceil(math.log(1e-4) / math.log(1 - 0.8 / 2.2))
