import hashlib
from collections import Counter

from sparkledger.llm import neardup, substrings

from .conftest import messy_rows, shingle_set, words_of


def linked(rows, percent):
    """doc_id -> smallest doc_id reached, by comparing all pairs."""
    rows = [(i, shingle_set(t)) for i, t, *_ in rows if i is not None]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_components_equal_all_pairs(messy):
    for percent in (80, 85):
        want = linked(messy_rows(), percent)
        found = neardup.near_components(messy, percent).collect()
        assert len(found) == len(messy_rows())
        empty = [r for r in found if r.n_shingles == 0]
        assert all(r.component_id == r.doc_id for r in empty)
        assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == want
        assert all(r.component_id is None for r in found if r.doc_id is None)


def test_one_large_group_of_near_copies(shipped):
    """Copies with zero to many edits: leaders leave many components of one text open, and bounds decide."""
    import random

    rng = random.Random(8)
    base = [f"b{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(500):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(150)] = rng.choice(["the", "of", f"e{rng.randrange(10**6)}"])
        rows.append((i, " ".join(words)))
    df = shipped.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for percent in (80, 85):
        found = {r.doc_id: r.component_id for r in neardup.near_components(df, percent).collect()}
        assert found == linked(rows, percent) and 1 < len(set(found.values())) < 400


def test_needed_coordinates():
    assert neardup.needed(85) >= neardup.needed(80) >= 1


def test_drop_near_copies(crowded, nothing):
    kept = neardup.drop_near_copies(crowded, 85)
    assert kept.columns == crowded.columns
    want = {i for i, c in linked(messy_rows(), 85).items() if i == c}
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*want, None, None])
    assert neardup.drop_near_copies(nothing).count() == 0


def brute_repeats(rows):
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        for k in range(len(w) - 49) if i is not None else []:
            key = tuple(w[k : k + 50])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, t, *_ in rows:
        w = words_of(t)
        keep = [True] * len(w)
        for k in range(len(w) - 49) if i is not None else []:
            if first[tuple(w[k : k + 50])] < i:
                keep[k : k + 50] = [False] * 50
        kept = b" ".join(x for x, ok in zip(w, keep) if ok)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force(messy, nothing):
    found = substrings.find_repeats(messy).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, found.collect())) == Counter(brute_repeats(messy_rows()))
    assert substrings.find_repeats(nothing).count() == 0


def test_cut_keeps_columns_nulls_and_white_space(crowded):
    cut = substrings.cut_repeats(crowded)
    assert cut.columns == crowded.columns and cut.dtypes == crowded.dtypes
    got = Counter((r.doc_id, r.text is None, hashlib.sha256(b" ".join(words_of(r.text))).hexdigest()) for r in cut.collect())
    nulls = Counter((i, t is None) for i, t, *_ in messy_rows())
    assert Counter((i, null) for i, null, _ in got.elements()) == nulls
    assert Counter((i, h) for i, _, h in got.elements()) == Counter((i, h) for i, _, _, h in brute_repeats(messy_rows()))


def test_hot_passage_and_copies(shipped):
    """Half of all documents are one text, the others share a passage."""
    import random

    rng = random.Random(2)
    text, passage = (" ".join(f"x{rng.randrange(99)}" for _ in range(n)) for n in (80, 55))
    rows = [(i, text if i % 2 else f"own{i} {passage} end{i}") for i in range(400)]
    df = shipped.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = substrings.find_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, found.collect())) == brute_repeats(rows)
    kept = {r.doc_id for r in neardup.near_components(df, 85).collect() if r.doc_id == r.component_id}
    assert kept == {i for i, c in linked(rows, 85).items() if i == c}
