import random

import pytest
from pyspark.sql import functions as F

from sparkledger.session import ship_package

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return (text or "").encode().split()


def shingle_set(text):
    w = (text or "").translate(LOWER).encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def sentence(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def messy_rows():
    """Nulls, empty and long texts, exact and near copies, shared passages, repeated rows and ids."""
    rng = random.Random(5)
    base, passage, very_long = sentence(rng, 120), sentence(rng, 70), sentence(rng, 6000)
    rows = [(1, base, "en", "a", 0), (2, base, "en", "a", 0), (3, None, "en", "a", 0), (4, "", None, None, 0), (5, " \n\t", "en", None, 0)]
    rows += [(6, very_long, "de", "b", 0), (7, very_long + " tail", "de", "b", 0), (None, base, "en", "a", 0), (None, "alone", "fr", "b", 0)]
    rows += [(8, "Two words", "en", "c", 0), (9, "two WORDS", "en", "c", 0), (10, "three other words", "en", "c", 0)]
    rows += [(11, sentence(rng, 60), "en", "b", 0)] * 2 + [(12, sentence(rng, 40), "en", "b", 0), (12, sentence(rng, 90), "en", "b", 0)]
    for i in range(20, 60):  # near copies with more and more edits
        w = base.split()
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "a", 0))
    for i in range(60, 90):  # a passage in many otherwise different documents
        rows.append((i, f"{sentence(rng, rng.randrange(5, 200))}\n{passage}  {sentence(rng, rng.randrange(0, 80))}", "fr", "hot", 0))
    return rows


@pytest.fixture(scope="session")
def shipped(spark):
    return ship_package(spark)


@pytest.fixture(scope="session")
def messy(shipped):
    return shipped.createDataFrame(messy_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def crowded(messy):
    """The same rows with extra columns that carry names operators use inside."""
    names = ["row", "key", "hits", "doc", "score", "size", "cut", "last", "epoch_", "lang_pred", "text_a", "posting", "comp"]
    return messy.withColumns({n: F.lit(7) for n in names})


@pytest.fixture(scope="session")
def nothing(shipped):
    return shipped.createDataFrame([], SCHEMA)
