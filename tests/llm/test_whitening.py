import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkledger.llm import whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def symmetric(values, seed=0):
    base, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return base @ np.diag(values) @ base.T


SPECTRA = {
    "spread": np.linspace(1, 50, 30),
    "close": [5.0, 5 + 1e-7, 5 + 2e-7, 9, 1, 0.5, 0.25, 3],
    "equal": [4.0] * 6 + [1.0] * 20 + [0.0] * 4,
    "steep": [10.0**-k for k in range(14)],
    "flat": [2.0] * 12,
    "one": [7.0],
    "rank two": [3.0, 1.0] + [0.0] * 10,
}


@pytest.mark.parametrize("name", SPECTRA)
def test_inertia_counts_eigenvalues(name):
    matrix, values = symmetric(SPECTRA[name], 3), np.array(SPECTRA[name])
    for shift in (-1.0, 0.13, 0.6, 2.5, 4.5, 8, 60):
        assert whitening.above(matrix, shift) == (values > shift).sum()
    indefinite = matrix - np.diag(np.diag(matrix))
    assert whitening.above(indefinite, 0.01) == (np.linalg.eigvalsh(indefinite) > 0.01).sum()


@pytest.mark.parametrize("most", [1, 5, 16])
@pytest.mark.parametrize("name", SPECTRA)
def test_leading_eigenvectors(shipped, name, most):
    matrix = symmetric(SPECTRA[name], 5)
    want = np.array([v for v in np.linalg.eigvalsh(matrix)[::-1] if v > 1e-11 * np.trace(matrix)])[:most]
    values, vectors = whitening.leading(shipped, matrix, most)
    assert values == pytest.approx(want, rel=1e-8, abs=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-6
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() < 1e-12 * np.trace(matrix)


def plain(rows, most=16):
    """(vec_id, component) -> the contract's numbers, with numpy and whole numbers."""
    usable = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in usable}))
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    apart = fit - np.array(sums) / n
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    kept = [k for k in np.argsort(-values) if values[k] > 1e-12 * values.sum()][:most]
    for i, x in usable:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for k, at in enumerate(kept):
            yield i, k + 1, n, deviation, (np.array(x) - np.array(sums) / n) @ vectors[:, at] / np.sqrt(values[at]), values[at] / values.sum()


def compare(found, want):
    found, want = sorted(found, key=lambda r: (r.vec_id is None, r.vec_id or 0, r.component, abs(r.whitened))), sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1], abs(r[4])))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in found] == [w[:4] for w in want]
    assert [abs(r.whitened) for r in found] == pytest.approx([abs(w[4]) for w in want], abs=1e-8)
    assert [r.explained for r in found] == pytest.approx([w[5] for w in want], rel=1e-9)
    for k in {r.component for r in found}:  # one sign for all rows
        signs = {r.whitened * w[4] > 0 for r, w in zip(found, want) if r.component == k and abs(w[4]) > 1e-6 and r.vec_id is not None}
        assert len(signs) <= 1
    assert all(r.identity_error <= 1e-9 for r in found)


def test_query_equals_plain_numpy(shipped):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    found = entry.queries()["op11_embedding_whitening"](shipped, SF)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(found.collect(), list(plain(rows)))


def test_awkward_vectors(shipped, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(5) * [3, 1, 1, 0.5, 0.01]]) for i in range(300)]
    rows += rows[:40] + [(None, rows[7][1]), (900, rows[8][1]), (901, None), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [float("nan")] + [0.0] * 4), (904, [float("inf")] * 5), (905, [])]
    rows += [(1000 + k, [8.0, 8.0, 8.0, 8.0, 8.0]) for k in range(200)]  # a hot vector counts once
    odd = [(906, [1.0, 2.0]), (907, [float(np.float32(1e30))] * 5)]
    table = shipped.createDataFrame(rows + odd, SCHEMA).repartition(4).withColumns({n: F.lit(1) for n in ("x", "n", "count", "vector", "a.b")})
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    compare(entry.queries()["op11_embedding_whitening"](shipped, str(tmp_path)).collect(), list(plain(rows)))


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None), (2, [])]])
def test_no_variance_no_rows(shipped, tmp_path, rows):
    shipped.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = entry.queries()["op11_embedding_whitening"](shipped, str(tmp_path))
    assert found.collect() == [] and found.columns[0] == "vec_id"


def test_large_counts_stay_exact():
    model = whitening.Whitening(3_000_000_000, [3_000_000_000 * 1_000_000 + 5] * 2, 1.0, np.ones(1), np.ones((2, 1)), 0.0)
    assert model.deviations(np.array([[1_000_000, 1_000_000], [1_000_001, 1_000_000], [1_000_900, 1_000_000]])) == [50, (3_000_000_000 - 5) ** 2 + 25, None]
