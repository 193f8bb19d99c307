import numpy as np
import pytest

from folioscope.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component string, n string, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA)


def brute(rows, k=4):
    """{vec_id: (n, deviation, whitened)} and shares, from the whole covariance."""
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in fit], dtype=np.float64) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = [(i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), (np.array([n * a - s for a, s in zip(x, sums, strict=True)]) / n) @ vectors / np.sqrt(values)) for i, x in kept]
    return out, values / (c * c).sum() * n


@pytest.mark.parametrize(("dims", "basis"), [(20, 256), (90, 48)])
def test_equals_the_whole_covariance(spark, monkeypatch, dims, basis):
    monkeypatch.setattr(whitening, "BASIS", basis)
    monkeypatch.setattr(whitening, "CHUNK", 64)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, dims)) * np.linspace(2, 0.1, dims) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900 + i, x[7].tolist()) for i in range(80)]  # a heavy copy counts once
    want, shares = brute(rows)
    found = whitening.whiten(table(spark, rows)).collect()
    assert len(found) == 4 * len(rows) and {r["n"] for r in found} == {500}
    got = {(r["vec_id"], r["component"]): r for r in found}
    assert all(got[i, 1]["deviation"] == d for i, _, d, _ in want)
    for c in range(4):
        a, b = np.array([got[i, c + 1]["whitened"] for i, *_ in want]), np.array([w[c] for *_, w in want])
        assert np.abs(a * np.sign(a @ b) - b).max() < 1e-9
        assert abs(got[0, c + 1]["explained"] / shares[c] - 1) < 1e-12
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-12


def test_breakdown_and_equal_eigenvalues():
    """A block that spans an invariant space is made up for by random vectors; clusters larger than a block are found."""
    rng = np.random.default_rng(8)
    turn = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    values = np.concatenate([np.full(12, 5.0), np.full(3, 2.0), np.zeros(285)])
    a = (turn * values) @ turn.T
    found, vectors = whitening.leading(lambda q: a @ q, 300, 4)
    assert np.allclose(found, 5, atol=1e-12) and np.abs(a @ vectors - 5 * vectors).max() < 1e-11 and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-13)
    out = whitening.orthonormal(np.column_stack([turn[:, 0], turn[:, 0], np.zeros(300)]), turn[:, :2], rng)
    assert out.shape == (300, 3) and np.allclose(out.T @ out, np.eye(3), atol=1e-13) and np.abs(turn[:, :2].T @ out).max() < 1e-13


def test_a_full_basis_starts_again():
    rng = np.random.default_rng(9)
    turn = np.linalg.qr(rng.standard_normal((400, 400)))[0]
    values = np.linspace(1, 2, 400)[::-1]
    a = (turn * values) @ turn.T
    found, vectors = whitening.leading(lambda q: a @ q, 400, 4)
    assert np.abs(found - values[:4]).max() < 1e-12 and np.abs(np.abs((turn[:, :4] * vectors).sum(axis=0)) - 1).max() < 1e-12


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (None, [1.0, -0.0]), (4, None), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [None, 0.0]), (8, []), (9, [1.0, 2.0, 3.0]), (10, [1.0]), (11, [3.0])]
    found = whitening.whiten(table(spark, rows)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in found) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2), (3, 1), (3, 2), (10, 1), (11, 1)]
    one = {r["vec_id"]: r for r in found if r["component"] == 1}
    assert (one[1]["n"], one[1]["deviation"]) == (3, 256**2 + 512**2) and (one[10]["n"], one[10]["deviation"], abs(one[10]["whitened"]), one[10]["explained"]) == (2, 512**2, 1.0, 1.0)
    assert abs(sum(r["explained"] for r in found if r["vec_id"] == 1) - 1) < 1e-12
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitening.whiten(table(spark, few)).count() == 0
    # one direction has all the variance
    flat = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)])).collect()
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12


def test_numbers_of_any_size(spark):
    rng = np.random.default_rng(3)
    for size in (1e12, 1e45, 1e200):
        rows = [(i, (rng.standard_normal(3) * size * [3, 2, 1]).tolist()) for i in range(30)]
        found = whitening.whiten(table(spark, rows), components=2).collect()
        by = {(r["vec_id"], r["component"]): r for r in found}
        x = np.array([v for _, v in rows]) / size
        white = [np.array([by[i, c]["whitened"] for i in range(30)]) for c in (1, 2)]
        assert all(abs(w.mean()) < 1e-9 and abs(w.var() - 1) < 1e-9 for w in white) and found[0]["identity_error"] < 1e-12
        assert abs(by[0, 1]["explained"] - np.linalg.eigvalsh(np.cov(x.T))[-1] / np.trace(np.cov(x.T))) < 1e-9
        assert all(r["deviation"] is None for r in found)
