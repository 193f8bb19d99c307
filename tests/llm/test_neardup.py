import numpy as np
import pytest

from folioscope.llm import neardup

SCHEMA = "vec_id long, embedding array<double>, label int, node string, links string"


def brute(rows, cosine=0.93):
    """Links and components over all pairs of rows (id, vector, label)."""
    good = [r[1] is not None and r[0] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if good[i] and good[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(v) / np.abs(v).max() for v in (a[1], b[1]))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = r[0] if least.get(find(i)) is None else min(least[find(i)], r[0])
    return sorted(((r[0], links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows)), key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in neardup.near_duplicates(df, **more).collect()), key=str)


def crowd(rng, dims, spread, n, label, start):
    """Vectors around few centres, so that many pairs lie near the threshold."""
    centres = rng.standard_normal((max(1, n // 12), dims))
    return [(start + i, (centres[i % len(centres)] + spread * rng.standard_normal(dims)).tolist(), label) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 256])
def test_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = crowd(rng, 64, 0.25, 700, 0, 0) + crowd(rng, 64, 0.27, 150, 1, 1000) + crowd(rng, 3, 0.3, 60, 1, 2000) + crowd(rng, 1, 0.3, 20, 1, 3000)
    rows += [(5000 + i, rows[3][1], 0) for i in range(40)] + [(6000, rows[3][1], 1), (7000, (np.array(rows[3][1]) * 1e200).tolist(), 0), (7001, (np.array(rows[3][1]) * 1e-300).tolist(), 0)]
    assert run(spark, rows) == brute(rows)


def test_bounds_keep_every_pair_and_drop_most():
    rng = np.random.default_rng(1)
    for dims, spread in ((64, 0.3), (1024, 0.27)):
        x = neardup.units(rng.standard_normal((400, dims)))
        y = neardup.units(np.vstack([x + spread * rng.standard_normal(x.shape) / np.sqrt(dims), rng.standard_normal((1600, dims))]))
        code, factor = neardup.codes(x @ neardup.rotation(dims))
        signs = (np.unpackbits(code, axis=1, count=dims) * 2.0 - 1) / np.sqrt(dims)
        s, real = signs @ (y @ neardup.rotation(dims)).T, x @ y.T
        least, most = neardup.bounds(factor, dims, 0.93)
        taken = (s >= least[:, None]) & (s <= most[:, None])
        assert taken[real >= 0.93].all() and (real >= 0.93).sum() > 100
        assert taken.mean() < 0.02
        error = s / factor[:, None] - real
        assert abs(error.mean()) < 0.01  # no bias
        assert (np.abs(error) <= neardup.EPSILON * np.sqrt((1 / factor**2 - 1) / (dims - 1))[:, None]).all()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [0.0, -0.0], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [None, 1.0], 0), (6, [], 0), (7, [1.0, 0.0], None), (None, [1.0, 0.0], 0), (8, [1.0, 0.0], 0), (8, [1.0, 0.0], 0), (9, [1.0, -0.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [2.0, 0.1], 0), (12, [-1.0, 0.0], 0), (8, [0.0, 1.0], 0), (13, [1.0, 0.0], 1)]
    found = run(spark, rows)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 10, 12, 13)] + [(8, 0, 8, True), (None, 0, None, True)]
    assert found == sorted([*alone, (8, 3, 8, True), (8, 3, 8, True), (9, 3, 8, False), (11, 3, 8, False)], key=str)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 0)]) == [(1, 0, 1, True)]
