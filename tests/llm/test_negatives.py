import os

import duckdb
import numpy as np
import pytest

from folioscope.llm import negatives

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, windows string"


def brute(rows):
    """All anchors against all rows, in Python's integers."""
    low, high = negatives.LONG
    good = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            exact = [int(256) * n // d for n, d in (float(x).as_integer_ratio() for x in v)]
            good.append((i, exact, int(np.fmod(label + 1, 10)) if i % 7 == 0 else label))
    out = []
    for n, (i, v, label) in enumerate(good):
        if i % 100:
            continue
        scored = sorted((-min(high, max(low, sum(a * b for a, b in zip(v, w, strict=True)))), j, kind == label) for m, (j, w, kind) in enumerate(good) if m != n and len(w) == len(v))
        for p, j, _ in [x for x in scored if x[2]][:5]:
            fit = [x for x in scored if not x[2] and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
            out += [(i, j, r, k, -p, -s) for r, (s, k, _) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.hard_negatives(df).collect())


@pytest.mark.parametrize(("block", "group", "piece"), [(4096, 2048, 128), (256, 2, 2)])
def test_equals_all_pairs(spark, monkeypatch, block, group, piece):
    for k, v in (("BLOCK", block), ("GROUP", group), ("SLICE", piece)):
        monkeypatch.setattr(negatives, k, v)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((900, 16)) * 0.3
    x[300:420] = x[100]  # ties and repeated vectors
    rows = [(i, v.tolist(), int(rng.integers(3))) for i, v in enumerate(x)]
    rows += [rows[100]] * 3 + [rows[205]] * 12 + [(200, x[5].tolist(), 1)]
    rows += [(1000 + i, rng.integers(-2, 3, 3).astype(float).tolist(), int(rng.integers(2))) for i in range(0, 300, 5)]
    found = run(spark, rows)
    assert len(found) > 300 and found == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None, 1), (100, [nan, 1.0], 1), (200, [inf, 1.0], 1), (300, [None, 1.0], 1), (None, [1.0, 1.0], 1), (400, [1.0, 1.0], None), (500, [1.0, 1.0], 1), (501, [0.5, 1.0], 1), (502, [0.5, 0.5], 2), (503, [0.5, 0.5], 2), (600, [1.0, 2.0, 3.0], 1), (700, [-1.0, -1.0], -1), (702, [-1.0, -1.0], 0), (703, [-0.5, -0.25], 3), (800, [], 5), (801, [], 5), (802, [], 6)]
    rows += [(900, [1e300, 1.0], 8), (901, [1e300, -1.0], 8), (902, [1e-3, 1e200], 9), (903, [1e15, 1.0], 9), (1100, [5e6, 3e6], 8), (1101, [5e6, 0.0], 8), (1103, [2e6, 2e6], 9)]
    found = run(spark, rows)
    assert found == brute(rows) and {500, 700, 800, 1100} == {r[0] for r in found}
    assert run(spark, []) == [] and run(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []


def test_intervals_drop_pairs_before_the_last_plane():
    rng = np.random.default_rng(2)
    a, x = (negatives.integers(rng.standard_normal((n, 64)) / 8) for n in (20, 3000))
    seen = []
    keep = negatives.best(5)

    def counted(lower, upper, alive):
        exact = a @ x.T if alive.shape[1] == 3000 else None
        if exact is not None:
            assert (lower <= exact).all() and (upper >= exact).all()
        out = keep(lower, upper, alive)
        seen.append(int(out.sum()))
        return out

    ia, ix, scores = negatives.narrowed(a, x, np.ones((20, 3000), dtype=bool), counted)
    assert (scores == (a[ia] * x[ix]).sum(axis=1)).all()
    assert seen == sorted(seen, reverse=True) and len(seen) < 10 and seen[-1] * 8 <= 60_000
    assert all({*np.argsort(-(a[i] @ x.T), kind="stable")[:5]} <= {*ix[ia == i]} for i in range(20))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the bench tables are not here")
def test_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    want = con.sql(negatives.NEGATIVES_SQL)
    found = negatives.hard_negatives(spark.read.parquet(f"{DATA}/embeddings.parquet"))
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
