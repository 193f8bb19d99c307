import numpy as np
import pytest

from folioscope.llm import vectors


def brute(ids, x, k=5, every=50):
    lengths = np.sqrt((x * x).sum(axis=1))
    out = {}
    for n in np.nonzero(ids % every == 0)[0]:
        s = (x * x[n]).sum(axis=1) / (lengths * lengths[n])
        order = sorted((-v, int(i)) for v, i, m in zip(s, ids, range(len(ids)), strict=True) if ids[m] != ids[n])
        out[int(ids[n])] = [(i, -v) for v, i in order[:k]]
    return out


@pytest.mark.parametrize("block", [8192, 300])
def test_recall_and_scores(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "VECTORS", block)
    monkeypatch.setattr(vectors, "QUERIES", 15)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 64))
    x[500:520] = x[3]  # a group of copies
    docs = spark.createDataFrame([(i, v.tolist(), "s") for i, v in enumerate(x)], "vec_id long, embedding array<float>, score string")
    stored = np.array([r["embedding"] for r in docs.orderBy("vec_id").collect()], dtype=np.float64)
    want = brute(np.arange(1500), stored)
    found = vectors.search(docs).collect()
    hits = total = 0
    for q, near in want.items():
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [r for r, *_ in got] == [1, 2, 3, 4, 5]
        assert all(a[2] >= b[2] for a, b in zip(got, got[1:], strict=False))
        hits += len({v for _, v, _ in got} & {v for v, _ in near})
        total += 5
        scores = dict(near)
        assert all(abs(s - scores[v]) < 1e-14 for _, v, s in got if v in scores)
    assert hits / total >= 0.9
    assert [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == 500), key=lambda r: r["rank"])] == [3, 501, 502, 503, 504]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [-1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (50, [1.0, 2.0, 3.5]), (100, []), (150, [0.5, 0.5])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in vectors.search(docs).collect())
    half = round(0.5**0.5, 6)
    assert found == [(0, 1, 1, half), (0, 2, 2, half), (0, 3, 150, half), (0, 4, 3, -1.0), (50, 1, 9, round(15.5 / (14 * 17.25) ** 0.5, 6)), (150, 1, 1, 1.0), (150, 2, 2, 1.0), (150, 3, 0, half), (150, 4, 3, -half)]
    assert vectors.search(docs.limit(0)).count() == 0
