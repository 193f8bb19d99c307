import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioscope.llm import jaccard


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets, seen = {n: shingle_set(t) for n, (_, t) in enumerate(rows)}, defaultdict(list)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, s in sets.items():
        for m, both in Counter(m for g in s for m in seen[g]).items():
            if 100 * both >= 75 * (len(s) + len(sets[m]) - both):
                a, b = sorted((find(m), find(n)))
                root[b] = a
        for g in s:
            seen[g].append(n)
    least = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)].append(i)
    found = ((i if i is not None else -1, len(sets[n]), min(least[find(n)], default=None) if sets[n] else i) for n, (i, _) in enumerate(rows))
    return sorted(found, key=lambda x: (x[0], x[1], x[2] is None, x[2]))


def sample(n=250):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocab) for _ in range(60)]
    bases = [[r.choice(vocab) for _ in range(r.choice((3, 5, 8, 40, 150, 400)))] for _ in range(40)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice((0, 0, 1, 2, 6, 15))):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.3:
            w += passage
        rows.append((i, " ".join(x.upper() if r.random() < 0.05 else x for x in w)))
    return rows


@pytest.mark.parametrize(("cell", "crowd"), [(2000, 64), (4, 1)])
def test_links_equal_brute_force(spark, monkeypatch, cell, crowd):
    monkeypatch.setattr(jaccard, "CELL", cell)  # 4: blocks and crowds are split into cells
    rows = sample()
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, component_id int").repartition(3)
    found = jaccard.link(docs, crowd).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute(rows)


def test_edges(spark):
    long_ = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "a b c d e"), (6, "a b c d e"), (None, "a b c d e"), (None, "only here of all"), (7, long_), (8, long_ + " end"), (9, "É one"), (10, "é one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard.link(docs).collect() if r["doc_id"] is not None)
    assert found == [x for x in brute(rows) if x[0] >= 0]
    nulls = sorted((r["component_id"] is None, r["component_id"]) for r in jaccard.link(docs).where("doc_id is null").collect())
    assert nulls == [(False, 6), (True, None)]
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 6, 7, 9, 10)] + [(True, 0)]
    assert jaccard.link(docs.limit(0)).count() == 0 and jaccard.keep_one(docs.limit(0)).count() == 0


def test_tree_finds_every_pair_within_the_bound():
    rng = np.random.default_rng(1)
    points = rng.poisson(rng.uniform(0.2, 6, (400, 1)), (400, jaccard.GROUPS)).astype(np.int32)
    points[::7] = points[0]
    sizes = points.sum(axis=1)
    want = {(i, j) for i in range(400) for j in range(i) if 175 * np.minimum(points[i], points[j]).sum() >= 75 * (sizes[i] + sizes[j])}
    got = {(max(a, b), min(a, b)) for i, j in jaccard.CountTree(points, sizes).pairs() for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == want


def test_similar_documents_always_meet():
    r = random.Random(2)
    ranks = np.random.default_rng(2).permutation(jaccard.COARSE).astype(np.uint64)
    met = 0
    for _ in range(400):
        words = [f"w{r.randrange(500)}".encode() for _ in range(r.choice((5, 9, 30, 200)))]
        other = list(words)
        for _ in range(r.randint(0, 1 + len(words) // 30)):
            other[r.randrange(len(other))] = b"new%d" % r.randrange(9)
        other += [b"more"] * r.randint(0, len(words) // 4)
        a, b = jaccard.shingles(words), jaccard.shingles(other)
        both = len(np.intersect1d(a, b))
        if both == len(a) == len(b) or 100 * both < 75 * (len(a) + len(b) - both):
            continue
        met += 1
        keys = [jaccard.first_keys(s, ranks) for s in (a, b)]
        h, name, size = np.concatenate(keys), np.repeat([0, 1], [len(k) for k in keys]), np.repeat([len(a), len(b)], [len(k) for k in keys])
        packed = jaccard._packed(h, name, size, 3).to_pylist()
        assert any(len(jaccard.meet(*jaccard._unpacked(x["keys"]), 64)[0]) for x in packed)
        assert any(len(jaccard.meet(*jaccard._unpacked(x["keys"]), 1)[2]) for x in packed)
    assert met > 50


def test_near_copies_meet_once_for_a_run_of_keys():
    rng = np.random.default_rng(5)
    ranks = rng.permutation(jaccard.COARSE).astype(np.uint64)
    shared = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([shared, rng.integers(0, 1 << 64, 20, dtype=np.uint64)])) for _ in range(10)]
    keys = [jaccard.first_keys(s, ranks) for s in sets]
    h, each = np.concatenate(keys), [len(k) for k in keys]
    name, size = np.repeat(np.arange(10), each), np.repeat([len(s) for s in sets], each)
    packed = jaccard._packed(h, name, size, 64, jaccard._before(h, each)).to_pylist()
    pairs = [p for x in packed for p in zip(*(v.tolist() for v in jaccard.meet(*jaccard._unpacked(x["keys"]), 64)[:2]), strict=True)]
    assert set(pairs) == {(a, b) for a in range(10) for b in range(a + 1, 10)}
    assert len(pairs) < 20 * 45  # about 50 for each pair of documents, one for each bucket, if all shared keys counted
