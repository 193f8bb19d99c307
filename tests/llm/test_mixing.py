import random
import re
from collections import defaultdict

import pytest

from folioscope.llm import mixing


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes, weights=(3, 1, 2), budget=1.5, cap=2.0):
    """By resharing the excess until no source is above its most."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = budget * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        if not open_:
            return fixed
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > cap * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in above}


def sample():
    r = random.Random(9)
    sources = ["a", "b", "Z", "é", None, "src0"]
    rows = [(i, " ".join(["w"] * r.choice((0, 1, 5, 20, 90))) + " #" * r.choice((0, 3)), r.choice(sources) if i % 3 else "src0") for i in range(2000)]
    return [*rows, (None, None, None), (5000, "", "empty"), (5001, "w " * 4000, "b")]


@pytest.mark.parametrize("ranges", [4096, 3])
def test_targets_and_sizes(spark, monkeypatch, ranges):
    monkeypatch.setattr(mixing, "RANGES", ranges)
    rows = sample()
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, size int").repartition(4)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    source = {i: s for i, _, s in rows}
    sizes, taken, target, biggest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for i, t, s in rows:
        sizes[s] += words(t)
        biggest[s] = max(biggest[s], words(t))
    for r in found:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["source_size"] == sizes[s] and 0 <= r["taken"] <= 2 * r["size"]
    for s, want in targets(sizes).items():
        assert abs(target[s] - want) < 1e-6
        assert abs(taken[s] - want) <= biggest[s] / 2 + 1e-6
    for s in sizes:  # whole epochs first
        epochs = int(target[s] / sizes[s]) if sizes[s] else 0
        assert all(r["taken"] in (epochs * r["size"], (epochs + 1) * r["size"]) for r in found if source[r["doc_id"]] == s)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, map(tuple, again))) == sorted(map(str, map(tuple, found)))


def test_expanded_rows_are_what_the_mix_takes(spark):
    docs = spark.createDataFrame(sample(), "doc_id long, text string, source string")
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect() if r["size"]}
    got = mixing.expand(docs)
    assert got.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in times.items() if n}


def test_repeated_rows_and_none(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x")] * 100 + [(2, "q " * 50, "y")] * 3, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    for i in (1, 2):
        mine = [r for r in found if r["doc_id"] == i]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= mine[0]["size"] / 2 + 1e-9
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.expand(docs.limit(0)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).first()["taken"] == 0


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame(sample(), "doc_id long, text string, source string")
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
