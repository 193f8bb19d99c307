import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import lm


def make(n=300):
    r = random.Random(3)
    vocab = {"en": ["the", "of", "and", "ing", "thing"], "fr": ["le", "la", "eau", "été", "que"]}
    rows = []
    for i in range(n):
        words = vocab[r.choice(("en", "fr"))]
        rows.append((i, " ".join(r.choice(words) + (r.choice(("", "s", "X")) if r.random() < 0.2 else "") for _ in range(r.randint(0, 60)))))
    rows += [(2000 + i, " ".join(f"u{r.randrange(900)}" for _ in range(20))) for i in range(80)]
    return [*rows, (None, "the la"), (None, "the la"), (1000, None), (1001, "unheard-of Words"), (1002, "rare\x00one é x")]


@pytest.fixture(scope="module")
def scored(spark):
    rows = make()
    docs = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, score double")
    return rows, lm.score(docs).collect()


def test_base_is_exact(scored):
    rows, found = scored
    train = Counter()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    for i, t in rows:
        if not held(i):
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    want = sorted((i if i is not None else -1, held(i), len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found)
    assert got == want


def test_model_beats_the_base_on_held_out_documents(scored):
    held = [r for r in scored[1] if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_rare_words_go_through_the_join(spark, scored, monkeypatch):
    docs = spark.createDataFrame(make(), "doc_id long, text string")
    monkeypatch.setattr(lm, "TOP", 3)
    order = lambda rows: sorted(((r["doc_id"] or -1), r["n_known"], round(r["base_score"], 6), round(r["score"], 4)) for r in rows)
    assert order(lm.score(docs).collect()) == order(scored[1])


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.createDataFrame(make(), "doc_id long, text string")
    counts = lm.word_counts(docs)
    return lm.learn(docs, counts), {r["word"].encode(): r["c"] for r in counts.collect()}


def probability(learned, counts, before, last, word):
    """Of a word (None: the end) after two others, straight from the parameters."""
    p, items = lm.LogBilinear.unpack(learned["model"], learned["unigram"]).p, lm._Items(learned["own"])
    item = lambda w: 0 if w is None else items[w]
    r = p["context"][item(before) % lm.CONTEXTS] @ p["before"] + p["context"][item(last) % lm.CONTEXTS] @ p["last"]
    s = np.exp((p["out"] @ r + p["bias"]).astype(np.float64))
    output = item(word) // lm.CONTEXTS
    share = s[output] / s.sum()
    return share * (counts.get(word, 0) + 0.5) / 10 ** learned["class_logs"][output] if 0 < output <= lm.SUFFIXES else share


def test_probabilities_sum_to_one(learned):
    learned, counts = learned
    unseen = {}  # an unseen word of each class stands for all that are unseen
    for i in range(20_000):
        unseen.setdefault(lm._suffix(b"%05dz" % i if i % 2 else b"q%d" % i) % lm.SUFFIXES, b"%05dz" % i if i % 2 else b"q%d" % i)
    for a in range(33, 127):
        for b in range(33, 127):
            word = b"!?" + bytes([a, b]).lower()
            unseen.setdefault(lm._suffix(word) % lm.SUFFIXES, word)
    unseen = {k: w for k, w in unseen.items() if w not in counts}
    assert len(unseen) == lm.SUFFIXES
    words = [None, *(w for w, c in counts.items() if c), *unseen.values()]
    for context in ((None, None), (b"the", b"of"), (b"u7", b"la"), (b"new", None)):
        assert sum(probability(learned, counts, *context, w) for w in words) == pytest.approx(1, abs=1e-4)


def test_scores_are_sums_of_log_probabilities(learned, scored):
    learned, counts = learned
    for (_, text), r in zip(sorted(scored[0], key=str), sorted(scored[1], key=lambda r: str((r["doc_id"], {i: t for i, t in scored[0]}[r["doc_id"]]))), strict=True):
        words = [None, None, *lm.words_of(text), None]
        if r["n_tokens"] < 12:
            want = sum(math.log10(probability(learned, counts, *words[i - 2 : i + 1])) for i in range(2, len(words)))
            assert r["score"] == pytest.approx(want, abs=2e-3 * len(words)), text


def test_training_makes_the_model_better(learned):
    learned, _ = learned
    docs = [lm.words_of(t) for i, t in make(600) if i is not None and 300 <= i < 600]
    items = [lm._items_of(w, lm._Items(learned["own"])) for w in docs]
    contexts, outputs = np.concatenate([lm._contexts(x) for x in items]), np.concatenate(items) // lm.CONTEXTS

    def mean(model):
        s = model.scores(contexts)
        s = s - s.max(axis=1, keepdims=True)
        return float((s[np.arange(len(s)), outputs] - np.log(np.exp(s).sum(axis=1))).mean())

    assert mean(lm.LogBilinear.unpack(learned["model"], learned["unigram"])) > mean(lm.LogBilinear.start(learned["unigram"])) + 0.3


def test_very_long_words_and_texts(spark):
    docs = spark.createDataFrame([(i, "w" * 100_000 + f" {i} end") for i in range(5)] + [(9, "some words " * 50_000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in lm.score(docs).collect()}
    assert found[9]["n_tokens"] == 100_001 and found[0]["n_tokens"] == 4 and all(math.isfinite(r["score"]) for r in found.values())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs).count() == 0
    held = next(i for i in range(100) if lm.is_held_out(i))
    only = lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert only["train_tokens"] == 0 and only["n_known"] == 0 and only["n_tokens"] == 3
