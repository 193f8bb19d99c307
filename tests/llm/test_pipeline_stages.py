"""Each stage of the pipeline against brute force over its own input."""

import base64
import hashlib
import random
import struct
from collections import Counter, defaultdict

import public_tokenizers
import test_jaccard
import test_lines
import test_mixing
import test_quality
import tiktoken

import corpus_pipeline
from folioscope.llm import lines, quality

STAGES = dict(corpus_pipeline.STAGES)
#: Columns of documents, and others whose names the stages use for themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line string, component long, kept boolean, size int, removed string"


def good(text):
    """What the rules keep, from counts of windows and lines."""
    n_words, _, _, _, repeated = test_quality.brute(text)
    if n_words < 10 or 100 * repeated > 20 * n_words:
        return False
    mine = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    again = [x for i, x in enumerate(mine) if x in mine[:i]]
    if len(again) > quality.LINES_LIMIT * len(mine) or sum(map(len, again)) > quality.LINE_CHARS_LIMIT * sum(map(len, mine)):
        return False
    return all(test_quality.brute_share(text, n) <= limit for n, limit in quality.NGRAM_LIMITS.items())


def corpus():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(2, 8)))
    vocabulary = [word() for _ in range(400)]
    line = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(4, 9)))
    shared = [line() for _ in range(4)]
    base = ["\n".join(line() for _ in range(r.randint(2, 6))) for _ in range(25)]
    texts = []
    for text in base:
        texts.append(text)
        for _ in range(r.randint(0, 3)):
            texts.append(" ".join(r.choice(vocabulary) if r.random() < 0.02 else w for w in text.replace("\n", " \n ").split(" ")))
    texts += [f"{x}\n{r.choice(shared)}\n{line()}" for x in base[:12]]
    texts += [None, "", "too short", "\n".join([shared[0]] * 8), " ".join(vocabulary[:12] * 6), "w " * 30]
    rows = [(i, t, "en", r.choice(("a", "b", None)), len(t or "")) for i, t in enumerate(texts)]
    return [(*x, "line", 7, False, 1, None) for x in rows]


def stage(spark, name, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = STAGES[name](spark, docs, "no folder")
    assert name == "byte-level BPE" or found.columns == docs.columns
    return [tuple(r) for r in found.collect()]


def test_stages_equal_brute_force(spark):
    rows = corpus()
    kept = stage(spark, "quality rules", rows)
    assert sorted(kept) == sorted(r for r in rows if good(r[1])) and 60 < len(kept) < len(rows) - 4

    cleaned = stage(spark, "line dedup", kept)
    gone = test_lines.brute([r[:2] for r in kept])
    want = {}
    for r in kept:
        out = {nth for nth, *_ in gone.get(r[0], [])}
        want[r[0]] = "\n".join(x for n, x in enumerate(r[1].split("\n")) if n not in out)
    assert {r[0]: r[1] for r in cleaned} == want and len(cleaned) == len(kept) and sum(map(len, gone.values())) > 30
    assert all(r[4] == len(r[1]) and r[5:] == ("line", 7, False, 1, None) for r in cleaned)

    for source in (cleaned, kept):  # what the stage before it has left, and whole near copies
        one = stage(spark, "n-gram Jaccard join", source)
        component = {i: c for i, n, c in test_jaccard.brute([r[:2] for r in source]) if n}
        first = {}
        for i in sorted(component):
            first.setdefault(component[i], i)
        assert sorted(r for r in source if r[0] not in component or first[component[r[0]]] == r[0]) == sorted(one)
    assert len(one) < len(kept) - 15

    mixed = stage(spark, "source mix", one)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in one:
        sizes[r[3]] += test_mixing.words(r[1])
    times = Counter(r[0] for r in mixed)
    assert {r[0]: r for r in mixed}.keys() <= {r[0] for r in one} and all(n <= 2 for n in times.values())
    for r in one:
        taken[r[3]] += times[r[0]] * test_mixing.words(r[1])
    biggest = max(test_mixing.words(r[1]) for r in one)
    assert all(abs(taken[s] - t) <= biggest / 2 for s, t in test_mixing.targets(sizes).items())
    assert sorted({r[0]: r for r in mixed}.values()) == sorted(r for r in one if times[r[0]])

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    coded = stage(spark, "byte-level BPE", mixed)
    pack = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
    want = []
    for r in mixed:
        ids = pack(library.encode_ordinary(r[1] or ""))
        want.append((r[0], len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted((i, n, bytes(b), a, c) for i, n, b, a, c in coded) == sorted(want)


def test_nulls_repeats_and_empty_tables(spark):
    text = " ".join(f"word{i} of many" for i in range(20))
    rows = [(None, text, None, None, None), (None, text, None, None, None), (1, text, "en", "a", 3), (1, text, "en", "a", 3), (2, None, None, None, None), (3, "", "x", "a", 0), (4, text + " more", None, None, 1), (4, "another " * 3 + " ".join(f"thing{i} else{i}" for i in range(30)), "en", "b", 9)]
    rows = [(*r, None, None, None, None, None) for r in rows]
    for name in STAGES:
        found = stage(spark, name, rows)
        assert stage(spark, name, []) == []
        ids = Counter(r[0] for r in found)
        if name == "quality rules":
            assert ids == {None: 2, 1: 2, 4: 2}
        elif name == "line dedup":
            assert sorted(((r[0] is None, r[0]), r[1]) for r in found if r[0] == 1) == [((False, 1), ""), ((False, 1), text)] and len(found) == len(rows)
        elif name == "n-gram Jaccard join":
            assert ids == {1: 1, 2: 1, 3: 1, 4: 1}
        elif name == "byte-level BPE":
            assert len(found) == len(rows)


def test_edits_of_short_lines_are_none():
    assert [int(lines.edits_of(n)) for n in (9, 10, 19, 20, 40)] == [0, 1, 1, 2, 3]
