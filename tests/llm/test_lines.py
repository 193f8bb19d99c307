import random

import numpy as np
import pytest

from folioscope.llm import lines as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(r, line, times):
    s = list(line)
    for _ in range(times):
        i, what = r.randrange(len(s) + 1), r.randrange(3)
        if what == 0 or i == len(s):
            s.insert(i, r.choice("abcé"))
        elif what == 1:
            s[i] = r.choice("abcé")
        else:
            del s[i]
    return "".join(s)


def test_banded_distance():
    r = random.Random(4)
    for _ in range(5000):
        a = "".join(r.choice("abé ") for _ in range(r.randint(0, 25)))
        b = changed(r, a, r.randint(0, 4))
        for k in range(3):
            assert L.within(a, b, k) == (distance(a, b) <= k), (a, b, k)


def test_distances_of_many_pairs():
    r = random.Random(4)
    pairs = []
    for _ in range(3000):
        a = "".join(r.choice("abé ") for _ in range(r.randint(0, 90)))
        pairs.append(tuple(sorted((a, changed(r, a, r.randint(0, 30))), key=len)))
    limits = np.array([r.randint(0, L.BAND - 1) for _ in pairs])
    for (a, b), k, d in zip(pairs, limits.tolist(), L.banded(pairs, limits).tolist(), strict=True):
        want = distance(a, b)
        assert d == want if want <= k else d > k, (a, b, k)


def test_lines_of_up_to_63_edits_need_no_distance_one_by_one(monkeypatch):
    r = random.Random(10)
    left, right, want = [], [], []
    for n in (1250, 1800, 2400, 300):
        line = "".join(r.choice("abcdefgh é") for _ in range(n))
        edits = int(L.edits_of(n))
        for at, times in ((0, edits - 3), (n // 2, edits + 4)):
            s = list(line)
            for i in range(times):
                s[(at + i * (n // times)) % n] = "Z"
            left.append(line)
            right.append("".join(s))
            want.append(times <= edits)
        left.append(line)
        right.append("Z" * (edits // 2) + line)  # all on one side
        want.append(True)
    monkeypatch.setattr(L, "within", None)
    assert L.near_pairs(left, right).tolist() == want
    assert L.near_pairs(right, left).tolist() == want


def test_a_window_takes_its_rarest_gram():
    r, ranks = np.random.default_rng(3), np.random.default_rng(5).permutation(L.GROUPS).astype(np.uint64)
    for _ in range(50):
        codes = r.integers(1, 4, r.integers(12, 80)).astype(np.uint32)
        for k, width in ((5, 5), (5, 6), (8, 11), (10, 12)):
            h = L._rolled(codes, k)
            starts, places = L._chosen(h, k, width, ranks)
            v = [(int(ranks[x >> 16]), x & 0xFFFF, i) for i, x in enumerate(h.tolist())]
            want = [min(v[i : i + width - k + 1])[2] for i in range(len(codes) - width + 1)]
            assert places[np.searchsorted(starts, np.arange(len(want)), side="right") - 1].tolist() == want


def test_copies_meet_in_a_second_round(spark):
    r = random.Random(8)
    base = ["".join(r.choice("abcdefgh é") for _ in range(200)) for _ in range(2)]
    base.append(base[0][:40] + base[1][40:])  # shares segments with both, near neither
    rows = [(i, changed(r, base[i % 3], r.randint(0, 5))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: [tuple(y) for y in x["removed"]] for x in L.line_report(docs, 1).collect()}
    assert {i: v for i, v in got.items() if v} == brute(rows)


@pytest.mark.parametrize("piece", [1 << 19, 100])
def test_near_lines_always_meet(monkeypatch, piece):
    monkeypatch.setattr(L, "PIECE", piece)
    r = random.Random(5)
    ranks = np.random.default_rng(5).permutation(L.GROUPS).astype(np.uint64)
    for n in range(1500):
        a = "".join(r.choice("abcdefé ") for _ in range(r.choice((r.randint(10, 50), r.randint(10, 400)))))
        b = changed(r, a, r.randint(0, int(L.edits_of(len(a)))))
        if a == b or distance(a, b) > L.edits_of(min(len(a), len(b))):
            continue
        rows = []
        for name, x in enumerate((a, b)):
            h, keys = L._keys([(name, len(x), at, part) for at, part in L._pieces(x)], *L._kind(len(x)), ranks)
            keys["key"] = (h >> np.uint64(32)).astype(np.uint32)
            keys = L._some(keys, np.argsort(h))
            half = len(h) // 2
            again = L._joined([L._unpacked(x) for x in L._packed(keys, [0, half, len(h)] if half else [0, len(h)])])
            assert all((again[c] == keys[c]).all() for c in keys)
            rows.append(keys)
        assert any(len(x) for x, _, _ in L._met(L._joined(rows))), (n, a, b)


def brute(rows):
    """Kept places by document: the first line of each class of exact or near lines."""
    worded = lambda x: x.strip(" \t\n\x0b\x0c\r") != ""
    places = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if worded(x)]
    distinct = list(dict.fromkeys(x for *_, x in places))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(distinct):
        for b in distinct[n + 1 :]:
            k = L.edits_of(min(len(a), len(b)))
            if k and abs(len(a) - len(b)) <= k and distance(a, b) <= k:
                root[find(b)] = find(a)
    first = {}
    for i, k, x in sorted(places, key=lambda p: p[:2]):
        first.setdefault(find(x), (i, k))
    gone = {}
    for i, k, x in places:
        if first[find(x)] != (i, k):
            gone.setdefault(i, []).append((k, *first[find(x)]))
    return gone


def sample():
    r = random.Random(6)
    base = ["".join(r.choice("abcdefgh é") for _ in range(r.randint(5, 60))) for _ in range(30)] + ["short", "x", "", "   ", "tab\tline here now"]
    rows = []
    for i in range(120):
        rows.append((i, "\n".join(changed(r, r.choice(base), r.choice((0, 0, 1, 2, 3))) for _ in range(r.randint(0, 6)))))
    return rows


@pytest.mark.parametrize("crowd", [64, 1])
def test_report_and_texts_equal_brute_force(spark, crowd):  # 1: many keys need the second round
    rows = sample()
    docs = spark.createDataFrame([(i, t, "z", len(t)) for i, t in rows], "doc_id long, text string, line string, n_chars int").repartition(3)
    want = brute(rows)
    got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in L.line_report(docs, crowd).collect()}
    assert len(got) == len(rows)
    assert {i: v for i, v in got.items() if v} == want
    cleaned = L.drop_lines(docs, crowd)
    assert cleaned.columns == docs.columns
    for r in cleaned.collect():
        gone = {k for k, *_ in want.get(r["doc_id"], [])}
        text = "\n".join(x for k, x in enumerate(rows[r["doc_id"]][1].split("\n")) if k not in gone)
        assert (r["text"], r["n_chars"]) == (text, len(text))


def test_edges(spark):
    line = "the very same line of a text"
    rows = [(1, None), (2, ""), (3, f"{line}\nother words stand here"), (3, f"{line}\nother words stand here"), (None, line), (4, f"{line}!\n\n \n"), (5, "y" * 5000), (6, "y" * 5001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    report = L.line_report(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_lines"], r["n_removed"]) for r in report) == [(0, 1, 1), (1, 0, 0), (2, 0, 0), (3, 2, 0), (3, 2, 2), (4, 1, 1), (5, 1, 0), (6, 1, 1)]
    texts = sorted((r["doc_id"] or 0, r["text"]) for r in L.drop_lines(docs).collect() if r["doc_id"] != 1)
    assert texts == [(0, ""), (2, ""), (3, ""), (3, rows[2][1]), (4, "\n \n"), (5, "y" * 5000), (6, "")]
    assert L.line_report(docs.limit(0)).count() == 0 and L.drop_lines(docs.limit(0)).count() == 0


def test_long_lines_may_have_edits_in_proportion(spark):
    r = random.Random(9)
    rows = []
    for i, n in enumerate((30, 99, 166, 338, 700, 1500)):
        line = "".join(r.choice("abcdefgh é") for _ in range(n))
        near, word = changed(r, line, int(L.edits_of(n - n // 10))), line[:20] + "replaced" * (n // 400) + line[20 + 8 * (n // 400) :]
        far = line[: n // 2] + "Z" * (n // 40 + 3) + line[n // 2 + n // 40 + 3 :]
        rows += [(10 * i, line), (10 * i + 1, near), (10 * i + 2, word), (10 * i + 3, far)]
    rows += [(100, "ab " * 60), (101, "ab " * 40 + "cd" + "ab " * 19)]  # repeated segments
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert {i % 10 for i in want if i < 100} >= {1, 2} and 3 not in {i % 10 for i in want} and 101 in want
    got = {x["doc_id"]: [tuple(y) for y in x["removed"]] for x in L.line_report(docs).collect()}
    assert {i: v for i, v in got.items() if v} == want


def test_what_stands_beside_a_gram_keeps_unlike_lines_apart():
    r = random.Random(7)
    ranks = np.arange(L.GROUPS, dtype=np.uint64)
    shared, rows = "qzxwvkjyqzxw", []
    for name in range(40):  # one gram of twelve characters in the same place, and nothing else
        x = "".join(r.choice("abcdefgh") for _ in range(150))
        x = x[:70] + shared + x[82:]
        h, keys = L._keys([(name, len(x), 0, x)], *L._kind(len(x)), ranks)
        rows.append(keys | {"key": (h >> np.uint64(32)).astype(np.uint32)})
    assert sum(len(a) for a, _, _ in L._met(L._joined(rows), crowd=128)) < 80  # of 780 pairs
    # and none of them is in the second round of a crowd of others
    near = "".join(r.choice("abcdefgh") for _ in range(70)) + shared + "".join(r.choice("abcdefgh") for _ in range(68))
    for name in range(100, 120):
        h, keys = L._keys([(name, len(near), 0, near)], *L._kind(len(near)), ranks)
        rows.append(keys | {"key": (h >> np.uint64(32)).astype(np.uint32)})
    crowds = [more for _, _, more in L._met(L._joined(rows), crowd=4) if len(more["key"])]
    assert crowds and len({x for more in crowds for x in more["line"].tolist()}) < 40


def test_lines_of_a_crowd_are_counted_once_and_cells_compared_together(monkeypatch):
    r = random.Random(8)
    counted, calls, bags, banded = [], [], L._bags, L.banded
    monkeypatch.setattr(L, "_bags", lambda x: counted.append(len(x)) or bags(x))
    monkeypatch.setattr(L, "banded", lambda pairs, limits: calls.append(len(pairs)) or banded(pairs, limits))
    cells, want = [], set()
    for c in range(20):
        line = "".join(r.choice("abcdefgh é") for _ in range(200))
        texts = [changed(r, line, r.choice((0, 3, 9))) for _ in range(30)]
        names = np.arange(30) + 100 * c
        cells.append((names, names.copy(), texts, (np.arange(2), np.full(2, 7)), np.zeros(30, dtype=np.int32)))  # the first two meet elsewhere
        near = [(i, j) for i in range(30) for j in range(i) if (i, j) != (1, 0) and distance(texts[i], texts[j]) <= L.edits_of(min(len(texts[i]), len(texts[j])))]
        root = list(range(30))
        for i, j in near:
            root = [root[j] if x == root[i] else x for x in root]
        want |= {tuple(sorted(100 * c + i for i in range(30) if root[i] == k)) for k in set(root)}
    root = {int(x): int(x) for names, *_ in cells for x in names}
    for a, b in (link for links in L.crossed(iter(cells)) for link in links):
        assert root[a] != root[b]  # no more links than join the classes
        root = {x: root[a] if k == root[b] else k for x, k in root.items()}
    assert {tuple(sorted(x for x in root if root[x] == k)) for k in set(root.values())} == want
    assert sum(counted) == 600 and len(calls) <= 4
