import random
import re
from collections import Counter

from folioscope.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEYS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def brute_share(text, n):
    words = WORD.findall(text)
    seen, covered = set(), set()
    for i in range(len(words) - n + 1):
        w = tuple(words[i : i + n])
        if w in seen:
            covered |= set(range(i, i + n))
        seen.add(w)
    return sum(len(words[i]) for i in covered) / max(1, sum(map(len, words)))


def texts():
    r = random.Random(2)
    out = [None, "", "\n \n", "a", "a b c d e a b c d e", "a a a a a a\na a a a a a", "é ß\x1c x\x0by", "w " * 3000, "#*$%&|<> # a"]
    for _ in range(300):
        k = r.choice((2, 3, 30))
        out.append("".join(r.choice(("x", "yy", "zé", "#", "q%"))[: r.randint(1, 2)] * 1 + str(r.randrange(k)) + r.choice((" ", "\n", "\t", "\r\n")) for _ in range(r.randint(0, 60))))
    return out


def test_measures_equal_brute_force():
    for text in texts():
        found = quality.measure(text)
        assert tuple(found[k] for k in KEYS) == brute(text), text
        for n, share in zip(quality.NGRAM_LIMITS, found["ngram_shares"], strict=True):
            assert abs(share - brute_share(text or "", n)) < 1e-12


def test_report_and_filter(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    repeated = " ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"w{i}" for i in range(30))
    rows = [(1, clean, True, 9), (2, repeated, None, 9), (3, None, None, 9), (4, "too short", None, 9), (None, clean, None, 9), (None, clean, None, 9), (5, "\n".join([clean[:90]] * 5), None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean, m int")
    report = quality.quality_report(docs).collect()
    assert len(report) == len(rows)
    by = {r["doc_id"]: r for r in report}
    assert by[1]["kept"] and not by[1]["base_failed"]
    for i in (2, 3, 4, 5):
        assert not by[i]["kept"]
    assert by[3]["base_failed"] and by[3]["n_words"] == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1]
    assert quality.quality_report(docs.limit(0)).count() == 0
