"""Secret scans: patterns find candidates, and a random forest takes out the false positives.

Candidates come from patterns that are meant to miss little: key formats with known prefixes,
values given to names like password or token, private key blocks, and long mixed strings. The
forest then judges each by its length and alphabet, how usual its characters' transitions are in
the corpus, how much of it dictionary words cover, words of its path, and the words around it.

Transitions and the dictionary are counted over all documents. The table of transitions has a fixed
size; the dictionary has the words that make up a share of all occurrences, so it grows with the
languages of the corpus. The forest is trained on labelled findings, at most ``LABELLED`` of them; by default they are
made here, from a seed, with the dictionary's words around them.

Defined results: a null or empty text has no findings; a null path has no words; texts of any
length are searched whole; rows that repeat give their findings each; findings of a text don't
overlap and come in order. Other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled findings that a forest is trained on at most; share of all words' occurrences that those of the dictionary have.
LABELLED, DICTIONARY = 20_000, 0.6
TREES, DEPTH, BINS, LEAST = 48, 8, 32, 4
CUTOFF, SEED, NEAR, CONTEXT = 0.5, 6, 3, 120
_FLUSH = 400_000
#: Characters of a value at least.
SHORTEST = 4

KINDS = ("aws_key", "token_prefix", "private_key", "assignment", "mixed_string")
#: Patterns of candidates, the special before the general; the named group is the secret itself. None
#: has an upper bound. A value in quotes goes to the quote that closes it, another to the next blank, without
#: the punctuation at its end. A private key goes to its END line, or without one
#: over the rows of base64 that follow.
PATTERN = re.compile(
    r"(?P<aws_key>(?<![A-Za-z0-9])(?-i:(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9]))"
    r"|(?P<token_prefix>(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}))"
    r"|(?P<private_key>-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:\s++[A-Za-z0-9+/]{32,}+={0,2})++(?:\s++[A-Za-z0-9+/=]++\s*+\Z)?)?)"
    r"|(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)(?:[_-][A-Za-z0-9]+)*+[\"']?[ \t]*+[:=][ \t]*+"
    r"(?:\"(?P<double_quoted>(?:[^\"\\\n]|\\.)*+)\"|'(?P<single_quoted>(?:[^'\\\n]|\\.)*+)'|[\"']?+(?P<assignment>\S{3,}[^\s.,;:!?)\]}>\"']))",
    re.IGNORECASE,
)
#: What is left between these: long runs with letters and digits.
MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_-])")
#: Words near a candidate: seven that ask for a secret, then those that speak against one.
SUSPECT_WORDS = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "example", "sample", "test", "dummy", "placeholder", "changeme", "commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "uuid", "guid", "id", "digest", "revision", "image", "base64")
ASKING, BENIGN = frozenset(SUSPECT_WORDS[:7]), frozenset(SUSPECT_WORDS[7:])
PATH_BENIGN, PATH_CONFIG = re.compile(r"test|spec|example|sample|fixture|mock|docs?\b|readme|lock", re.I), re.compile(r"\.env|config|settings|deploy|secret|credential|\.ya?ml|\.ini|\.tf|prod", re.I)
_words, _letters = re.compile(r"[^\W_]+").findall, re.compile(r"[^\W\d_]{3,}").findall


@dataclass
class Corpus:
    """Log-probabilities of a byte after another ([128, 128], A-Z in lower case, all above ASCII as
    127), and the most frequent words."""

    transitions: np.ndarray
    words: frozenset[str]

    def __post_init__(self):
        self.longest = max(map(len, self.words), default=0)
        self.starts = {w[:3] for w in self.words}

    def usual(self, value: str) -> float:
        b = np.minimum(np.frombuffer(value.lower().encode(), dtype=np.uint8), 127)
        return float(self.transitions[b[:-1], b[1:]].mean()) if len(b) > 1 else 0.0

    def coverage(self, value: str) -> float:
        """Share of characters inside dictionary words, the longest first at each place."""
        low, i, covered = value.lower(), 0, 0
        while i < len(low) - 2:
            if low[i : i + 3] in self.starts:
                for n in range(min(self.longest, len(low) - i), 2, -1):
                    if low[i : i + n] in self.words:
                        covered, i = covered + n, i + n
                        break
                else:
                    i += 1
            else:
                i += 1
        return covered / max(1, len(low))


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = np.zeros(128 * 128, dtype=np.int64)
    counts: Counter = Counter()

    def flush(words: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["item", "n"])
        words.clear()
        return out

    for batch in batches:
        for text in batch.column("text"):
            low = (text.as_py() or "").lower()
            b = np.minimum(np.frombuffer(low.encode(), dtype=np.uint8), 127).astype(np.int64)
            if len(b) > 1:
                np.add.at(pairs, b[:-1] * 128 + b[1:], 1)
            counts.update(_letters(low))
            if len(counts) > _FLUSH:
                yield flush(counts)
    yield flush(counts)
    yield flush(Counter({f"{i}": int(n) for i, n in enumerate(pairs) if n}))


def study(docs: DataFrame) -> Corpus:
    """Counts all documents' transitions and words; keeps the table and the top words that have the share
    DICTIONARY of all occurrences, and all that are as frequent as the last of them."""
    from folioscope.llm.common import cut

    counted = docs.select("text").mapInArrow(_transitions, "item string, n long").groupBy("item").agg(F.sum("n").alias("n"))
    counted = cut(counted, "secret-counts")
    number = F.col("item").rlike("^[0-9]")
    table = np.full((128, 128), 0.5)
    for r in counted.where(number).collect():  # at most 128 * 128
        table[int(r["item"]) // 128, int(r["item"]) % 128] += r["n"]
    words, total, least = counted.where(~number), 0, 0
    sizes = words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()  # far fewer than words: about the root of all occurrences
    wanted = DICTIONARY * sum(r["n"] * r["words"] for r in sizes)
    for r in sizes:
        if total >= wanted:
            break
        total, least = total + r["n"] * r["words"], r["n"]
    words = words.where(F.col("n") >= least).collect()
    return Corpus(np.log(table / table.sum(axis=1, keepdims=True)), frozenset(r["item"] for r in words))


FEATURES = ("length", "digits", "upper", "lower", "other", "entropy", "usual", "changes", "coverage", "hex", "repeats", "steps", "asking", "benign", "near_known", "benign_inside", "path_benign", "path_config", *KINDS)


def features(corpus: Corpus, kind: str, value: str, before: str, after: str, path: str | None) -> list[float]:
    n = max(1, len(value))
    codes = np.fromiter(map(ord, value), dtype=np.int64, count=len(value))
    group = np.select([(codes >= 48) & (codes <= 57), (codes >= 65) & (codes <= 90), (codes >= 97) & (codes <= 122)], [0, 1, 2], 3)
    shares = np.bincount(group, minlength=4) / n
    each = np.array(list(Counter(value).values())) / n
    gaps = np.diff(codes)
    around = [*_words(before.lower())[-NEAR - 1 :], *_words(after.lower())[:NEAR]]
    inside = value.lower()
    return [
        np.log(n), *shares, float(-(each * np.log2(each)).sum()), corpus.usual(value), float((np.diff(group) != 0).sum() / n), corpus.coverage(value),
        float(all(c in string.hexdigits for c in value)), float((gaps == 0).sum() / n), float((np.abs(gaps) == 1).sum() / n),
        float(sum(w in ASKING for w in around)), float(sum(w in BENIGN for w in around)), sum(w in corpus.words for w in around) / max(1, len(around)),
        float(any(w in inside for w in BENIGN if len(w) > 3) or bool(set(value) & set("${}"))),
        float(bool(path and PATH_BENIGN.search(path))), float(bool(path and PATH_CONFIG.search(path))), *(float(kind == k) for k in KINDS),
    ]


def candidates(text: str | None) -> Iterator[tuple[str, int, int, str, str, str]]:
    """kind, start, end, value, and what stands before and after."""
    text, at = text or "", 0
    found = [(a, b, k) for a, b, k in ((*m.span(m.lastgroup), m.lastgroup) for m in PATTERN.finditer(text)) if b - a >= SHORTEST]  # shorter: an empty value
    for start, stop, kind in [*found, (len(text), len(text), None)]:
        for m in MIXED.finditer(text, at, start):
            yield "mixed_string", *m.span(), m[0], text[max(0, m.start() - CONTEXT) : m.start()], text[m.end() : m.end() + CONTEXT]
        if kind:
            kind = "assignment" if kind in ("double_quoted", "single_quoted") else kind
            yield kind, start, stop, text[start:stop], text[max(0, start - CONTEXT) : start], text[stop : stop + CONTEXT]
        at = stop


class Forest:
    """Trees over features cut into quantile bins; each split is the best of a random few features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        self.trees = [self._grow(binned, y, rng.integers(0, len(y), len(y)), rng) for _ in range(TREES)]

    def _grow(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray, rng) -> list[tuple]:
        """Nodes as (feature, bin, left, right, share of positives); feature -1: a leaf."""
        nodes: list[tuple] = []

        def add(rows: np.ndarray, depth: int) -> int:
            at, share = len(nodes), float(y[rows].mean())
            nodes.append((-1, 0, 0, 0, share))
            if depth == DEPTH or len(rows) < 2 * LEAST or share in (0.0, 1.0):
                return at
            best = (1e-9, -1, 0)
            parent = len(rows) * share * (1 - share)
            for f in rng.choice(x.shape[1], int(np.sqrt(x.shape[1])) + 1, replace=False):
                n = np.cumsum(np.bincount(x[rows, f], minlength=BINS + 1))[:-1].astype(float)
                p = np.cumsum(np.bincount(x[rows, f], weights=y[rows], minlength=BINS + 1))[:-1]
                ok = (n >= LEAST) & (len(rows) - n >= LEAST)
                if not ok.any():
                    continue
                n, p, cuts = n[ok], p[ok], np.nonzero(ok)[0]
                rest, q = len(rows) - n, share * len(rows) - p
                gain = parent - p * (1 - p / n) - q * (1 - q / rest)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], int(f), int(cuts[i]))
            if best[1] >= 0:
                low = x[rows, best[1]] <= best[2]
                nodes[at] = (best[1], best[2], add(rows[low], depth + 1), add(rows[~low], depth + 1), share)
            return at

        add(rows, 0)
        return nodes

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of positives in the leaves that each row reaches."""
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        total = np.zeros(len(x))
        for nodes in self.trees:
            f, b, left, right, share = (np.array(c) for c in zip(*nodes, strict=True))
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                inner = f[at] >= 0
                low = binned[np.arange(len(x)), np.maximum(f[at], 0)] <= b[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def labelled_findings(words: list[str], n: int = 6000, seed: int = SEED) -> list[tuple[str, str, str, str, str | None, int]]:
    """kind, value, before, after, path, label (1: a secret): half and half, from a seed."""
    r = random.Random(seed)
    words = sorted(words) or ["word"]
    letters, upper = string.ascii_letters + string.digits, string.ascii_uppercase + "234567"
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    joined = lambda k, by="": by.join(r.choice(words) for _ in range(k))
    key_block = lambda rows: "\n".join(["-----BEGIN RSA PRIVATE KEY-----", *(pick(letters + "+/", 64) for _ in range(rows)), "-----END RSA PRIVATE KEY-----"])
    names = ("password", "passwd", "pwd", "secret", "token", "api_key", "access_key", "auth")
    paths = (None, "src1", "src12", "src7", "app/settings.py", "deploy/prod.yml", ".env", "tests/test_login.py", "docs/readme.md", "examples/config.ini")
    hexed = "0123456789abcdef"
    true = (
        lambda: ("aws_key", "AKIA" + pick(upper, 16), prose(6) + " ", " " + prose(5)),
        lambda: ("assignment", pick(hexed, r.choice((16, 18, 20, 32, 40, 64))), f"{prose(6)} {r.choice(names)}{r.choice(('=', ' = ', ': '))}{r.choice(('', chr(34)))}", " " + prose(5)),
        lambda: ("assignment", pick(letters + "!#%&*+-@^_", r.randint(8, 24)), f"{prose(6)} {r.choice(names)}{r.choice(('=', ' = ', ': '))}", " " + prose(5)),
        lambda: ("token_prefix", r.choice(("ghp_" + pick(letters, 36), "sk_live_" + pick(letters, 24), "xoxb-" + pick(string.digits, 11) + "-" + pick(letters, 24))), prose(6) + " ", " " + prose(5)),
        lambda: ("mixed_string", pick(letters + "+/", 40), f"{prose(4)} {r.choice(('secret', 'key', 'credential', ''))} ", " " + prose(5)),
        lambda: ("private_key", r.choice(("-----BEGIN RSA PRIVATE KEY-----", key_block(r.randint(3, 26)))), prose(4) + " ", " " + prose(5)),
    )
    false = (
        lambda: ("aws_key", "AKIA" + (joined(6).upper().encode("ascii", "ignore").decode() + "EXAMPLEEXAMPLEEX")[:9] + "EXAMPLE", prose(6) + " ", " " + prose(5)),
        lambda: ("assignment", r.choice(("changeme", "${PASSWORD}", "{{secret}}", "xxxxxxxx", "********", "example123", "your_password_here", "placeholder", "os.environ[KEY]", "123456789", "testtest1")), f"{prose(6)} {r.choice(names)}=", " " + prose(5)),
        lambda: ("assignment", joined(r.randint(1, 3), r.choice(("", "_", "-"))), f"{prose(6)} {r.choice(names)}: ", " " + prose(5)),
        lambda: ("mixed_string", pick(hexed, r.choice((32, 40, 64))), f"{prose(4)} {r.choice(('commit', 'sha1', 'md5', 'checksum', 'revision', 'digest'))} ", " " + prose(5)),
        lambda: ("mixed_string", "-".join(pick(hexed, k) for k in (8, 4, 4, 4, 12)), f"{prose(4)} {r.choice(('uuid', 'id', 'guid'))} ", " " + prose(5)),
        lambda: ("mixed_string", joined(r.randint(4, 6), r.choice(("_", "-", "/"))) + str(r.randint(1, 99)), prose(6) + " ", " " + prose(5)),
        lambda: ("mixed_string", pick(string.digits, r.randint(20, 30)), prose(6) + " ", " " + prose(5)),
    )
    out = []
    for i in range(n):
        label = i % 2
        kind, value, before, after = r.choice(true if label else false)()
        out.append((kind, value, before, after, r.choice(paths), label))
    return out


def train(corpus: Corpus, findings: list[tuple] | None = None) -> Forest:
    rows = findings if findings is not None else labelled_findings(list(corpus.words))
    if len(rows) > LABELLED:
        rows = random.Random(SEED).sample(rows, LABELLED)
    x = np.array([features(corpus, *r[:5]) for r in rows])
    return Forest(x, np.array([r[5] for r in rows]))


FOUND = "array<struct<kind:string,start:int,stop:int,value_sha256:string,score:double,is_secret:boolean>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value_sha256", pa.string()), ("score", pa.float64()), ("is_secret", pa.bool_())]))


def judge(docs: DataFrame, findings: list[tuple] | None = None) -> callable:
    """A function of text and path columns to the array of their findings; studies and trains first."""
    corpus = study(docs)
    shared = docs.sparkSession.sparkContext.broadcast((corpus, train(corpus, findings)))

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        corpus, forest = shared.value
        for texts, paths in batches:
            found, x = [], []
            for text, path in zip(texts, paths.to_pylist(), strict=True):
                mine = list(candidates(text.as_py()))
                x += [features(corpus, k, v, before, after, path) for k, _, _, v, before, after in mine]
                found.append([{"kind": k, "start": a, "stop": b, "value_sha256": hashlib.sha256(v.encode()).hexdigest()} for k, a, b, v, _, _ in mine])
            scores = iter(forest.predict(np.array(x)).tolist() if x else [])
            for row in found:
                for f in row:
                    f["score"] = next(scores)
                    f["is_secret"] = f["score"] >= CUTOFF
            yield pa.array(found, type=_FOUND)

    return run


def _path(docs: DataFrame) -> Column:
    return F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")


def scan(docs: DataFrame, findings: list[tuple] | None = None) -> DataFrame:
    """One row for each finding: doc_id, kind, start and stop (characters), value_sha256, score,
    is_secret."""
    found = judge(docs, findings)
    rows = docs.select("doc_id", found("text", _path(docs)).alias("found"))
    return rows.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def redact(docs: DataFrame, mask: str = "[secret]", findings: list[tuple] | None = None) -> DataFrame:
    """``docs`` with each secret replaced by ``mask``."""
    found = judge(docs, findings)
    rows = docs.select(F.struct("*").alias("row"), "text", F.filter(found("text", _path(docs)), lambda f: f["is_secret"]).alias("found"))
    n = F.length("text")
    step = lambda acc, f: F.struct(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, f["start"] - acc["at"]), F.lit(mask)).alias("out"), f["stop"].alias("at"))
    clean = F.aggregate("found", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, n)))
    rows = rows.withColumn("clean", F.when(F.size("found") > 0, clean).otherwise(F.col("text")))
    return rows.select(*(F.col("clean").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
