"""Language-model scoring with a log-bilinear neural model, trained by noise-contrastive estimation.

Counts of all words of all training documents are taken first. The OWN most frequent words have
output vectors of their own; every other word belongs to the class of its last two letters, which
has one, and is drawn within it by its smoothed count. The vectors of the two words before (those of
the CONTEXT most frequent, and of classes of last letters), each times the matrix of its place, sum
to a prediction, whose products with the output vectors, plus a bias, are the scores.

The model is fitted first on a sample of about WARM training tokens, then by one pass over all
training documents: each task goes on from there over its own, in batches, each with NOISE samples
drawn from the counts, and the results are averaged by tokens, in steps of FAN. For scoring, batched
matrix products over all contexts give what normalises them; they are as many as parameters say.

A document's words outside the TOP most frequent ones meet their counts in a join; none of those
can be frequent, but for words of more than WORD_BYTES bytes. Broadcast are the TOP words with
counts, the model, and what normalises each context: bounded by parameters, bytes of words included.

Defined results: A-Z count as lower case; a null or empty text has the end token only; a null id
counts as the empty text for the held-out rule; rows that repeat stay apart; without any training
document all counts are 0, and the model is the one it starts from. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut

#: Words with output vectors of their own at most, and classes of the others; words with context vectors of
#: their own. Outputs, and contexts too, are first the end, then the classes, then the words.
OWN, SUFFIXES, CONTEXT = 8192, 256, 255
CONTEXTS = 1 + SUFFIXES + CONTEXT
#: Most frequent words that are sent to all tasks, and bytes of each at most.
TOP, WORD_BYTES = 200_000, 64
SIZE, NOISE, BATCH, SEED = 32, 32, 2048, 3
#: Tokens of the first fit, how often it sees them, and the step of all fits; models averaged at once.
WARM, TURNS, RATE, FAN = 1_000_000, 3, 0.1, 16
_FLUSH, _REMEMBERED = 400_000, 300_000
LN10 = float(np.log(10.0))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def _suffix(word: bytes) -> int:
    """A hash of the last two characters, which are whole within the last eight bytes."""
    tail = word[-2:]
    return zlib.crc32(tail if tail.isascii() else word[-8:].decode(errors="ignore")[-2:].encode())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts in training documents and in all."""
    train, held = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        words = list(train.keys() | held.keys())
        a, b = [train[w] for w in words], [held[w] for w in words]
        train.clear()
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words]), pa.array(a, pa.int64()), pa.array([x + y for x, y in zip(a, b, strict=True)], pa.int64())], names=["word", "c", "c_all"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            (held if is_held_out(doc_id) else train).update(words_of(text.as_py()))
            if len(train) + len(held) > _FLUSH:
                yield flush()
    if train or held:
        yield flush()


class _Items(dict):
    """Word -> its output times CONTEXTS, plus its context; filled as words come."""

    def __init__(self, own: list[bytes]):
        super().__init__()
        self.own = {w: i for i, w in enumerate(own, 1 + SUFFIXES)}

    def __missing__(self, word: bytes) -> int:
        output = self.own.get(word)
        if output and output < CONTEXTS:
            found = output * CONTEXTS + output
        else:
            of_class = 1 + _suffix(word) % SUFFIXES
            found = (output or of_class) * CONTEXTS + of_class
        if len(self) < _REMEMBERED:
            self[word] = found
        return found


def _contexts(items: np.ndarray) -> np.ndarray:
    """For each token (the last one is the end) the contexts of the two before it, as one number."""
    two = np.concatenate([[0, 0], items[:-1] % CONTEXTS])
    return two[:-1] * CONTEXTS + two[1:]


def _items_of(words: list[bytes], lookup: _Items) -> np.ndarray:
    out = np.zeros(len(words) + 1, dtype=np.int64)
    out[:-1] = np.fromiter(map(lookup.__getitem__, words), dtype=np.int64, count=len(words))
    return out


class LogBilinear:
    """before, last: matrices of the places; context, out: vectors; bias; and the squares of the steps so far."""

    def __init__(self, parameters: dict[str, np.ndarray], unigram: np.ndarray, squares: dict[str, np.ndarray] | None = None):
        self.p, self.unigram = parameters, unigram
        self.squares = squares or {k: np.full(x, 0.1, dtype=np.float32) for k, x in self.shapes(unigram).items()}
        self.log_noise = np.log(NOISE * unigram).astype(np.float32)
        self.upto = np.cumsum(unigram)

    @staticmethod
    def shapes(unigram: np.ndarray) -> dict[str, tuple[int, ...]]:
        return {"before": (SIZE, SIZE), "last": (SIZE, SIZE), "context": (CONTEXTS, SIZE), "out": (len(unigram), SIZE), "bias": (len(unigram),)}

    @classmethod
    def start(cls, unigram: np.ndarray) -> LogBilinear:
        rng = np.random.default_rng(SEED)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        eye = np.eye(SIZE, dtype=np.float32)
        return cls({"before": eye * 0.5, "last": eye.copy(), "context": small(CONTEXTS, SIZE), "out": small(len(unigram), SIZE) * 0.1, "bias": np.log(unigram).astype(np.float32)}, unigram)

    def predictions(self) -> tuple[np.ndarray, np.ndarray]:
        """What each context adds in each place."""
        return self.p["context"] @ self.p["before"], self.p["context"] @ self.p["last"]

    def scores(self, contexts: np.ndarray) -> np.ndarray:
        """Scores of all outputs after each context."""
        before, last = self.predictions()
        return (before[contexts // CONTEXTS] + last[contexts % CONTEXTS]) @ self.p["out"].T + self.p["bias"]

    def log_totals(self, first: int, last: int) -> np.ndarray:
        """Logarithms of the totals over all outputs, for a range of contexts."""
        out = np.empty(last - first)
        for at in range(first, last, 512):
            s = self.scores(np.arange(at, min(last, at + 512)))
            most = s.max(axis=1, keepdims=True)
            s -= most
            np.exp(s, out=s)
            out[at - first : at - first + len(s)] = np.log(s.sum(axis=1)) + most[:, 0]
        return out

    def _step(self, name: str, at: np.ndarray | slice, gradient: np.ndarray, rate: float) -> None:
        self.squares[name][at] += gradient * gradient
        self.p[name][at] += rate * gradient / np.sqrt(self.squares[name][at])

    def learn(self, contexts: np.ndarray, outputs: np.ndarray, rate: float, rng: np.random.Generator) -> None:
        """One batch: its tokens against noise that they share."""
        p = self.p
        noise = np.searchsorted(self.upto[:-1], rng.random(NOISE) * self.upto[-1], side="right")
        c1, c2 = np.divmod(contexts, CONTEXTS)
        before, last = self.predictions()
        r = before.take(c1, axis=0)
        r += last.take(c2, axis=0)
        mine, theirs = p["out"].take(outputs, axis=0), p["out"][noise]
        real = np.einsum("ij,ij->i", r, mine) + (p["bias"] - self.log_noise).take(outputs)
        made = r @ theirs.T + (p["bias"][noise] - self.log_noise[noise])
        g = 1 / (1 + np.exp(np.clip(real, -30, 30)))
        h = -1 / (1 + np.exp(-np.clip(made, -30, 30)))
        mine *= g[:, None]
        back = h @ theirs
        back += mine
        rows = np.empty((len(outputs) + NOISE, SIZE + 1), dtype=np.float32)
        np.multiply(g[:, None], r, out=rows[: len(outputs), :-1])
        rows[: len(outputs), -1] = g
        rows[len(outputs) :, :-1], rows[len(outputs) :, -1] = h.T @ r, h.sum(axis=0)
        ids, sums = _sum_by(np.concatenate([outputs, noise]), rows)
        of_context = np.zeros((2, CONTEXTS, SIZE), dtype=np.float32)
        for sums_, c in zip(of_context, (c1, c2), strict=True):
            of, some = _sum_by(c, back)
            sums_[of] = some
        context = of_context[0] @ p["before"].T + of_context[1] @ p["last"].T
        matrices = p["context"].T @ of_context[0], p["context"].T @ of_context[1]
        scale = np.float32(1 / np.sqrt(len(outputs)))
        self._step("out", ids, sums[:, :-1] * scale, rate)
        self._step("bias", ids, sums[:, -1] * scale, rate)
        self._step("context", slice(None), context * scale, rate)  # contexts that aren't there have no gradient
        for name, gradient in zip(("before", "last"), matrices, strict=True):
            self._step(name, slice(None), gradient * scale, rate * 0.1)

    def pack(self) -> bytes:
        return b"".join(x[k].astype("<f4").tobytes() for x in (self.p, self.squares) for k in self.shapes(self.unigram))

    @classmethod
    def unpack(cls, data: bytes, unigram: np.ndarray) -> LogBilinear:
        flat, at, found = np.frombuffer(data, dtype="<f4").copy(), 0, []
        for _ in range(2):
            found.append({})
            for k, shape in cls.shapes(unigram).items():
                n = int(np.prod(shape))
                found[-1][k], at = flat[at : at + n].reshape(shape), at + n
        return cls(found[0], unigram, found[1])


def _sum_by(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of each id."""
    ids = ids.astype(np.uint16 if ids.max() < 1 << 16 else np.int64)  # short numbers are sorted by digits
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.nonzero(np.append(True, ids[1:] != ids[:-1]))[0]
    return ids[first], np.add.reduceat(rows.take(order, axis=0), first, axis=0)


def _fit(start, turns: int):
    """n, model: the tokens of a task's training documents, and the model after them. ``start``: a
    broadcast of words, unigram and model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, unigram, data = start.value
        lookup, model, rng = _Items(own), LogBilinear.unpack(data, unigram), np.random.default_rng(SEED)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n, waiting = 0, 0

        def learn(all_: bool) -> None:
            nonlocal waiting
            contexts, outputs = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = rng.permutation(len(outputs))
            for at in range(0, len(order) if all_ else len(order) // BATCH * BATCH, BATCH):
                some = order[at : at + BATCH]
                model.learn(contexts[some], outputs[some], RATE, rng)
            waiting = 0 if all_ else len(order) % BATCH
            if waiting:
                held.append((contexts[order[-waiting:]], outputs[order[-waiting:]]))

        whole = []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if not is_held_out(doc_id):
                    items = _items_of(words_of(text.as_py()), lookup)
                    held.append((_contexts(items), items // CONTEXTS))
                    n += len(items)
                    waiting += len(items)
                    if turns > 1:
                        whole.append(held.pop())
                    elif waiting >= 256 * BATCH:
                        learn(False)
        for _ in range(turns if whole else 0):
            held += whole
            learn(True)
        if held:
            learn(True)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([model.pack()], pa.binary())], names=["n", "model"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of a group's models by their tokens; a group's rows are all those of a partition."""
    total, n = None, 0
    for batch in batches:
        for k, data in zip(batch.column("n").to_pylist(), batch.column("model"), strict=True):
            one = np.frombuffer(data.as_buffer(), dtype="<f4").astype(np.float64) * k
            total, n = one if total is None else total + one, n + k
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype("<f4").tobytes()], pa.binary())], names=["n", "model"])


_MODEL = "n long, model binary"


def fit(docs: DataFrame, own: list[bytes], unigram: np.ndarray, tokens: int) -> LogBilinear:
    """The model after the first fit and the pass over all."""
    spark = docs.sparkSession
    model = LogBilinear.start(unigram)
    if not tokens:
        return model
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    some = rows.sample(min(1.0, WARM / tokens), SEED) if tokens > WARM else rows
    share = spark.sparkContext.broadcast((own, unigram, model.pack()))
    # A table first, so that all tasks read the corpus and one reads the sample, in an order that stays.
    warm = cut(some, "lm-warm").coalesce(1).mapInArrow(_fit(share, TURNS), _MODEL).collect()
    share = spark.sparkContext.broadcast((own, unigram, warm[0]["model"] if warm else model.pack()))
    models = cut(rows.mapInArrow(_fit(share, 1), _MODEL), "lm-models")
    while (n := models.count()) > 1:
        models = cut(models.repartition(-(-n // FAN)).mapInArrow(_average, _MODEL), "lm-models")
    return LogBilinear.unpack(models.first()["model"], unigram)


def _log_totals(docs: DataFrame, model: LogBilinear) -> np.ndarray:
    """For each context what normalises its scores; as many numbers as there are contexts."""
    spark = docs.sparkSession
    share, step = spark.sparkContext.broadcast((model.unigram, model.pack())), CONTEXTS * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram, data = share.value
        model = LogBilinear.unpack(data, unigram)
        for batch in batches:
            for at in batch.column("id").to_pylist():
                found = model.log_totals(at, min(CONTEXTS**2, at + step))
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([found.astype("<f8").tobytes()], pa.binary())], names=["at", "logs"])

    blocks = spark.range(0, CONTEXTS**2, step).repartition(32)
    found = sorted((r["at"], r["logs"]) for r in blocks.mapInArrow(run, "at long, logs binary").collect())
    return np.concatenate([np.frombuffer(x, dtype="<f8") for _, x in found])


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c (in training documents), c_all: of all documents."""
    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_count, "word string, c long, c_all long")
    return cut(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all")), "lm-counts")


class Scorer:
    """What a worker needs to score texts; made once from the broadcast pieces."""

    def __init__(self, words: bytes, counts: np.ndarray, own: list[bytes], class_logs: np.ndarray, end: tuple[bool, float], base_log: float, model: bytes, unigram: np.ndarray, log_totals: np.ndarray):
        frequent = words.split(b" ") if words else []
        self.items = _Items(own)
        self.place = {w: i for i, w in enumerate(frequent)}
        self.item_of = np.array([self.items[w] for w in frequent] + [0])
        self.log_of = np.append(np.log10(counts + 0.5), 0.0)  # the last of each is for words that aren't there
        self.seen = np.append(counts > 0, False)
        self.class_logs, self.end, self.base_log = class_logs, end, base_log
        m = LogBilinear.unpack(model, unigram)
        self.before, self.last = m.predictions()
        self.out, self.bias, self.log_totals = m.p["out"], m.p["bias"], log_totals

    def score(self, text: str | None) -> tuple[int, int, float, float, Counter]:
        """n_tokens, and of the words among the most frequent and the end token: how many are known,
        the base score and the model's score; and the other words, whose counts are still to come.
        Denominators are in for all tokens."""
        words = words_of(text)
        n = len(words) + 1
        at = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=n - 1)
        items = np.zeros(n, dtype=np.int64)
        items[:-1] = self.item_of[at]
        missing = at < 0
        rest = list(compress(words, missing.tolist())) if missing.any() else []
        items[:-1][missing] = np.fromiter(map(self.items.__getitem__, rest), dtype=np.int64, count=len(rest))
        logs = self.log_of[at]
        base = logs.sum() + self.end[1] - n * self.base_log
        outputs = items // CONTEXTS
        within = logs[outputs[:-1] <= SUFFIXES].sum() - self.class_logs[outputs].sum()
        model = 0.0
        contexts = _contexts(items)
        for i in range(0, n, 1 << 16):
            c, o = contexts[i : i + (1 << 16)], outputs[i : i + (1 << 16)]
            r = self.before.take(c // CONTEXTS, axis=0) + self.last.take(c % CONTEXTS, axis=0)
            model += float((np.einsum("ij,ij->i", r, self.out.take(o, axis=0)) + self.bias[o] - self.log_totals[c]).sum(dtype=np.float64)) / LN10
        return n, int(self.seen[at].sum()) + self.end[0], float(base), model + within, Counter(rest)


_scorers: dict[str, Scorer] = {}


def _score(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(**shared.value)
        scorer = _scorers[key]
        kinds = pa.schema([("uid", pa.int64()), ("word", pa.string()), ("times", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])

        def rest_rows(owners: list, words: list, times: list) -> pa.RecordBatch:
            columns = [pa.array(owners, pa.int64()), pa.array(words, pa.string()), pa.array(times, pa.int64())]
            out = pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(owners), t.type) for t in list(kinds)[3:])], schema=kinds)
            for x in (owners, words, times):
                x.clear()
            return out

        for batch in batches:
            own: list[tuple] = []
            owners: list[int] = []
            words: list[str] = []
            times: list[int] = []
            for uid, doc_id, text in zip(batch.column("uid").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                n, known, base, model, rest = scorer.score(text.as_py())
                # the document's own row goes by a key that no word can be
                own.append((uid, f" {uid}", 0, doc_id, int(is_held_out(doc_id)), n, known, base, model))
                owners += [uid] * len(rest)
                words += [w.decode() for w in rest]
                times += rest.values()
                if len(owners) > 50_000:
                    yield rest_rows(owners, words, times)
            yield rest_rows(owners, words, times)
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*own, strict=True), kinds, strict=True)] if own else [pa.nulls(0, t.type) for t in kinds], schema=kinds)

    return run


def _frequent(counts: DataFrame, c: str, most: int) -> DataFrame:
    """word, c of the words with the highest counts ``c``, all that share one or none, at most so many."""
    sizes = counts.where(F.col(c) > 0).groupBy(c).agg(F.count("*").alias("words")).orderBy(F.desc(c)).collect()  # far fewer than words: about the root of all tokens
    total, least = 0, None
    for r in sizes:
        total += r["words"]
        if total > most:
            break
        least = r[c]
    return counts.where(F.lit(False) if least is None else F.col(c) >= least).select("word", "c")


def learn(docs: DataFrame, counts: DataFrame) -> dict:
    """All that scoring takes, by name; ``tokens``: of the training documents."""
    ends = docs.select(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)).alias("r")).where("r <> 1").count()
    seen = counts.where("c > 0")
    n_words, v_words = seen.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n_words + ends, v_words + (ends > 0)
    short = counts.where(F.octet_length("word") <= WORD_BYTES)
    own = sorted((-r["c"], r["word"].encode()) for r in _frequent(short, "c", OWN).collect())
    top = dict(zip(*(x.to_pylist() for x in _frequent(short, "c_all", TOP).toArrow().columns), strict=True))
    top = {w.encode(): c for w, c in top.items()} | {w: -c for c, w in own}
    # occurrences and words by output; those of classes without the words that have one of their own
    inside, spread = np.zeros(1 + SUFFIXES + len(own)), np.zeros(1 + SUFFIXES)
    inside[0] = ends
    for r in seen.groupBy(F.pmod(F.crc32(F.right("word", F.lit(2))), F.lit(SUFFIXES)).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        inside[1 + r["k"]], spread[1 + r["k"]] = r["n"], r["v"]
    for i, (c, w) in enumerate(own, 1 + SUFFIXES):
        at = 1 + _suffix(w) % SUFFIXES
        inside[i], inside[at], spread[at] = -c, inside[at] + c, spread[at] - 1
    class_logs = np.zeros(len(inside))
    class_logs[1 : 1 + SUFFIXES] = np.log10(inside[1 : 1 + SUFFIXES] + 0.5 * (spread[1:] + 1))
    unigram = (inside + 0.5) / (inside + 0.5).sum()
    words = [w for _, w in own]
    model = fit(docs, words, unigram, n)
    return {
        "words": b" ".join(top), "counts": np.array(list(top.values()), dtype=np.int64), "own": words, "class_logs": class_logs, "end": (ends > 0, float(np.log10(ends + 0.5))),
        "base_log": float(np.log10(n + 0.5 * (v + 1))), "model": model.pack(), "unigram": unigram, "log_totals": _log_totals(docs, model), "tokens": n,
    }


def score(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score (log10)."""
    spark = docs.sparkSession
    counts = word_counts(docs)
    learned = learn(docs, counts)
    n = learned.pop("tokens")
    shared = spark.sparkContext.broadcast(learned)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("uid"))
    scored = rows.mapInArrow(_score(shared, str(shared._jbroadcast.id())), "uid long, word string, times long, doc_id long, held_out int, n_tokens long, n_known long, base double, model double")
    counted = scored.join(counts.select("word", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    logs = F.when(F.col("times") > 0, F.col("times") * F.log10(c + 0.5)).otherwise(0.0)
    total = counted.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(c > 0, F.col("times")).otherwise(0))).alias("n_known"),
        (F.max("base") + F.sum(logs)).alias("base_score"), (F.max("model") + F.sum(logs)).alias("score"),
    )
    return total.select("doc_id", (F.col("held") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
