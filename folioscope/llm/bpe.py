"""Byte-level BPE encoding and decoding over a sentencepiece model made from a rank file.

The vocabulary (lines of base64 token and rank) is turned straight into a sentencepiece model
proto: every byte becomes one letter (U+0100 + byte), every token the string of its bytes'
letters with the negative rank as its score, and normalisation is the identity. Sentencepiece
merges the best-scored pair first and the leftmost on a tie, which is the order of ranks. Each
match of the pre-token pattern is encoded on its own; one that is itself a token is that token.
Decoding is the inverse mapping of ids to bytes.

Defined results: a null text encodes as the empty one, an empty text has no ids, null ids decode
as no bytes. Texts of any length are taken whole. Other columns pass through untouched.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of a worker's memory of encoded pre-tokens: entries, and letters of one entry.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 64
#: Rows that a worker encodes before it hands them on.
SLICE = 256


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def letters(data: bytes) -> str:
    return data.decode("latin-1").translate({b: b + 0x100 for b in range(256)})


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model: piece 0 is unknown, piece i + 1 the token with the i-th rank."""
    unknown, bpe = 2, 2  # SentencePiece.Type.UNKNOWN, TrainerSpec.ModelType.BPE
    pieces = [_field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, unknown)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(1, letters(token).encode()) + b"\x15" + struct.pack("<f", -float(rank)))
    no = (1 << 64) - 1
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, 0) + _field(41, no) + _field(42, no) + _field(43, no)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers, filled as pre-tokens come."""

    def __init__(self, data: bytes, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(data)
        self.ranks = {letters(t): struct.pack("<I", r) for t, r in ranks.items()}
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.ids = np.array([0, *(r for _, r in by_rank)], dtype="<u4")
        self.tokens = dict((r, t) for t, r in by_rank)
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.table = {b: b + 0x100 for b in range(256)}

    def __missing__(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.table)
        found = self.ranks.get(mapped)
        if found is None:
            found = self.ids[np.asarray(self.model.encode(mapped), dtype=np.int64)].tobytes()
        if len(piece) <= REMEMBERED_LENGTH:
            self[piece] = found
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    key = (hash(data), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


class ByteBPE:
    """``path``: a rank file that the driver can read; it is sent to the executors as it is (its
    size is the vocabulary's, about 1 MB, and doesn't grow with the data)."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            shared = spark.sparkContext.broadcast(f.read())

        @F.arrow_udf("binary")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = _codec(shared.value, pattern)
            for texts in batches:
                yield pa.array([codec.encode(t.as_py()) for t in texts], type=pa.binary())

        @F.arrow_udf("binary")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = _codec(shared.value, pattern)
            for ids in batches:
                yield pa.array([codec.decode(i.as_py()) for i in ids], type=pa.binary())

        self._encode, self._decode = encode, decode

    def encode(self, text: Column | str) -> Column:
        """Binary: the ids, four bytes each, little-endian."""
        return self._encode(text)

    def decode(self, ids: Column | str) -> Column:
        """Binary: the bytes that the ids stand for."""
        return self._decode(ids)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, ids (binary, four bytes each) and decoded (the bytes
    that those ids stand for). One Python worker does both, on slices of bounded size."""
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [codec.encode(t.as_py()) for t in part.column("text")]
                decoded = [codec.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    return round_trip(docs, path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
