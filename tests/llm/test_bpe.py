import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from folioscope.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
EDGES = [None, "", " ", "\n\n \t", "a" * 20_000, " " * 5_000, "<|endoftext|>", "don't WE'LL", "naïve ñ ß 漢字 العربية 😀​\x1c\x85", "x\x00y", "1234567 ½ ٣", "é"]


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.Codec(f.read(), PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_encodes_as_the_library(codec, library):
    r = random.Random(1)
    alphabet = [chr(c) for c in [*range(0x250), 0x2028, 0x3000, 0x4E00, 0x661, 0x301, 0x1F600, 0xFEFF]]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(4000)] + [x or "" for x in EDGES]
    for text in texts:
        ids = codec.encode(text)
        assert ids == pack(library.encode_ordinary(text)), text
        assert codec.decode(ids) == text.encode()


def test_every_token_survives(codec):
    for token, rank in bpe.read_ranks(open(PATH, "rb").read()).items():
        assert codec.decode(struct.pack("<I", rank)) == token


def test_digests(spark, library):
    rows = [(i, x, "extra", i) for i, x in enumerate(EDGES)] + [(None, "twice", None, 0), (None, "twice", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    found = bpe.token_digests(docs, PATH, PATTERN).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    for i, x in enumerate(EDGES):
        ids = library.encode_ordinary(x or "")
        assert tuple(by[i]) == (i, len(ids), hashlib.sha256(pack(ids)).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())
    assert bpe.token_digests(docs.limit(0), PATH, PATTERN).count() == 0


def test_column_functions(spark):
    codec = bpe.ByteBPE(spark, PATH, PATTERN)
    docs = spark.createDataFrame([("héllo wörld",), (None,)], "text string")
    found = docs.select("text", codec.encode("text").alias("ids")).select("text", codec.decode("ids").alias("back")).collect()
    assert [bytes(r["back"]).decode() for r in found] == ["héllo wörld", ""]
