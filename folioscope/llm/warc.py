"""WARC writing, normalising and reading.

Pages are first written the way many crawlers do it: whole archives as one gzip stream. The
normaliser then inflates such a stream once, from start to end, finds the records by their
lengths, writes each again as a gzip member of its own, and writes a sidecar index with the offset
and length of each member, so that any record can be read alone. Reading back goes by the index.

Of the pages whose payloads are equal and at least ``REVISIT_BYTES`` long, the one with the
largest id holds the payload (response); the others are revisit records that name it.

Archives live in the shared folder and are reached through pyarrow's file systems. A task writes
archives under new names and reports them when they are complete, so a task that is run again
leaves nothing behind that is read.

Defined results: a null html is an empty payload; a null url becomes a urn with the page's id; rows
with the same id and payload stay apart (one of them is the response); a null id is kept as null
and sorts below all others; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import cut, scratch

REVISIT_BYTES = 1000
#: Payload bytes after which a task begins a new archive.
ARCHIVE_BYTES = 128 << 20
STREAM_LEVEL, MEMBER_LEVEL, CHUNK = 1, 4, 1 << 18
#: A fixed value of the WARC standard.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_SCHEMA = "archive string, sidecar string, records long, payload_bytes long"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def _id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _from_id(value: str) -> int | None:
    number = value.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, with the HTTP header block that carries the payload's full length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else _id(page_id)[1:-1]
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def inflate(stream) -> Iterator[bytes]:
    """The bytes behind a gzip stream of one or more members, in pieces of bounded size."""
    z = zlib.decompressobj(31)
    data = stream.read(CHUNK)
    while data:
        piece = z.decompress(data, CHUNK)
        data = z.unconsumed_tail
        if piece:
            yield piece
        if z.eof:
            data = z.unused_data
            z = zlib.decompressobj(31)
        if not data:
            data = stream.read(CHUNK)


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Each record's header fields and its whole bytes, from a stream of records."""
    held = bytearray()
    pieces = iter(pieces)

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        searched = 0
        while (end := held.find(b"\r\n\r\n", max(0, searched - 3))) < 0:
            searched = len(held)
            if not more():
                if held.strip():
                    raise ValueError("a WARC stream ends within a record's header")
                return
        head = fields(bytes(held[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("a WARC stream ends within a record")
        yield head, bytes(held[:size])
        del held[:size]


def normalise(fs, source: str, target: str, sidecar: str) -> int:
    """Rewrites a monolithic gzip stream with a member for each record and indexes the members."""
    n, offset = 0, 0
    with fs.open_input_stream(source, compression=None) as stream, fs.open_output_stream(target, compression=None) as out, fs.open_output_stream(sidecar, compression=None) as index:
        for head, data in records_of(inflate(stream)):
            z = zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, 31)
            member = z.compress(data) + z.flush()
            out.write(member)
            index.write(json.dumps([offset, len(member), head["warc-type"], head["warc-record-id"], head["warc-target-uri"]]).encode() + b"\n")
            offset += len(member)
            n += 1
    return n


def read_archive(fs, archive: str, sidecar: str) -> Iterator[dict]:
    """The records of a normalised archive, each read by its offset and checked."""
    with fs.open_input_file(archive) as f, fs.open_input_stream(sidecar, compression=None) as index:
        for line in index.read().splitlines():
            offset, length, *_ = json.loads(line)
            f.seek(offset)
            data = zlib.decompress(f.read(length), 31)
            end = data.index(b"\r\n\r\n")
            head = fields(data[:end])
            block = data[end + 4 : end + 4 + int(head["content-length"])]
            http = fields(block[: (split := block.index(b"\r\n\r\n"))])
            kind, digest = head["warc-type"], base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:"))
            payload = None if kind == "revisit" else block[split + 4 :]
            if payload is not None and (hashlib.sha1(payload).digest() != digest or len(payload) != int(http["content-length"])):
                raise ValueError(f"the record at {offset} of {archive} is damaged")
            yield {
                "page_id": _from_id(head["warc-record-id"]), "payload_bytes": int(http["content-length"]), "payload_digest": digest.hex(), "record_type": kind,
                "refers_to": _from_id(head["warc-refers-to"]) if kind == "revisit" else None, "target_uri": head["warc-target-uri"], "payload": payload,
            }


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, is_revisit, refers_to: which pages repeat the payload of another."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    long_ = F.octet_length("html") >= least
    lowest = -(1 << 63)
    by_payload = rows.where(long_).select(F.sha1("html").alias("digest"), F.coalesce("page_id", F.lit(lowest)).alias("id"))
    by_payload = by_payload.groupBy("digest", "id").agg(F.count("*").alias("n"))
    keepers = by_payload.groupBy("digest").agg(F.max(F.struct("id", "n")).alias("keeper"), F.sum("n").alias("n")).where("n > 1")
    keepers = cut(keepers.select("digest", F.col("keeper.id").alias("keeper_id"), F.col("keeper.n").alias("twins")), "warc-keepers")
    salted = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))  # short payloads have no keeper
    joined = rows.withColumn("digest", F.when(long_, F.sha1("html")).otherwise(salted)).join(keepers, "digest", "left")
    own = F.coalesce("page_id", F.lit(lowest)) == F.col("keeper_id")
    refers_to = F.when(F.col("keeper_id") > lowest, F.col("keeper_id"))
    out = joined.select("page_id", "url", "html", (F.col("keeper_id").isNotNull() & ~own).alias("is_revisit"), refers_to.alias("refers_to"), "digest", (own & (F.col("twins") > 1)).alias("twin"))
    if not keepers.where("twins > 1").isEmpty():  # the same page twice: one of its rows holds the payload
        twin = F.coalesce("twin", F.lit(False))
        nth = F.row_number().over(Window.partitionBy("digest").orderBy("url"))
        out = out.where(~twin).unionByName(out.where(twin).withColumn("is_revisit", nth > 1))
    return out.select("page_id", "url", "html", "is_revisit", F.when(F.col("is_revisit"), F.col("refers_to")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes normalised archives of all pages below ``folder`` and returns their list, a table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        open_: dict = {}

        def begin() -> None:
            name = f"{base}/{uuid.uuid4().hex}"
            open_.update(name=name, file=fs.open_output_stream(f"{name}.stream", compression=None), z=zlib.compressobj(STREAM_LEVEL, zlib.DEFLATED, 31), bytes=0, n=0)

        def close() -> pa.RecordBatch:
            name = open_["name"]
            open_["file"].write(open_["z"].flush())
            open_["file"].close()
            n = normalise(fs, f"{name}.stream", f"{name}.warc.gz", f"{name}.index")
            if n != open_["n"]:
                raise ValueError(f"{open_['n']} records were written and {n} found")
            fs.delete_file(f"{name}.stream")
            row = {"archive": [f"{name}.warc.gz"], "sidecar": [f"{name}.index"], "records": [n], "payload_bytes": [open_["bytes"]]}
            open_.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for page_id, url, html, is_revisit, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                if not open_:
                    begin()
                payload = html.as_py().encode()
                kind = "revisit" if is_revisit.as_py() else "response"
                open_["file"].write(open_["z"].compress(record(page_id.as_py(), url.as_py(), payload, kind, refers_to.as_py())))
                open_["n"] += 1
                open_["bytes"] += len(payload)
                if open_["bytes"] >= archive_bytes:
                    yield close()
        if open_:
            yield close()

    return cut(with_revisits(pages).mapInArrow(write, ARCHIVE_SCHEMA), "warc-list")


def read_archives(spark, folder: str, archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the listed archives; ``payloads``: with their bytes."""
    schema = RECORD_SCHEMA if payloads else RECORD_SCHEMA.removesuffix(", payload binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, _ = pafs.FileSystem.from_uri(folder)
        kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())] + [("payload", pa.binary())] * payloads)
        for batch in batches:
            for x in batch.to_pylist():
                held, size = [], 0
                for row in read_archive(fs, x["archive"], x["sidecar"]):
                    held.append(row)
                    size += len(row["payload"] or b"") * payloads
                    if len(held) >= 5000 or size >= 16 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=kinds)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=kinds)

    return archives.repartition(max(1, archives.count()), "archive").mapInArrow(read, schema)  # a task for each, or nearly


def archive_report(pages: DataFrame) -> DataFrame:
    """Writes all pages as archives and tells what reading them back finds, page by page."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    found = read_archives(spark, folder, write_archives(pages, folder), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")


#: For pages with an id and a url.
REPORT_SQL = """WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, encode(coalesce(html, '')) AS payload, url FROM pages),
 d AS (SELECT page_id, url AS target_uri, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < max(page_id) OVER (PARTITION BY payload_digest) THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 1000 AND page_id < max(page_id) OVER (PARTITION BY payload_digest) THEN max(page_id) OVER (PARTITION BY payload_digest) END AS refers_to, target_uri FROM d"""
