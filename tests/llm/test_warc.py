import gzip
import hashlib
import io
import zlib

import pytest
from pyarrow import fs as pafs

from folioscope.llm import warc


def rows():
    x, z = "y" * 1000, "é" * 600
    return [(1, "u", x), (2, None, x), (9, "b", x), (None, "c", x), (3, "d", z), (3, "d", z), (4, "http://a b/\r\nX: y", "short"), (5, None, None), (6, "e", ""), (7, "q", "y" * 999), (8, "q", "y" * 999), (None, "n", "w" * 2000), (None, "n", "w" * 2000), (10, "r", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 50)]


def test_report(spark):
    docs = spark.createDataFrame([(*r, "extra") for r in rows()], "page_id long, url string, html string, digest string").repartition(3)
    found = warc.archive_report(docs).collect()
    assert len(found) == len(rows())
    for r in found:
        payloads = {(h or "").encode() for i, _, h in rows() if i == r["page_id"]}
        assert any((len(p), hashlib.sha1(p).hexdigest()) == (r["payload_bytes"], r["payload_digest"]) for p in payloads)
    kinds = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found)
    revisits = [k for k in kinds if k[2] == "revisit"]
    assert sorted(revisits, key=str) == sorted([("1", 1000, "revisit", 9), ("2", 1000, "revisit", 9), ("None", 1000, "revisit", 9), ("3", 1200, "revisit", 3), ("None", 2000, "revisit", None)], key=str)
    assert warc.archive_report(docs.limit(0)).count() == 0


def test_payloads_come_back(spark, tmp_path):
    docs = spark.createDataFrame(rows(), "page_id long, url string, html string")
    folder = f"file://{tmp_path}/a"
    archives = warc.write_archives(docs, folder, archive_bytes=2000)
    assert archives.count() > 2
    back = warc.read_archives(spark, folder, archives).where("record_type = 'response'").collect()
    for r in back:
        assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]


def test_normaliser_on_one_stream(tmp_path):
    """One member or several, with records over the edges of pieces; each record is then a member."""
    records = [warc.record(i, f"http://x/{i}", bytes([i % 251]) * (i * 997 % 70_000), "response", None) for i in range(60)]
    whole = b"".join(records)
    half = len(whole) // 2
    for name, data in (("one", gzip.compress(whole)), ("two", gzip.compress(whole[:half]) + gzip.compress(whole[half:]))):
        (tmp_path / name).write_bytes(data)
        fs = pafs.LocalFileSystem()
        source, target, index = (f"{tmp_path}/{name}{s}" for s in ("", ".warc.gz", ".index"))
        assert warc.normalise(fs, source, target, index) == 60
        assert gzip.decompress(open(target, "rb").read()) == whole
        assert [r["page_id"] for r in warc.read_archive(fs, target, index)] == list(range(60))


def test_damage_is_noticed():
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records_of(iter([warc.record(1, "u", b"x" * 100, "response", None)[:-50]])))
    with pytest.raises(zlib.error):
        list(warc.inflate(io.BytesIO(b"no gzip at all")))
