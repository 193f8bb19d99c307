import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from folioscope.plans.report import build_report, overview_tables
from folioscope.sources import images, layout, publish, records, sinks
from folioscope.sources.corpus import load_corpus
from folioscope.sources.store import shared_folder
from folioscope.streaming import results as stream

NS = "http://www.loc.gov/standards/alto/ns-v4#"


def alto(blocks, width="1000", height="2000", ns=NS, page=True):
    body = f'<Page WIDTH="{width}" HEIGHT="{height}" PHYSICAL_IMG_NR="3"><PrintSpace>{blocks}</PrintSpace></Page>' if page else ""
    return f'<?xml version="1.0"?><alto xmlns="{ns}"><Description><sourceImageInformation><fileName>p.tif</fileName></sourceImageInformation></Description><Tags><OtherTag ID="T1" LABEL="Main"/><LayoutTag ID="T2" LABEL="Stamp"/><OtherTag ID="T1" LABEL="Note"/><OtherTag ID="T3"/></Tags><Layout>{body}</Layout></alto>'


def block(id_="b", box=True, tags="T9 T2", lines="", points=""):
    at = 'HPOS="100" VPOS="200" WIDTH="500" HEIGHT="400"' if box else ""
    shape = f'<Shape><Polygon POINTS="{points}"/></Shape>' if points else ""
    return f'<TextBlock ID="{id_}" TAGREFS="{tags}" {at}>{shape}{lines}</TextBlock>'


LINES = '<TextLine ID="l1" BASELINE="1 2 3 4"><String CONTENT=" a " WC="0.5"/><String CONTENT="" WC="x"/><String CONTENT="b" WC="1"/></TextLine><TextLine ID="l2"><String CONTENT=""/></TextLine><TextLine ID="l3"><String CONTENT="c" WC="0.25"/></TextLine>'


@pytest.fixture
def corpus_dir(tmp_path):
    root = tmp_path / "data"
    files = {
        "alto/p1.xml": alto(block("b1", lines=LINES, points="0 0 10 0 10 10") + block("b2", box=False) + "<ComposedBlock>" + block("nested") + "</ComposedBlock>"),
        "alto/p2.xml": "<alto", "alto/p3.xml": alto("", page=False), "alto/p4.xml": alto(block(), width="0"), "alto/p5.xml": alto(block(points="1 2 3")), "alto/p6.xml": alto(block(), ns="http://other"),
        "ground-truth/alto/p1.xml": alto(block("b1", tags="T1", lines=LINES)),
        "ground-truth/p7.json": json.dumps({"image": "p7.tif", "image_width": 10, "image_height": 20, "regions": [{"id": "r", "type": "main_text", "bbox": [1, 2, 3, 4], "notes": "n", "review_status": "human_corrected", "transcription": "t"}]}),
        "ground-truth/p8.json": json.dumps({"image": "p8.tif", "regions": []}),
        "ground-truth/p9.json": json.dumps({"image": "x", "image_width": 1, "image_height": 1, "coordinate_system": "pixels", "regions": []}),
        "results/p1/m1/seg.json": json.dumps({"task": "segmentation", "model": "m1", "prompt_version": "v1", "response": {"regions": [{"type": "Stamp", "bbox": [0, 0, 100, 100], "confidence": "0.95", "extra": [1]}, "no object", {"bbox": [1, 2, 3]}, {"type": "seal", "bbox": [0, 0, "50", 60], "id": "own"}]}}),
        "results/p1/m2/bad.json": json.dumps({"task": "segmentation", "response": {"regions": [{"bbox": [0, 0, 10, 10]}, {"bbox": [9, 0, 1, 10]}]}}),
        "results/p1/m2/text.json": json.dumps({"task": "segmentation", "response": {"regions": [{"bbox": [0, 0, "x", 10]}]}}),
        "results/p1/m3/list.json": "[1]", "results/p1/m3/broken.json": "{", "results/p1/m3/none.json": json.dumps({"task": "segmentation", "response": {}}), "results/short.json": "{}",
        "results/p1/m1/htr/b1-v.json": json.dumps({"task": "htr", "model": "m1", "region_id": "b1", "response": {"transcription": " a  b\n\nc"}}),
        "results/p10/m1/other.json": json.dumps({"task": "new", "response": {}}),
        "htr-inputs/p1.json": json.dumps({"coordinate_system": "normalized-1000", "regions": [{"id": "b1", "type": "main_text", "bbox": [100, 100, 600, 300]}]}),
        "htr-errors/p1/m2/b1.json": json.dumps({"model": "m2", "region_id": "b1", "error": "x"}),
        "corpus.json": json.dumps({"pages": {"p1": {"manuscript_id": "ms", "layout_review_complete": True}, "p7": {"manuscript_id": " ", "layout_review_complete": "true"}, "p0": 3}}),
        "images/p11.TIF": "x", "images/p11.png": "x", "images/notes.txt": "x",
    }
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content, encoding="utf-8")
    return root


def test_layout(spark, corpus_dir):
    blocks, issues = layout.read_layout(spark, str(corpus_dir / "alto"))
    rows = {r["id"]: r for r in blocks.where("page_id = 'p1'").collect()}
    assert sorted(rows) == ["b1", "b2"] and rows["b2"]["bbox"] is None
    b = rows["b1"]
    assert (b["block_type"], b["image"], b["width"], b["height"], b["image_number"]) == ("Stamp", "p.tif", 1000, 2000, 3)
    assert [x["text"] for x in b["lines"]] == [" a  b", "", "c"] and [x["confidence"] for x in b["lines"]] == [0.75, None, 0.25]
    assert tuple(b["lines"][0]["baseline"][1]) == (3.0, 4.0) and len(b["polygon"]) == 3
    assert {r["path"].split("/")[-1]: r["message"] for r in issues.collect()} == {"p2.xml": "malformed XML", "p3.xml": "no page", "p4.xml": "page without extent", "p5.xml": "malformed numbers", "p6.xml": "no page"}
    region = layout.layout_regions(blocks).first()
    assert (region["x1"], region["y1"], region["x2"], region["y2"], region["text"], region["confidence"], region["region_type"]) == (100.0, 100.0, 600.0, 300.0, " a  b\nc", 0.5, "stamp_or_seal")
    assert layout.layout_regions(blocks, blank_lines=True).first()["text"] == " a  b\n\nc"


def test_corpus(spark, corpus_dir):
    c = load_corpus(spark, str(corpus_dir))
    assert sorted(r[0] for r in c.pages.collect()) == sorted(["p1", "p2", "p3", "p4", "p5", "p6", "p7", "p8", "p9", "p10", "p11"])
    issues = {r["path"]: r["message"] for r in c.issues.collect()}
    assert issues["results/p1/m2/bad.json"] == issues["results/p1/m2/text.json"] == "invalid bounding box"
    assert issues["results/short.json"] == "expected page/model/name" and issues["ground-truth/p8.json"] == "required fields are missing" and issues["ground-truth/p9.json"] == "unsupported coordinates"
    assert {"results/p1/m3/list.json", "results/p1/m3/broken.json", "results/p1/m3/none.json", "alto/p2.xml"} <= set(issues) and "results/p10/m1/other.json" not in issues
    systems = [(r["system"], r["reviewed"], r["skipped_blocks"]) for r in c.systems.where("page_id = 'p1'").orderBy("sys_ord").collect()]
    assert systems == [("eScriptorium", False, 1), ("m1", False, 0), ("Human-corrected eScriptorium", True, 0)]
    drawn = [(r["id"], r["region_type"], r["confidence"]) for r in c.regions.where("system = 'm1'").orderBy("ord").collect()]
    assert drawn == [("m1-0000", "stamp_or_seal", 0.95), ("own", "stamp_or_seal", None)]
    assert [tuple(r) for r in c.manifest.orderBy("page_id").collect()] == [("p1", "ms", True), ("p7", " ", False)]
    assert {r["path"] for r in c.artifacts.where("reviewed_text").collect()} == {"ground-truth/p7.json", "ground-truth/alto/p1.xml"}
    t = {k: [tuple(r) for r in v.collect()] for k, v in overview_tables(c, spark, 1).items()}
    assert t["htr"] == [(1, 1, 2, 1)] and t["readings"] == [("eScriptorium", 1), ("m1", 1)] and t["failures"] == [("m2", 1)] and t["reviewed"] == [(2,)] and t["manuscripts"] == [(1, 1, False)]
    with pytest.raises(ValueError, match="no such folder"):
        load_corpus(spark, str(corpus_dir / "missing"))


def test_manifest_must_be_an_object(spark):
    rows = spark.createDataFrame([("a", "[1]"), ("b", "{"), ("c", '{"pages": 3}'), ("d", "{}")], "path string, json string").select("path", F.try_parse_json("json").alias("v"))
    pages, issues = records.parse_manifest(rows)
    assert pages.count() == 0 and sorted(r["path"] for r in issues.collect()) == ["a", "b", "c"]


def test_report_builds_again_without_touching_files(spark, corpus_dir, tmp_path):
    out = tmp_path / "report"
    files = lambda: {p: (p.read_bytes(), p.stat().st_mtime_ns) for p in out.rglob("*.html")}
    assert build_report(spark, str(corpus_dir), str(out), 1)["files"] == 14 and (out / "overview.html").is_file()
    before = files()
    page = publish.published(spark, str(out)).where("page_id = 'p1'").first()["file"]
    text = (out / page).read_text()
    assert "<td> a  b\n\nc</td>" in text and "What each system has there" in text and "no_counterpart" in text and "htr-errors/p1/m2/b1.json" in text
    assert "Method" in (out / "method.html").read_text()
    listed = [json.loads(x) for x in (out / "issues/000000.jsonl").read_text().splitlines()]
    assert {x["path"] for x in listed} >= {"alto/p2.xml", "results/short.json"} and len(listed) == len({(x["path"], x["message"]) for x in listed})
    assert build_report(spark, str(corpus_dir), str(out), 1) == {"written": 0, "removed": 0, "files": 14} and before == files()
    (corpus_dir / "results/p1/m1/seg.json").unlink()
    build_report(spark, str(corpus_dir), str(out), 1, only="p10")
    page = publish.published(spark, str(out)).where("page_id = 'p1'").first()["file"]
    assert (out / page).read_bytes() == before[out / page][0]
    with pytest.raises(ValueError, match="no such page"):
        build_report(spark, str(corpus_dir), str(out), 1, only="p99")
    with pytest.raises(ValueError, match="within one another"):
        build_report(spark, str(corpus_dir), str(corpus_dir / "report"), 1)


def test_publishing(spark, tmp_path):
    out, data = tmp_path / "out", tmp_path / "data"
    data.mkdir()
    put = lambda *rows, **more: publish.publish(spark.createDataFrame([(p, f, bytearray(c)) for p, f, c in rows], publish.FILES), str(out), [str(data)], **more)
    there = lambda: {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file() and publish.LISTS not in str(p)}
    assert put((None, "a.html", b"1"), ("p", "pages/p.html", b"2"), ("q", "pages/q.html", b"3")) == {"written": 3, "removed": 0, "files": 3}
    seen = (out / "a.html").stat().st_mtime_ns
    assert put((None, "a.html", b"1"), ("q", "pages/q.html", b"4")) == {"written": 1, "removed": 1, "files": 2}
    assert there() == {"a.html": b"1", "pages/q.html": b"4"} and (out / "a.html").stat().st_mtime_ns == seen
    assert put((None, "a.html", b"5"), ("p", "pages/p.html", b"6"), only="p")["files"] == 3
    assert there() == {"a.html": b"5", "pages/p.html": b"6", "pages/q.html": b"4"}
    (out / "mine.txt").write_text("mine")
    (out / "pages/link.html").symlink_to(out / "mine.txt")
    for rows in ([(None, "mine.txt", b"x")], [("l", "pages/link.html", b"x")], [(None, "../x", b"x")], [(None, "/x", b"x")], [(None, ".builds/x", b"x")], [("a", "b", b"x"), ("c", "b", b"y")]):
        with pytest.raises(publish.Refused):
            put(*rows)
    assert (out / "mine.txt").read_text() == "mine" and (out / "a.html").read_bytes() == b"5"
    one = spark.createDataFrame([(None, "a", bytearray(b"1"))], publish.FILES)
    for folder, inputs in ((data, [str(data)]), (data / "x", [str(data)]), (tmp_path, [str(data)])):
        with pytest.raises(publish.Refused, match="within one another"):
            publish.publish(one, str(folder), inputs)
    (tmp_path / "ln").symlink_to(out)
    with pytest.raises(publish.Refused, match="a link"):
        publish.publish(one, str(tmp_path / "ln"))
    (data / "x").write_text("x")
    with pytest.raises(publish.Refused, match="no list"):
        publish.publish(one, str(data))
    (out / publish.LISTS / publish.POINTER).write_text("[]")
    with pytest.raises(publish.Refused, match="pointer"):
        put((None, "a.html", b"1"))


def test_annotations_round_trip(spark, tmp_path):
    drawn = spark.createDataFrame([("p", 1, "main_text", 1.0, 2.0, 3.0, 4.0, ""), ("p", 0, "unknown", 1.0, 2.0, 3.0, 4.0, "n")], "page_id string, ord int, region_type string, x1 double, y1 double, x2 double, y2 double, notes string")
    pages = spark.createDataFrame([("p", "p.tif", 10, 20), ("q", "q.tif", 1, 2)], "page_id string, image string, image_width int, image_height int")
    docs = {r["page_id"]: json.loads(r["value"]) for r in sinks.annotation_documents(sinks.make_annotations(drawn), pages).collect()}
    assert [r["type"] for r in docs["p"]["regions"]] == ["unknown", "main_text"] and "notes" not in docs["p"]["regions"][1] and docs["q"]["regions"] == []
    assert len(docs["p"]["regions"][0]["id"]) == len("human-") + 8 and docs["p"]["schema_version"] == "0.1"
    with pytest.raises(Exception, match="unknown type or empty box"):
        sinks.make_annotations(drawn.withColumn("x2", F.lit(0.0))).collect()


def png(width, height):
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def test_image_headers(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HHB", 30, 40, 3) + b"x" * 12
    tiff = b"II*\x00" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 50, 0) + struct.pack("<HHII", 257, 4, 1, 60)
    for name, content in {"a.png": png(7, 9), "a.tif": tiff, "b.JPEG": jpeg, "c.png": b"no image", "d.txt": b""}.items():
        (tmp_path / name).write_bytes(content)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert {k: (r["width"], r["height"], r["mode"], r["format"]) for k, r in rows.items()} == {"a.png": (7, 9, "RGB", "PNG"), "a.tif": (50, 60, "L", "TIFF"), "b.JPEG": (40, 30, "RGB", "JPEG"), "c.png": (None, None, None, None)}
    assert (rows["a.tif"]["ord"], rows["a.png"]["ord"]) == (0, 1)


def test_stream_keeps_the_latest(spark, tmp_path):
    folder = tmp_path / "results"
    put = lambda name, text: ((folder / name).parent.mkdir(parents=True, exist_ok=True), (folder / name).write_text(json.dumps({"model": "m", "prompt_version": "v", "region_id": "r", "response": {"transcription": text}})))
    put("p/m/a.json", "one")
    put("q/m/a.json", "other")
    run = lambda: stream.start_upsert(stream.read_result_stream(spark, str(folder)), str(tmp_path / "table"), str(tmp_path / "ck")).awaitTermination()
    run()
    put("p/m/b.json", "two")
    (folder / "bad.json").write_text("{")
    run()
    rows = spark.read.parquet(str(tmp_path / "table"))
    assert sorted((r["page_id"], r["transcription"]) for r in rows.collect()) == [("p", "two"), ("q", "other")]


def test_windowed_counts(spark):
    rows = spark.createDataFrame([(0, "m", "x"), (10, "m", None), (4000, "m", "y")], "s long, model string, transcription string").withColumn("modified", F.timestamp_seconds("s"))
    assert sorted((r["results"], r["read"]) for r in stream.windowed_counts(rows).collect()) == [(1, 1), (2, 1)]


def test_chat_client():
    from folioscope.sources import inference

    sent = []

    def send(url, body):
        sent.append((url, json.loads(body)))
        return json.dumps({"choices": [{"message": {"content": "hello"}, "finish_reason": "stop"}]}).encode()

    job = {"model": "m", "prompt": "read", "image_name": "a.PNG", "image_content": b"ab"}
    reply = inference.chat_client("http://x/v1/", send=send)(job)
    assert (reply["content"], reply["finish_reason"]) == ("hello", "stop") and reply["elapsed_seconds"] >= 0
    url, body = sent[0]
    assert url == "http://x/v1/chat/completions" and body["temperature"] == 0.0
    assert body["messages"][0]["content"][1]["image_url"]["url"] == "data:image/png;base64,YWI="
    with pytest.raises(ValueError, match="unsupported image type"):
        inference.image_message("p", "a.gif", b"")


def test_outcomes_are_saved_apart(spark, tmp_path):
    from folioscope.sources.inference import load_prompt

    rows = [("p", "m", "htr", "r1", True, "text", None, "stop"), ("p", "m", "htr", "r2", False, None, "ValueError: x", "length")]
    outcomes = spark.createDataFrame(rows, "page_id string, model string, task string, region_id string, ok boolean, transcription string, error string, finish_reason string")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    sinks.save_results(outcomes, good, bad)
    assert [(r["region_id"], r["transcription"], r["page_id"]) for r in spark.read.json(good).collect()] == [("r1", "text", "p")]
    assert [(r["region_id"], r["error"], r["finish_reason"]) for r in spark.read.json(bad).collect()] == [("r2", "ValueError: x", "length")]
    pages = spark.createDataFrame([("a", 1), ("b", 2)], "page_id string, n int")
    sinks.publish_pages(pages, str(tmp_path / "t"))
    sinks.publish_pages(pages.where("page_id = 'a'").withColumn("n", F.lit(9)), str(tmp_path / "t"))
    assert sorted((r["page_id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 9), ("b", 2)]
    (tmp_path / "prompt.txt").write_text("read\nthis", encoding="utf-8")
    assert load_prompt(spark, str(tmp_path / "prompt.txt")) == "read\nthis"


class _Context:
    """A context without a setting, as far as the shared folder asks for it."""

    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = f"{folder}/of-this-context"


class _Session:
    def __init__(self, master):
        self.sparkContext, self.conf = _Context(master), {}


def test_the_shared_folder_without_a_setting():
    local = _Session("local[2]")
    made = shared_folder(local)
    assert made.endswith("/of-this-context") and shared_folder(local) == made
    cluster = _Session("spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(cluster)
    cluster.sparkContext.folder = "hdfs://host/shared"
    assert shared_folder(cluster) == "hdfs://host/shared"


@pytest.mark.parametrize("spelling", ["{}", "{}/", "file:{}", "file://{}", "file://{}//", "relative"])
def test_any_spelling_of_a_folder(spark, tmp_path, spelling, monkeypatch):
    """Names with blanks and escaped characters keep their regions, in every reader and however the folder is named."""
    names = ["p 1", "a%b", "a+b", "a#b", "a%20b", "ص 1", "a&c=d;e"]
    root = tmp_path / "da ta%20x"
    for n in names:
        files = {f"alto/{n}.xml": alto(block("b1", lines=LINES) + block("b2", box=False)), f"ground-truth/{n}.json": json.dumps({"image": "x", "image_width": 1, "image_height": 1, "regions": [{"id": "r", "type": "main_text", "bbox": [1, 2, 3, 4]}]}),
                 f"results/{n}/m 1/a b.json": json.dumps({"task": "htr", "response": {"transcription": "t"}}), f"htr-inputs/{n}.json": json.dumps({"coordinate_system": "normalized-1000", "regions": [{"id": "b1", "type": "main_text", "bbox": [1, 1, 6, 3]}]}),
                 f"htr-errors/{n}/m 1/b1.json": json.dumps({"model": "m", "region_id": "b1"}), f"images/{n}.png": "x"}
        for name, content in files.items():
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_text(content, encoding="utf-8")
    if spelling == "relative":
        spelling = os.path.relpath(root, spark._jvm.java.lang.System.getProperty("user.dir"))
    c = load_corpus(spark, spelling.format(root))
    assert sorted(r[0] for r in c.pages.collect()) == sorted(names) and c.issues.count() == 0
    assert sorted(map(tuple, c.systems.select("page_id", "system", "source", "skipped_blocks").collect())) == sorted((n, "eScriptorium", f"alto/{n}.xml", 1) for n in names)
    for table in (c.regions, c.annotated, c.frozen, c.failures, c.results):
        assert sorted(r["page_id"] for r in table.collect()) == sorted(names)
    assert {(r["path"], r["model"]) for r in c.results.collect()} == {(f"results/{n}/m 1/a b.json", "m 1") for n in names}


def test_files_outside_the_folder_are_issues(spark, corpus_dir, tmp_path):
    _, issues = layout.read_layout(spark, str(corpus_dir / "alto"), str(tmp_path / "elsewhere"))
    assert {r["message"] for r in issues.collect()} == {"outside the data folder"} and all(r["path"].startswith("/") for r in issues.collect())
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "elsewhere/results").symlink_to(corpus_dir / "results")
    found, issues = records.read_results(spark, str(tmp_path / "elsewhere"))
    assert found.count() == 5 and {r["path"].split("/")[0] for r in issues.collect()} == {"results"}


def test_tags_of_any_name(spark):
    xml = """<?xml version="1.0"?><a:alto xmlns:a='http://www.loc.gov/standards/alto/ns-v4#'><!-- <Tags><X ID="c" LABEL="comment"/></Tags> --><a:Tags note="a>b"><a:OtherTag ID="T1" LABEL="Main &amp; more"/>
      <MyTag LABEL="Stamp" ID="T2"><inner ID="T9" LABEL="deep"/></MyTag><q:Tag ID="T1" LABEL="Note"></q:Tag><Z/>text<LayoutTag ID="T4"/><LayoutTag ID="" LABEL="x"/></a:Tags><Tags/><Tags ></Tags><Tags><B ID='T5' LABEL='last'/></Tags></a:alto>"""
    rows = spark.createDataFrame([(xml,), ("<alto/>",), ("no XML <Tags><A ID='1'</Tags>",)], "x string").select(layout.tags_of(F.regexp_replace("x", layout._COMMENT, "")).alias("t")).collect()
    assert [[tuple(t) for t in r["t"]] for r in rows] == [[("T1", "Main & more"), ("T2", "Stamp"), ("T1", "Note"), ("T5", "last")], [], []]


def test_last_tag_wins_across_kinds(spark, tmp_path):
    tags = '<Tags><OtherTag ID="T1" LABEL="Main"/><MyTag ID="T1" LABEL="Stamp"/></Tags>'
    page = f'<Layout><Page WIDTH="10" HEIGHT="10"><PrintSpace>{block(tags="T1")}</PrintSpace></Page></Layout>'
    (tmp_path / "p.xml").write_text(f'<alto xmlns="{NS}">{tags}{page}</alto>')
    (tmp_path / "q.xml").write_text(f'<alto><Description note="{NS}"/>{tags}{page}</alto>')
    blocks, issues = layout.read_layout(spark, str(tmp_path))
    assert [r["block_type"] for r in blocks.collect()] == ["Stamp"] and [(r["path"], r["message"]) for r in issues.collect()] == [("q.xml", "no page")]


def test_files_of_a_corpus_are_made_where_their_lines_are(spark):
    """One shuffle for a page's files, and only the kinds that a query reads."""
    import os

    from folioscope.plans import corpora

    rows = corpora._rows(spark, "/root/testdata/sf0.001")
    for files in (corpora._layout_files(rows), corpora._record_files(rows, {"htr-inputs"})):
        assert files._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    corpora._FOLDERS.clear()
    base = corpora.folder(spark, "/root/testdata/sf0.001", "htr-inputs")
    made = lambda: sorted(x for x in os.listdir(base.removeprefix("file://")) if not x.startswith("."))
    assert made() == ["htr-inputs"]
    assert corpora.folder(spark, "/root/testdata/sf0.001") == base and made() == sorted(corpora.KINDS)


def test_a_layout_file_is_parsed_once(spark, corpus_dir):
    """Filters are not moved below the parser, where they would parse a file for each mention of it."""
    blocks, issues = layout.read_layout(spark, str(corpus_dir / "alto"))
    for df in (layout.layout_regions(blocks), layout.layout_regions(blocks, blank_lines=True), issues, layout.layout_files(spark, str(corpus_dir / "alto"))):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") <= 2  # one for the tags


def test_numbers_of_a_text_are_split_once():
    assert str(layout.points(F.col("x"))).count("split(") <= 1


def test_compressed_files_count_as_plain_ones(spark, corpus_dir, tmp_path):
    import gzip

    told = {}
    for packed in (False, True):
        root = tmp_path / f"packed-{packed}"
        for path in corpus_dir.rglob("*"):
            if path.is_file():
                to = root / path.relative_to(corpus_dir)
                to.parent.mkdir(parents=True, exist_ok=True)
                if packed and path.suffix in (".xml", ".json") and to.name != "corpus.json":
                    to.with_name(to.name + ".gz").write_bytes(gzip.compress(path.read_bytes()))
                else:
                    to.write_bytes(path.read_bytes())
        c = load_corpus(spark, str(root))
        told[packed] = [sorted(map(str, getattr(c, t).collect())) for t in ("pages", "systems", "regions", "artifacts", "results", "annotated", "frozen", "failures", "layout", "issues")]
    assert told[True] == told[False] and all(told[False][i] for i in (0, 1, 2, 3))


def test_corpus_files_of_a_page_are_written_compressed_and_only_counts_kept_of_layout(spark):
    from folioscope.plans import corpora

    base = corpora.folder(spark, "/root/testdata/sf0.001").removeprefix("file://")
    for kind in ("alto", "ground-truth", "htr-inputs"):
        assert all(x.endswith(".gz") for x in os.listdir(f"{base}/{kind}"))
    c = load_corpus(spark, base)
    assert c.systems.count() and c.issues.count() and "blocks" not in vars(c)
