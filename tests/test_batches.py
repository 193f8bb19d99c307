import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import alto, block

from folioscope import cli
from folioscope.operators import runs
from folioscope.sources import frozen, images, records

MODELS = "label string, model string"


def tree(root, *folders):
    return {str(p.relative_to(root)): p.read_bytes() for f in folders for p in (root / f).rglob("*") if p.is_file() and not p.name.endswith(".crc")}


@pytest.fixture
def data(tmp_path):
    root = tmp_path / "data"
    for d in ("images", "alto", "ground-truth"):
        (root / d).mkdir(parents=True)
    pixels = np.random.default_rng(0).integers(0, 256, (100, 80, 1), dtype=np.uint8)
    for name in ("drawn.png", "laid out.png", "bare.png", "empty.png"):
        (root / "images" / name).write_bytes(images.png_bytes(pixels))
    (root / "images/broken.png").write_bytes(b"no image")
    (root / "images/photo.jpg").write_bytes(b"\xff\xd8\xff\xc0\x00\x11\x08" + (30).to_bytes(2) + (40).to_bytes(2) + b"\x03" + b"x" * 12)
    region = lambda i, kind, box: {"id": i, "type": kind, "bbox": box}
    drawn = [region("a/b", "main_text", [0, 0, 500, 500]), region("_c", "stamp_or_seal", [0, 0, 500, 500]), region("pic", "illustration", [0, 0, 9, 9])]
    (root / "ground-truth/drawn.json").write_text(json.dumps({"image": "drawn.png", "image_width": 80, "image_height": 100, "regions": drawn}))
    (root / "ground-truth/empty.json").write_text(json.dumps({"image": "empty.png", "image_width": 80, "image_height": 100, "regions": []}))
    for page in ("drawn", "laid out", "empty"):
        (root / f"alto/{page}.xml").write_text(alto(block("b1") + block("b2", box=False)))
    return root


def test_frozen_inputs_stay(spark, data):
    inputs, issues = frozen.prepare(spark, str(data), 2)
    rows = {(r["page_id"], r["region_id"]): r for r in inputs.collect()}
    assert set(rows) == {("drawn", "a/b"), ("drawn", "_c"), ("laid out", "b1"), ("bare", "whole-page")}
    assert sorted((r["path"].rsplit("/", 1)[-1], r["message"].split(":")[0]) for r in issues.collect()) == [("broken.png", "no image that can be read"), ("photo.jpg", "Unsupported")]
    assert rows["drawn", "a/b"]["image"] == "crops/drawn/a%2Fb.png" and rows["drawn", "_c"]["image"] == "crops/drawn/%5Fc.png"
    for r in rows.values():
        assert hashlib.sha256((data / r["image"]).read_bytes()).hexdigest() == r["image_sha256"]
    size = images.header(images.of_bytes((data / "crops/drawn/a%2Fb.png").read_bytes()))
    assert (size["width"], size["height"]) == (42, 52)
    manifest = json.loads((data / "htr-inputs/drawn.json").read_text())
    assert manifest["image"] == "drawn.png" and manifest["padding"] == 2 and [x["id"] for x in manifest["regions"]] == ["a/b", "_c"] and json.loads((data / "htr-inputs/empty.json").read_text())["regions"] == []
    before = tree(data, "htr-inputs", "crops")
    (data / "alto/laid out.xml").write_text(alto(block("new")))
    (data / "ground-truth/drawn.json").unlink()
    again, _ = frozen.prepare(spark, str(data), 30)
    assert tree(data, "htr-inputs", "crops") == before and {(r["page_id"], r["region_id"]): r for r in again.collect()} == rows


def make_client(log, dies_at=None):
    def client(job):
        with open(log, "a") as f:
            f.write(f"{job['region_id']} {job['label']} {len(job['image_content'])}\n")
        if job["region_id"] == dies_at:
            raise SystemExit(9)  # takes the whole task down
        if job["region_id"] == "_c":
            return {"content": "no json", "finish_reason": "stop"}
        return {"content": '{"transcription": "read", "script": "Arabic"}', "finish_reason": "stop", "elapsed_seconds": 0.5}

    return client


def asked(log):
    return sorted(x.split()[0] for x in log.read_text().splitlines()) if log.exists() else []


def jobs_of(spark, data, models=(("m 1", "model-1"),)):
    from folioscope.operators.batch import plan_jobs

    inputs, _ = frozen.prepare(spark, str(data))
    return plan_jobs(inputs.withColumnRenamed("region_id", "id"), spark.createDataFrame(list(models), MODELS), "read this", "v1")


def test_runs_ask_only_for_what_is_missing(spark, data, tmp_path):
    jobs, log = jobs_of(spark, data), tmp_path / "log"
    done = runs.run_jobs(jobs, make_client(log), str(data), 3, {"temperature": 0.0})
    assert (done["saved"], done["failed"], done["complete"]) == (3, 1, True) and done["failures"][0].startswith("drawn/m 1/htr/%5Fc-v1.json: ")
    assert asked(log) == ["_c", "a/b", "b1", "whole-page"]
    saved = json.loads((data / "results/drawn/m 1/htr/a%2Fb-v1.json").read_text())
    assert saved["response"] == {"transcription": "read", "script": "Arabic"} and saved["region_bbox"] == [0.0, 0.0, 500.0, 500.0] and saved["temperature"] == 0.0 and saved["task"] == "htr" and saved["region_id"] == "a/b"
    failure = json.loads((data / "htr-errors/drawn/m 1/%5Fc-v1.json").read_text())
    assert failure["region_id"] == "_c" and failure["raw_content"] == "no json" and failure["finish_reason"] == "stop"
    found, bad = records.read_results(spark, str(data))
    assert found.count() == 3 and bad.count() == 0 and records.read_failures(spark, str(data)).first()["page_id"] == "drawn"
    log.unlink()
    again = runs.run_jobs(jobs, make_client(log), str(data), 3)
    assert asked(log) == ["_c"] and (again["saved"], again["failed"]) == (0, 1)
    log.unlink()
    with pytest.raises(runs.Conflict):
        runs.run_jobs(jobs.withColumn("prompt", F.lit("another")), make_client(log), str(data))
    assert asked(log) == []


def test_a_lost_task_repeats_no_request(spark, data, tmp_path):
    jobs, log = jobs_of(spark, data, (("m1", "model-1"), ("m2", "model-2"))), tmp_path / "log"
    with pytest.raises(Exception, match="."):
        runs.run_jobs(jobs, make_client(log, "b1"), str(data), 1)
    before = asked(log)
    assert before.count("b1") == 1
    answered = len(list((data / "results").rglob("*.json")))
    log.unlink()
    done = runs.run_jobs(jobs, make_client(log), str(data), 1)
    assert done["saved"] == 6 - answered and len(list((data / "results").rglob("*.json"))) == 6
    assert len(asked(log)) == 8 - answered  # two that fail are asked again, and what was never answered


def test_a_task_run_again_finds_its_answers(spark, data, tmp_path):
    """The writer itself looks for answers, so that a retry within one run repeats nothing either."""
    jobs, log = jobs_of(spark, data), tmp_path / "log"
    writer = runs.ResultWriter(make_client(log), str(data), "r", {})
    batches = jobs.where("region_id <> '_c'").toArrow().to_batches()
    first, second = writer.write(iter(batches)), writer.write(iter(batches))
    assert (first.saved, first.kept, second.saved, second.kept) == (3, 0, 0, 3) and len(asked(log)) == 3
    (data / "crops/bare/whole-page.png").write_bytes(b"changed")
    other = jobs.where("page_id = 'bare'").withColumn("prompt_version", F.lit("v2")).toArrow().to_batches()
    changed = writer.write(iter(other))
    assert changed.failed == 1 and "not the one that was planned" in changed.failures[0] and len(asked(log)) == 3
    writer.abort([first, None, second])
    assert json.loads((data / "htr-runs/r.json").read_text()) == {"saved": 3, "kept": 3, "failed": 0, "failures": [], "complete": False}


def test_the_command(spark, data, tmp_path, capsys):
    prompt, log = tmp_path / "htr-v1.txt", tmp_path / "log"
    prompt.write_text("read this")
    run = lambda **more: cli.run_models(spark, str(data), str(prompt), ["qwen3-vl-8b"], make_client(log), **more)
    assert run(prepare_only=True) == 0 and not (data / "results").exists()
    assert run() == 1 and "4 regions of 3 pages are prepared; 2 issues" in capsys.readouterr().out
    (data / "htr-inputs/drawn.json").unlink()
    (data / "ground-truth/drawn.json").write_text("{")
    assert run() == 0
    assert (data / "results/bare/qwen3-vl-8b/htr/whole-page-htr-v1.json").is_file()
