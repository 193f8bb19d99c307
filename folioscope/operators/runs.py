"""Runs of a batch that lose nothing that was answered.

The requests are made inside a data source's writer, one after another in each task, and every answer
is a file of its own before the next request is made. A job's file is named by its page, model, region
and prompt, and holds the hashes of what was asked; a task that runs again, in this run or a later
one, finds the answers of the first and asks only for the rest. What the tasks did is counted by their
commit messages and written as the run's record when all have ended, or when the run has failed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from folioscope.operators.batch import JOB_KEY, answer, pending
from folioscope.sources.corpus import exists
from folioscope.sources.files import content_of, safe_name, save_whole
from folioscope.sources.paths import store_of
from folioscope.sources.records import read_results, shown
from folioscope.sources.store import settle

RECORDS = "htr-runs"
#: Failures that a run's record names; all have a file of their own.
NAMED = 1000
#: What a saved result and a saved failure say of their job, by the names of the job's columns.
OF_JOB = ("page_id", "region_id", "region_source", "image_sha256", "model", "prompt_version", "image", "prompt")
OF_FAILURE = ("model", "region_id", "image_sha256", "prompt")


class Conflict(ValueError):
    """Results are there that come from other inputs; they are never overwritten."""


@dataclass
class Done(WriterCommitMessage):
    """What one task did."""

    saved: int = 0
    kept: int = 0
    failed: int = 0
    failures: list[str] = field(default_factory=list)


def result_file(job: dict) -> str:
    """Where a job's answer is kept, below the data folder. ``label``: the model's folder."""
    return f"{safe_name(job['page_id'])}/{safe_name(job['label'])}/htr/{safe_name(job['region_id'])}-{safe_name(job['prompt_version'])}.json"


def _same(job: dict, old: bytes) -> bool:
    """Whether a saved result is the answer to a job."""
    try:
        found = json.loads(old)
        return all(found.get(k) == job[k] for k in ("image_sha256", "prompt", "model")) and isinstance(found["response"]["transcription"], str)
    except (ValueError, KeyError, TypeError, AttributeError):
        return False


def _perform(job: dict, client: Callable[[dict], dict], settings: dict, store, base: str, done: Done) -> None:
    """Answers one job and saves what came of it."""
    name = result_file(job)
    if (old := content_of(store, f"{base}/results/{name}")) is not None:
        if _same(job, old):
            done.kept += 1
        else:
            done.failed += 1
            done.failures.append(f"{name}: another result is there")
        return
    content = content_of(store, f"{base}/{job['image']}")
    if content is None or hashlib.sha256(content).hexdigest() != job["image_sha256"]:
        out = {"ok": False, "error": "ValueError: the image is not the one that was planned", "raw_content": None, "finish_reason": None}
    else:
        out = answer(client, job | {"image_name": job["image"], "image_content": content})
    if out["ok"]:
        box = {"region_bbox": [job[c] for c in ("x1", "y1", "x2", "y2")]} if job.get("x1") is not None else {}
        saved = {k: job.get(k) for k in OF_JOB} | box | {"task": "htr", "response": out["response"], "raw_content": out["raw_content"], "elapsed_seconds": out["elapsed_seconds"]} | settings
        save_whole(store, f"{base}/results/{name}", json.dumps(saved, ensure_ascii=False).encode())
        done.saved += 1
        return
    path = f"{base}/htr-errors/{name.replace('/htr/', '/', 1)}"
    save_whole(store, path, json.dumps({k: job.get(k) for k in OF_FAILURE} | {k: out[k] for k in ("error", "raw_content", "finish_reason")}, ensure_ascii=False).encode())
    done.failed += 1
    done.failures.append(f"{name}: {out['error']}")


class ResultWriter(DataSourceArrowWriter):
    def __init__(self, client: Callable[[dict], dict], root: str, run: str, settings: dict):
        self.client, self.root, self.run, self.settings = client, root, run, settings

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        done, (store, base) = Done(), store_of(self.root)
        for batch in iterator:
            for job in batch.to_pylist():
                _perform(job, self.client, self.settings, store, base, done)
        done.failures = done.failures[:NAMED]
        return done

    def _record(self, messages: list[Done | None], complete: bool) -> None:
        total = Done()
        for m in messages:
            if m is not None:
                total.saved, total.kept, total.failed = total.saved + m.saved, total.kept + m.kept, total.failed + m.failed
                total.failures = (total.failures + m.failures)[:NAMED]
        store, base = store_of(self.root)
        save_whole(store, f"{base}/{RECORDS}/{self.run}.json", json.dumps(asdict(total) | {"complete": complete}).encode())

    def commit(self, messages: list[Done | None]) -> None:
        self._record(messages, True)

    def abort(self, messages: list[Done | None]) -> None:
        self._record(messages, False)  # the answers of ended requests stay where they are


def _source(kind: str, client: Callable[[dict], dict], root: str, run: str, settings: dict) -> type[DataSource]:
    class Results(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def writer(self, schema: StructType, overwrite: bool) -> ResultWriter:
            return ResultWriter(client, root, run, settings)

    return Results


def finished(spark: SparkSession, root: str) -> DataFrame:
    """The saved results of a data folder, as ``pending`` takes them."""
    columns = [*JOB_KEY, "image_sha256", "prompt", "transcription"]
    if not exists(spark, f"{root}/results"):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    found, _ = read_results(spark, root)
    # a result's page is the one that it names: its folder's name may be a spelling of it
    return found.where("task = 'htr'").withColumn("page_id", F.coalesce(shown(F.col("v"), "$.page_id"), "page_id")).select(*columns)


def run_jobs(jobs: DataFrame, client: Callable[[dict], dict], root: str, slots: int = 64, settings: dict | None = None) -> dict:
    """Runs the jobs that have no result yet and returns the run's record: saved, kept, failed, failures and
    complete. ``jobs``: the job's key with label, prompt, image, image_sha256 and, where there is one, the box;
    ``slots``: requests at a time; ``settings``: what else a result tells of its request.

    Results from other inputs raise ``Conflict`` before anything is asked."""
    spark, root = jobs.sparkSession, root.rstrip("/")
    jobs = settle(jobs, "jobs")
    todo, conflicts = pending(jobs, finished(spark, root))
    if found := conflicts.select(*JOB_KEY).take(3):
        raise Conflict(f"results of other inputs are there; move or keep them before another run: {[tuple(r) for r in found]}")
    run = uuid.uuid4().hex
    kind = f"folioscope_results_{run}"
    spark.dataSource.register(_source(kind, client, root, run, settings or {}))
    todo.repartition(slots, *JOB_KEY).write.format(kind).mode("append").save()
    store, base = store_of(root)
    return json.loads(content_of(store, f"{base}/{RECORDS}/{run}.json")) | {"run": run}
