"""Resumable batch inference: the job table, what of it is still to do, and what comes of a job.

The client is pluggable: a function from a job (a dict) to a reply with content, finish_reason and
elapsed_seconds. It is called on the executors, a connection for each task.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Models of a batch at most.
MODELS = 1000
JOB_KEY = ["page_id", "region_id", "model", "prompt_version"]
WHOLE_PAGE = {"id": "whole-page", "region_type": "main_text", "x1": 0.0, "y1": 0.0, "x2": 1000.0, "y2": 1000.0}


def plan_regions(images: DataFrame, frozen: DataFrame, annotated: DataFrame, layout: DataFrame) -> DataFrame:
    """The regions to read on each imaged page, from the first source that has the page: the frozen
    inputs, then annotations, then machine layout, then the whole page. Frozen inputs are taken as
    they are; the others without illustrations."""
    columns = ["page_id", "ord", "id", "region_type", "x1", "y1", "x2", "y2", "region_source"]
    pages = images.select("page_id").distinct()
    whole = pages.select("page_id", F.lit(0).alias("ord"), *(F.lit(v).alias(k) for k, v in WHOLE_PAGE.items()), F.lit("whole image").alias("region_source"))
    sources = [frozen.select(*columns), annotated.select(*columns), layout.select(*columns), whole.select(*columns)]
    ranked = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_rank", F.lit(i))
        ranked = s if ranked is None else ranked.unionByName(s)
    best = ranked.join(pages, "page_id", "left_semi").withColumn("best", F.min("source_rank").over(Window.partitionBy("page_id"))).where("source_rank = best")
    return best.where("source_rank = 0 or region_type <> 'illustration'").drop("best", "source_rank")


def plan_jobs(regions: DataFrame, models: DataFrame, prompt: str, prompt_version: str) -> DataFrame:
    """A job for each model and region. Models are part of the plan: more than MODELS are refused."""
    rows = models.limit(MODELS + 1).collect()
    if len(rows) > MODELS:
        raise ValueError(f"more than {MODELS} models")
    each = F.array(*(F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in models.schema)) for r in rows)) if rows else F.lit(None).cast(f"array<{models.schema.simpleString()}>")
    named = regions.withColumnRenamed("id", "region_id").withColumn("of_model", F.explode(each))
    return named.select(*(c for c in named.columns if c != "of_model"), "of_model.*").withColumns({"prompt": F.lit(prompt), "prompt_version": F.lit(prompt_version)})


def pending(jobs: DataFrame, done: DataFrame, same: tuple[str, ...] = ("image_sha256", "prompt")) -> tuple[DataFrame, DataFrame]:
    """Jobs without a finished result, and jobs whose result came from another input. The second
    must be empty before a run."""
    saved = done.select(*JOB_KEY, *(F.col(c).alias(f"saved_{c}") for c in same), F.col("transcription").isNotNull().alias("finished"))
    joined = jobs.join(saved, JOB_KEY, "left")
    equal = F.col("finished")
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"saved_{c}"))
    extra = [f"saved_{c}" for c in same] + ["finished"]
    return joined.where("finished is null").drop(*extra), joined.where(F.col("finished").isNotNull() & ~equal).drop(*extra)


def reply_fields(content: str) -> dict:
    """The object in a reply, with or without a fence."""
    body = content.strip()
    if fenced := re.fullmatch(r"```[^\n]*(?:\n(?P<body>.*?))?(?:\n\s*```)?", body, re.S):
        body = (fenced["body"] or "").strip()
    found = json.loads(body)
    if not isinstance(found, dict):
        raise ValueError("the reply is no object")
    return found


OUTCOME = "ok boolean, transcription string, script string, language string, raw_content string, finish_reason string, error string, elapsed_seconds double"


def answer(client: Callable[[dict], dict], job: dict) -> dict:
    """What came of a job: ok, response (the whole object) and its texts, or the error. A reply counts if it is a
    complete object with a transcription string."""
    out = dict.fromkeys(("transcription", "script", "language", "raw_content", "finish_reason", "error", "response", "elapsed_seconds")) | {"ok": False}
    began = time.monotonic()
    try:
        reply = client(job)
        out |= {"raw_content": reply["content"], "finish_reason": reply.get("finish_reason"), "elapsed_seconds": reply.get("elapsed_seconds", time.monotonic() - began)}
        found = reply_fields(reply["content"])
        if not isinstance(found.get("transcription"), str):
            raise ValueError("no transcription string")
        if out["finish_reason"] != "stop":
            raise ValueError(f"incomplete: {out['finish_reason']}")
        out |= {"ok": True, "response": found} | {k: v if isinstance(v := found.get(k), str) else None for k in ("transcription", "script", "language")}
    except Exception as e:  # an outcome of its own, written beside the results
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def run_batch(jobs: DataFrame, client: Callable[[dict], dict], columns: list[str] | None = None) -> DataFrame:
    """Jobs with their outcomes, as a table that is computed wherever it is read (``runs`` saves them instead)."""
    kept = jobs.select(*(columns or jobs.columns))
    fields = [f.split()[0] for f in OUTCOME.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [job | answer(client, job) for job in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=[*batch.columns, *fields])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInPandas(run, f"{schema}, {OUTCOME}")
