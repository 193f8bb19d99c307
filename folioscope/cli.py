"""folioscope build --data FOLDER --output FOLDER [--min-reviewed-pages N] [--manuscript ID]
folioscope run --data FOLDER --prompt FILE [--base-url URL] [--model NAME]... [--slots N] [--prepare-only]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioscope.functions.labels import MODEL_FOLDERS


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="folioscope")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="build and publish the report of a corpus")
    build.add_argument("--data", default="data")
    build.add_argument("--output", default="report")
    build.add_argument("--min-reviewed-pages", type=int, default=5)
    build.add_argument("--manuscript")
    run = commands.add_parser("run", help="read the regions of a corpus by models; what has a result isn't asked again")
    run.add_argument("--data", default="data")
    run.add_argument("--prompt", default="prompts/htr-v1.txt")
    run.add_argument("--base-url", default="http://localhost:1234/v1")
    run.add_argument("--model", action="append", choices=sorted(MODEL_FOLDERS))
    run.add_argument("--slots", type=int, default=2)
    run.add_argument("--prepare-only", action="store_true")
    return parser


def run_models(spark: SparkSession, data: str, prompt_file: str, models: list[str] | None, client, slots: int = 2, prepare_only: bool = False, settings: dict | None = None) -> int:
    """Freezes inputs, asks for what is missing, and says what came of it; the exit status."""
    from folioscope.functions.ids import stem
    from folioscope.operators.batch import plan_jobs
    from folioscope.operators.runs import run_jobs
    from folioscope.sources.frozen import prepare
    from folioscope.sources.inference import load_prompt
    from folioscope.sources.store import settle

    inputs, issues = prepare(spark, data)
    inputs = settle(inputs, "run-inputs")
    counts = inputs.agg(F.count("*").alias("regions"), F.countDistinct("page_id").alias("pages")).first()
    print(f"{counts['regions']} regions of {counts['pages']} pages are prepared; {issues.count()} issues")
    if prepare_only:
        return 0
    version = spark.range(1).select(stem(F.lit(prompt_file))).first()[0]
    chosen = spark.createDataFrame([(k, MODEL_FOLDERS[k]) for k in models or MODEL_FOLDERS], "label string, model string")
    jobs = plan_jobs(inputs.withColumnRenamed("region_id", "id"), chosen, load_prompt(spark, prompt_file), version)
    done = run_jobs(jobs, client, data, slots, settings)
    print(f"{done['saved']} saved, {done['failed']} failed (run {done['run']})")
    for failure in done["failures"]:
        print(f"failed: {failure}")
    return 1 if done["failed"] else 0


def main(args: list[str] | None = None) -> int:
    found = _parser().parse_args(args)
    spark = SparkSession.builder.appName("folioscope").getOrCreate()
    if found.command == "run":
        from folioscope.sources.inference import chat_client

        settings = {"temperature": 0.0, "max_tokens": 4096}
        return run_models(spark, found.data, found.prompt, found.model, chat_client(found.base_url, **settings), found.slots, found.prepare_only, settings)
    from folioscope.plans.report import build_report

    done = build_report(spark, found.data, found.output, found.min_reviewed_pages, found.manuscript)
    print(", ".join(f"{n} {what}" for what, n in done.items()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
