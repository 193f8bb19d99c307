"""Results as a stream: new result files are taken in as they come. An extension of the batch
readers, by the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.sources.paths import placed
from folioscope.sources.records import kind, shown, text_of

KEY = ["page_id", "region_id", "model", "prompt_version"]


def read_result_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """path, modified and the fields of each new HTR result below ``folder``."""
    lines = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    rows = placed(lines.withColumn("modified", F.col("_metadata.file_modification_time")), folder).select("path", "outside", "modified", F.try_parse_json("value").alias("v"))
    v = F.col("v")
    rows = rows.where(~F.col("outside") & (kind(v) == "OBJECT") & (F.size(F.split("path", "/")) >= 3))
    return rows.select(
        "path", "modified", F.get(F.split("path", "/"), F.lit(0)).alias("page_id"), shown(v, "$.region_id").alias("region_id"), shown(v, "$.model").alias("model"),
        shown(v, "$.prompt_version").alias("prompt_version"), text_of(v, "$.response.transcription").alias("transcription"),
    )


def latest(rows: DataFrame) -> DataFrame:
    """The last result of each page, region, model and prompt version."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("modified"), F.desc("path"))
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def start_upsert(stream: DataFrame, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps ``table`` (a Parquet folder by page) at the latest results. A batch rewrites the pages
    that it has results of; writing a batch again gives the same table."""

    def upsert(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        pages = batch.select("page_id").distinct()
        try:
            old = spark.read.schema(batch.schema).parquet(table).join(pages, "page_id", "left_semi")
            merged = latest(old.unionByName(batch))
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            merged = latest(batch)
        merged = merged.checkpoint()  # read before its partitions are overwritten
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("page_id").parquet(table)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time: str = "modified", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Results by window and model, with late ones within ``late``."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "model").agg(F.count("*").alias("results"), F.count_if(F.col("transcription").isNotNull()).alias("read"))
