"""Tables in the folder that the cluster shares, for what is read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the checkpoint folder of the running context. Without
    either a temporary folder is made and set, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="folioscope-"))
        base = spark.sparkContext.getCheckpointDir()  # the setting itself can't be changed in a running session
    return base.rstrip("/")


def settle(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is computed once and its lineage
    ends."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
