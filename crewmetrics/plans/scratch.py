"""Intermediate results as tables, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, else below the context's checkpoint folder.

    Only a local session gets a temporary folder of its own; on a cluster executors would not share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="crewmetrics-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/crewmetrics-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once and read back from Parquet.  The files stay, as later results are read from them lazily."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
