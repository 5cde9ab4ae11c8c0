"""Intermediate tables."""

import pytest
from pyspark.sql import functions as F

from crewmetrics.plans import scratch


def test_written_tables_are_read_back(spark):
    rows = spark.range(10).select("id", F.array(F.lit(1.5), F.lit(None)).alias("a"), F.lit(None).cast("string").alias("s"))
    kept = scratch.written(rows)
    assert kept.schema.simpleString() == rows.schema.simpleString() and sorted(r.id for r in kept.collect()) == list(range(10))
    assert scratch.written(rows.limit(0)).isEmpty() and scratch.scratch_folder(spark) != scratch.scratch_folder(spark)


class Session:
    """What the function asks of a session that is not local."""

    def __init__(self, folder, context_folder=None):
        self.conf, self.sparkContext = self, self
        self.folder, self.context_folder, self.master = folder, context_folder, "yarn"

    def get(self, name, default):
        return self.folder if name == "spark.checkpoint.dir" and self.folder else default

    def getCheckpointDir(self):
        return self.context_folder


def test_the_set_folder_is_used():
    assert scratch.scratch_folder(Session("hdfs://x/shared/", "hdfs://x/other")).startswith("hdfs://x/shared/crewmetrics-")
    assert scratch.scratch_folder(Session(None, "hdfs://x/other")).startswith("hdfs://x/other/crewmetrics-")


def test_a_cluster_must_name_a_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_folder(Session(None))
