"""Keyed upsert into a folder of parquet files: whole snapshots, or a table of hash buckets.

A snapshot run never overwrites the files it reads: it writes the next snapshot, and readers take the
newest one with a success marker.  A run that dies half-way leaves the old snapshot in force.
A bucket table is for a large table and few changes: only the buckets with changed keys are written again.
Catalogs with row-level operations can use ``merge`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewmetrics.operators.next_steps import latest_per_key, upsert
from crewmetrics.plans.scratch import written
from crewmetrics.sources.files import children, exists

_NAME = "snapshot-%08d"


def _newest(spark: SparkSession, path: str) -> int | None:
    numbers = [int(c.split("-")[1]) for c in children(spark, path) if c.startswith("snapshot-")]
    done = [n for n in numbers if exists(spark, f"{path}/{_NAME % n}/_SUCCESS")]
    return max(done, default=None)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    newest = _newest(spark, path)
    return None if newest is None else spark.read.parquet(f"{path}/{_NAME % newest}")


def upsert_snapshot(
    source: DataFrame, path: str, key: str = "employee_id", newest_first: list[Column] | None = None
) -> DataFrame:
    """Update rows with a known key, insert the others, and return the new table.

    ``newest_first`` picks one source row where a key may occur more than once.
    """
    spark = source.sparkSession
    if newest_first:
        source = latest_per_key(source, key, newest_first)
    old = _newest(spark, path)
    rows = source if old is None else upsert(spark.read.parquet(f"{path}/{_NAME % old}"), source, key)
    numbers = [int(c.split("-")[1]) for c in children(spark, path) if c.startswith("snapshot-")]
    new = f"{path}/{_NAME % (max(numbers, default=-1) + 1)}"
    rows.write.parquet(new)
    return spark.read.parquet(new)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert_buckets(source: DataFrame, path: str, key: str = "employee_id", buckets: int = 256, newest_first: list[Column] | None = None) -> DataFrame:
    """Update rows with a known key, insert the others, and write only the buckets that hold a key of ``source``.

    The table is partitioned by ``_bucket``, a hash of the key; ``buckets`` counts for a new table only.  The new buckets are
    computed into a table of their own first (``plans.scratch``), then replace the old ones, so nothing is read while it
    is written, and a run that dies while it replaces them can be run again with the same source.  A key that occurs twice in
    ``source`` fails the run before anything is written, unless ``newest_first`` picks one of its rows.
    """
    spark = source.sparkSession
    if newest_first:
        source = latest_per_key(source, key, newest_first)
    old = None
    if exists(spark, f"{path}/_buckets"):
        buckets = spark.read.text(f"{path}/_buckets").first().value
        old = spark.read.parquet(f"{path}/rows")
    marked = written(source.withColumn("_bucket", _bucket(key, int(buckets))))
    touched = [r[0] for r in marked.select("_bucket").distinct().collect()]  # no more than there are buckets
    if not touched:
        return read_buckets(spark, path) if old is not None else source
    base = marked.limit(0) if old is None else old.where(F.col("_bucket").isin(touched))
    rows = upsert(base, marked, key).withColumn("_bucket", _bucket(key, int(buckets)))
    # a bucket's rows meet in one task, so it is one file
    made = written(rows.repartition("_bucket"))
    made.repartition("_bucket").write.partitionBy("_bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/rows")
    if old is None:
        spark.createDataFrame([(str(buckets),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_buckets")
    return read_buckets(spark, path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a bucket table, None if there is none."""
    return spark.read.parquet(f"{path}/rows").drop("_bucket") if exists(spark, f"{path}/_buckets") else None


def merge(source: DataFrame, table: str, key: str = "employee_id") -> None:
    """Upsert into a catalog table that supports row-level operations."""
    condition = F.col(f"{table}.{key}") == F.col(f"_source.{key}")
    source.alias("_source").mergeInto(table, condition).whenMatched().updateAll().whenNotMatched().insertAll().merge()
