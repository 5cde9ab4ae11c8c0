"""Named tables of the session catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from crewmetrics.sources.files import read_csv


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A whole table, lazily: later filters and column choices reach the scan."""
    return spark.table(name)


def query(spark: SparkSession, sql: str, args: dict | list | None = None) -> DataFrame:
    """SQL with named (``:x``) or positional (``?``) parameters."""
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def replace_table(df: DataFrame, name: str) -> None:
    """Create or replace a table with the rows of ``df``."""
    df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(name)


def table_from_csv(
    spark: SparkSession, name: str, path: str, schema: T.StructType | None = None, ordinal: bool = False
) -> DataFrame:
    """Load a CSV file into a table; types are inferred if no schema is given."""
    replace_table(read_csv(spark, path, schema, ordinal), name)
    return spark.table(name)
