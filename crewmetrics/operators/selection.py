"""Lookups by id and membership filters, for one value, a short list or a table of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class UnknownKey(LookupError):
    """A requested id is not in the table."""


def lookup(df: DataFrame, key: str, value, missing: str = "empty") -> DataFrame:
    """Rows of one id; the equality reaches the parquet scan.  ``missing="error"`` raises."""
    found = df.where(F.col(key) == F.lit(value))
    if missing == "error" and found.isEmpty():
        raise UnknownKey(f"{key}={value!r} not found")
    return found


def among(df: DataFrame, key: str, ids: DataFrame | list | None) -> DataFrame:
    """Rows whose id is listed; no list, or an empty one, means all rows.

    A table of ids is a semi join, which Spark broadcasts only after measuring it.
    """
    if ids is None or (isinstance(ids, list) and not ids):
        return df
    if isinstance(ids, list):
        return df.where(F.col(key).isin(ids))
    return df.join(ids.select(key), key, "left_semi").select(*df.columns)


def unknown(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Requested ids that the table does not hold."""
    return ids.join(df.select(key), key, "left_anti")
