"""Identifier masking and date buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_id(value: Column, salt: str) -> Column:
    """``H_`` and 16 hex digits of a salted SHA-256; equal ids stay joinable, null stays null."""
    digest = F.sha2(F.concat(value.cast("string"), F.lit(salt)), 256)
    return F.concat(F.lit("H_"), F.substring(digest, 1, 16))


def mask_columns(df: DataFrame, columns: list[str], salt: str) -> DataFrame:
    """Mask the named columns; the column's name decides the form, absent names are ignored."""
    masked = {}
    for name in columns:
        if name not in df.columns:
            continue
        hashed = hash_id(df[name], salt)
        if name.endswith("_id"):
            masked[name] = hashed
        elif "email" in name.lower():
            masked[name] = F.concat(F.lit("masked_"), hashed, F.lit("@example.com"))
        else:
            masked[name] = F.concat(F.lit("masked_"), hashed)
    return df.withColumns(masked) if masked else df


def pii_columns(df: DataFrame, compat: bool = False) -> list[str]:
    """Columns that look personal by name.

    An id is a whole ``_``-separated word, so ``provider`` is left alone; ``compat=True``
    matches the letters ``id`` anywhere, as the original rule does.
    """

    def personal(name: str) -> bool:
        low = name.lower()
        is_id = "id" in low if compat else "id" in low.split("_")
        return is_id or "name" in low or "email" in low

    return [name for name in df.columns if personal(name)]


def bucket_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<c>_year``, ``<c>_quarter`` and ``<c>_month``; what is not a date becomes null."""
    present = [name for name in columns if name in df.columns]
    parsed = {name: F.col(name).try_cast("timestamp_ntz") for name in present}
    parts = {}
    for name in present:
        parts[f"{name}_year"] = F.year(name)
        parts[f"{name}_quarter"] = F.quarter(name)
        parts[f"{name}_month"] = F.month(name)
    return df.withColumns(parsed).withColumns(parts) if present else df
