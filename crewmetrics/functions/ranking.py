"""Rank named values inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def top_names(values: dict[str, Column], n: int, ties: str) -> Column:
    """Names of the ``n`` largest values, as an array.

    ``ties="first"`` prefers the value listed earlier, ``ties="last"`` the one listed later.
    Values equal to 9 digits tie: sums of doubles differ in the last bits with the order in which
    tasks finish, and a rank must not.
    """
    sign = {"first": -1, "last": 1}[ties]
    entries = [
        F.struct(F.round(value.cast("double"), 9).alias("v"), F.lit(sign * i).alias("i"), F.lit(name).alias("name"))
        for i, (name, value) in enumerate(values.items())
    ]
    ranked = F.sort_array(F.array(*entries), asc=False)
    return F.transform(F.slice(ranked, 1, n), lambda e: e["name"])
