"""Put group results on the rows of the groups when one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: parts into which the rows of a group are dealt; one bit of a long for each
SALTS = 64


def attach_groups(
    df: DataFrame, keys: list[str], results: dict[str, Column], row_columns: dict[str, Column] | None = None
) -> DataFrame:
    """``df`` with ``row_columns`` per row and ``results`` per group of ``keys``.

    ``results`` may use the row columns.  One aggregate, whose partial sums are formed before its shuffle, gives the results
    of a group and, as the bits of a number, into which of ``SALTS`` parts a hash of their columns deals its rows.  A result
    goes to each part that exists, so there are never more of them than rows, and rows and results are joined by key
    and part: a group with a third of all rows is spread over many tasks.  Copies of one row share a part, which adaptive
    execution can split further, as both sides of the join are shuffled for it.  The table is read twice, and the plan is
    the same at every size.  Rows without a key get null results.
    """
    row_columns = row_columns or {}
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    salted = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    present = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_part")))
    stats = (
        salted.where(known)
        .withColumns(row_columns)
        .groupBy(*keys)
        .agg(present.alias("_parts"), *[column.alias(name) for name, column in results.items()])
    )
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    held = F.filter(every, lambda part: F.getbit("_parts", part) == 1)
    spread = stats.withColumn("_part", F.explode(held)).drop("_parts")
    columns = [*df.columns, *[name for name in row_columns if name not in df.columns]]
    return salted.withColumns(row_columns).join(spread, [*keys, "_part"], "left").select(*columns, *results)
