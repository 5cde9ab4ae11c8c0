"""Running totals over a global order without a single-task window."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 500_000
MAX_RANGES = 65_536


def by_value(df: DataFrame, order: str) -> DataFrame:
    """Adds ``_range``, the range number of a numeric column, about ``RANGE_ROWS`` rows each.

    The range bounds are approximate quantiles and only balance the work.  They are fixed literals
    afterwards, so every scan of the plan, a retried task included, puts a row into the same range.  Rows without a value
    are range -1.
    """
    ranges = min(MAX_RANGES, df.count() // RANGE_ROWS + 1)
    bounds = []
    if ranges > 1:
        steps = [i / ranges for i in range(1, ranges)]
        bounds = sorted(set(df.stat.approxQuantile(order, steps, 1.0 / (4 * ranges))))
    splits = [-float("inf"), *bounds, float("inf")]
    if len(splits) < 3:
        return df.withColumn("_range", F.when(F.col(order).isNull(), -1).otherwise(0))
    ranged = Bucketizer(splits=splits, inputCol=order, outputCol="_range", handleInvalid="keep").transform(df)
    return ranged.withColumn("_range", F.when(F.col(order).isNull(), -1).otherwise(F.col("_range").cast("int")))


def by_hash(df: DataFrame, *columns: str, bits: int = 12) -> DataFrame:
    """Adds ``_range`` for a hash order: the leading bits, balanced without looking at the data."""
    return df.withColumn("_range", F.shiftrightunsigned(F.xxhash64(*columns), 64 - bits).cast("int"))


def running_totals(
    staged: DataFrame, order: list[Column], sums: dict[str, str]
) -> DataFrame:
    """Add, per name in ``sums``, the total of that column over all rows strictly before.

    ``staged`` has a ``_range`` (see ``by_value`` and ``by_hash``) that rises with ``order``, and
    ``order`` must be unique.  Each range is sorted by its own task; only one row per
    range meets in the window that turns range totals into offsets.
    """
    totals = staged.groupBy("_range").agg(
        *[F.sum(column).alias(f"_t_{name}") for name, column in sums.items()]
    )
    # one row per range: the only window over everything
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range",
        *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums],
    )
    inside = (
        Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        staged.join(offsets, "_range")
        .withColumns(
            {
                name: F.col(f"_o_{name}") + F.coalesce(F.sum(column).over(inside), F.lit(0))
                for name, column in sums.items()
            }
        )
        .drop("_range", *[f"_o_{name}" for name in sums])
    )
