"""Session settings the operators are planned for.

None of these is required for right results.  They make hot keys and large shuffles
cheap: adaptive execution re-plans joins from measured sizes, splits skewed join
partitions and merges small ones, so no operator here hard-codes a partition count.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more exchange further up
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def session(app: str = "crewmetrics", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the recommended settings; ``conf`` uses ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
