"""Connected components as alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewmetrics.llm.scratch import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an edge: ``root`` is the smallest node that it reaches.

    Ends with a null and loops are no links; repeated edges count once; no edges give no rows.  Every
    step is a group-by with partial minima and a join with one row for each node, so a node with a third of all
    edges is spread by Spark's handling of skewed joins.  The edges of each step are written to the shared folder;
    the steps end when one changes nothing (their number grows with the logarithm of the longest path).
    """
    links = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = written(links.where(links.columns[2]).select("a", "b").distinct())
    state = _state(links)
    while True:
        links = written(_small_star(_large_star(links)))
        before, state = state, _state(links)
        if state == before:
            roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _state(links: DataFrame) -> tuple:
    """Count and content of an edge table, whatever its order."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node gets the node's smallest neighbour, or the node itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("of"), F.least("a", "least").alias("least"))
    # a > b in links: the node is b, its larger neighbour a
    return links.join(least, links["b"] == least["of"]).select("a", F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours get the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("of"), "least")
    moved = links.join(least, links["a"] == least["of"]).where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select(F.col("of").alias("a"), F.col("least").alias("b"))).distinct()
