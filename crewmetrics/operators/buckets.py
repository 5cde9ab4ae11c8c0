"""Approximate nearest vectors by random projections: a saved table of buckets, probed nearest first.

In each of some tables a vector has a bucket: one bit for each of some random lines through the origin, by the side that the
vector lies on.  A query visits its own bucket and, in the order of the distance that it would have to move, those
on the other side of the lines that it is near to.  Buckets and queries meet by (table, bucket) in groups of
bounded size; scores are exact.  A query that has not found k rows visits more buckets, and one that still lacks rows
is compared exactly, so every query gets as many rows as the corpus holds, up to k.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewmetrics.operators.knn import checked, knn, ranked, result_schema, scored, scorer
from crewmetrics.plans.scratch import written

#: corpus rows that a bucket should hold, from which the number of lines follows
BUCKET_ROWS = 1000
MAX_BITS = 24
#: a second round visits this many times the buckets of the first
MORE = 4


@dataclass(frozen=True)
class BucketIndex:
    """``table, bucket, key, vector``: each corpus row once in each table; and the settings of the lines."""

    rows: DataFrame
    key: list[str]
    dim: int
    tables: int
    bits: int
    seed: int
    metric: str

    def lines(self) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(size=(self.tables, self.dim, self.bits))

    def corpus(self) -> DataFrame:
        """The indexed rows, once each."""
        return self.rows.where(F.col("table") == 0).drop("table", "bucket")


def bits_for(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    return min(MAX_BITS, max(1, (max(1, rows // bucket_rows) - 1).bit_length()))


def build(
    corpus: DataFrame, *, key: list[str], metric: str = "l2", dim: int | None = None, tables: int = 4, bits: int | None = None, seed: int = 42,
) -> BucketIndex:
    """Put every row with a vector into its bucket of every table, in one pass; write ``rows`` to search it often.

    Without ``bits`` the rows are counted, and buckets hold about ``BUCKET_ROWS`` of them.
    """
    corpus, _, dim = checked(corpus, corpus.withColumn("query_id", F.lit(0)), key, "query_id", metric, dim)
    index = BucketIndex(corpus, key, dim, tables, bits_for(corpus.count()) if bits is None else bits, seed, metric)
    lines, to_matrix = index.lines(), scorer(1, metric, key, dim)[1]
    fields = [T.StructField("table", T.IntegerType()), T.StructField("bucket", T.IntegerType())]

    def code(batches):
        import pyarrow as pa

        weights = 1 << np.arange(lines.shape[2])
        for batch in batches:
            m = to_matrix(batch)
            for number, own in enumerate(lines):
                bucket = ((m @ own > 0) * weights).sum(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(m), number, np.int32)), pa.array(bucket)], [*batch.schema.names, "table", "bucket"])

    rows = corpus.mapInArrow(code, T.StructType([*corpus.schema, *fields]))
    return BucketIndex(rows, key, dim, tables, index.bits, seed, metric)


def nearest_flips(costs: np.ndarray, count: int) -> list[int]:
    """The ``count`` sets of lines (as bits) that cost least to cross together, cheapest first."""
    import heapq

    order = np.argsort(costs, kind="stable")
    cost = costs[order].tolist()
    out, heap = [0], [(cost[0], 0, 1 << int(order[0]))] if cost else []
    # each set follows from a cheaper one: its last line is replaced by the next one, or the next one is added
    while heap and len(out) < count:
        total, last, flips = heapq.heappop(heap)
        out.append(flips)
        if last + 1 < len(cost):
            nxt = 1 << int(order[last + 1])
            heapq.heappush(heap, (total + cost[last + 1], last + 1, flips | nxt))
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], last + 1, flips ^ (1 << int(order[last])) | nxt))
    return out


def probes(index: BucketIndex, queries: DataFrame, first: int, last: int) -> DataFrame:
    """The queries with the ``table`` and ``bucket`` of their visits, from number ``first`` up to ``last``."""
    lines, to_matrix = index.lines(), scorer(1, index.metric, index.key, index.dim)[1]
    fields = [T.StructField("table", T.IntegerType()), T.StructField("bucket", T.IntegerType())]

    def look(batches):
        import pyarrow as pa

        weights = 1 << np.arange(lines.shape[2])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                m = to_matrix(part)
                for number, own in enumerate(lines):
                    side = m @ own
                    home = ((side > 0) * weights).sum(axis=1)
                    flips = [nearest_flips(c, last)[first:] for c in side * side]
                    row = np.repeat(np.arange(len(m)), [len(f) for f in flips])
                    bucket = home[row] ^ np.array([x for f in flips for x in f], np.int64)
                    kept = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.full(len(row), number, np.int32)), pa.array(bucket.astype(np.int32))], [*part.schema.names, "table", "bucket"])

    return queries.mapInArrow(look, T.StructType([*queries.schema, *fields]))


def search(index: BucketIndex, queries: DataFrame, *, query_key: str = "query_id", k: int = 4, visits: int = 8) -> DataFrame:
    """(query_id, rank, key, score): about the ``k`` nearest rows of each query, with exact scores, ties by key.

    Rounds are run here, one after the other; what a round finds is written (``plans.scratch``), at most ``k`` rows for each query.
    Every query with a vector gets the smaller of ``k`` and the corpus size; query ids must be unique.  ``visits`` buckets
    of each table are looked at first, up to ``MORE`` times as many by queries that found too little.  More visits, tables or
    rows to a bucket find more of the true neighbours and compare more pairs.
    """
    key, metric = index.key, index.metric
    rows, queries, _ = checked(index.rows.select(*index.rows.columns), queries, [*key, "table", "bucket"], query_key, metric, index.dim)
    schema = result_schema(rows, queries, key)

    def round_(asked: DataFrame, first: int, last: int) -> DataFrame:
        found = scored(rows, probes(index, asked, first, last), ["table", "bucket"], schema, k, metric, key, index.dim)
        # a row may be found in several tables, with the same score
        return ranked(found.groupBy("query_id", *key).agg(F.min("score").alias("score")), k, metric, key).drop("rank")

    def short(asked: DataFrame, found: DataFrame) -> DataFrame:
        full = found.groupBy("query_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= k)
        return asked.join(full, "query_id", "left_anti")

    found, left, first = None, queries, 0
    for last in (visits, visits * MORE):
        near = written(round_(left, first, last))
        found = near if found is None else ranked(found.unionByName(near).distinct(), k, metric, key).drop("rank")
        left, first = short(queries, found), last
        if left.isEmpty():
            return ranked(found, k, metric, key)
    exact = knn(index.corpus(), left, key=key, k=k, metric=metric, dim=index.dim).drop("rank")
    return ranked(found.unionByName(exact).distinct(), k, metric, key)


def compared(index: BucketIndex, queries: DataFrame, *, query_key: str = "query_id", visits: int = 8) -> DataFrame:
    """One row ``pairs``: how many (query, row) pairs the first round of a search compares, copies in several tables counted each."""
    rows, queries, _ = checked(index.rows, queries, [*index.key, "table", "bucket"], query_key, index.metric, index.dim)
    held = rows.groupBy("table", "bucket").agg(F.count("*").alias("_n"))
    asked = probes(index, queries, 0, visits).groupBy("table", "bucket").agg(F.count("*").alias("_m"))
    return held.join(asked, ["table", "bucket"]).agg(F.coalesce(F.sum(F.col("_n") * F.col("_m")), F.lit(0)).alias("pairs"))
