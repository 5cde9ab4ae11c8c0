"""Quality measures: exact AUC, classification report, hit@k, exact medians."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewmetrics.plans.prefix import by_value, running_totals
from crewmetrics.plans.scratch import written


def auc_exact(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row ``auc``: share of (positive, negative) pairs ranked right, ties counting half.

    Rows are first counted per distinct score; the number of negatives below each score comes
    from distributed running totals.  Null without both classes.  The value is computed here, as
    the evaluators of Spark ML do, so that the counts can be kept while they are read and dropped.
    """
    positive = (F.col(label) == 1).cast("bigint")
    counted = (
        scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).cast("double").alias("_score"))
        .agg(F.sum(positive).alias("_pos"), F.sum(1 - positive).alias("_neg"))
    )
    counted = counted.persist(StorageLevel.MEMORY_AND_DISK)
    ranked = running_totals(by_value(counted, "_score"), [F.col("_score")], {"_below": "_neg"})
    won = F.sum(F.col("_pos").cast("double") * (F.col("_below") + F.col("_neg") / 2.0))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    auc = ranked.agg(F.try_divide(won, pairs).alias("auc")).first().auc
    counted.unpersist()
    return scored.sparkSession.createDataFrame([(auc,)], "auc double")


#: the bits of a double that one pass settles, highest first
_DIGITS = (20, 22, 22)


def _sortable(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order; -0.0 is 0.0, NaN comes last."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)


def _double(number: int) -> float:
    bits = (number ^ (1 << 63)) & ((1 << 64) - 1)
    bits = bits - (1 << 64) if bits >> 63 else bits
    return float(np.array([bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)], np.int64).view(np.float64)[0])


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians of all columns together; null without values.

    The columns are written once.  Three passes settle the middle values of all columns digit by digit, as a radix sort would: a
    pass counts the next bits of the values that begin as the wanted ones do, tasks count before the shuffle, and two
    digits for each column come back.  No value is sorted and the number of passes hangs neither on the rows nor on the columns.
    """
    narrow = written(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
    settled = [0] * (2 * len(columns))  # the bits so far of the lower and the upper middle value of each column
    ranks: list[int | None] = [None] * len(settled)
    known, done = set(range(len(settled))), 0
    for width in _DIGITS:
        found = _digits(narrow, settled, ranks, known, done, width).collect()
        known = {r.side for r in found}
        for r in found:
            settled[r.side], ranks[r.side] = settled[r.side] << width | r.digit, r.rank - r.before
        done += width
    out = {}
    for i, c in enumerate(columns):
        low, high = (_double(settled[2 * i + j]) if 2 * i + j in known else None for j in (0, 1))
        out[c] = low if low is None or low == high else (low + high) / 2.0
    return out


def _digits(narrow: DataFrame, settled: list[int], ranks: list[int | None], known: set[int], done: int, width: int) -> DataFrame:
    """``side, digit, rank, before``: the next digit of each wanted value, its rank, and how many values come before the digit."""
    shift, seen = np.uint64(64 - done - width), np.uint64(64 - done)
    sides = sorted(known)

    def count(batches):
        for batch in batches:
            for side in sides:
                values = batch.column(side // 2).drop_null().to_numpy(zero_copy_only=False)
                bits = _sortable(values)
                if done:
                    bits = bits[(bits >> seen) == np.uint64(settled[side])]
                digit, n = np.unique((bits >> shift) & np.uint64((1 << width) - 1), return_counts=True)
                if len(digit):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(digit), side, np.int32)), pa.array(digit.astype(np.int64)), pa.array(n.astype(np.int64))], ["side", "digit", "n"]
                    )

    counted = narrow.mapInArrow(count, "side int, digit long, n long").groupBy("side", "digit").agg(F.sum("n").alias("n"))
    # at most as many rows as a digit has values
    upto = Window.partitionBy("side").orderBy("digit")
    whole = Window.partitionBy("side")
    # the middle of n values: (n - 1) / 2 and n / 2, cut
    rank = F.floor((F.sum("n").over(whole) - 1 + F.col("side") % 2) / 2)
    if done:
        rank = F.get(F.array(*[F.lit(r).cast("long") for r in ranks]), F.col("side"))
    placed = counted.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("rank", rank)
    return placed.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).select("side", "digit", "rank", "before")


def classification_report(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """(name, precision, recall, f1, support): classes, accuracy, macro and weighted averages.

    Everything is column arithmetic on the confusion counts; an empty denominator gives 0.
    """
    confusion = (
        scored.where(F.col(label).isNotNull() & F.col(predicted).isNotNull())
        .groupBy(F.col(label).cast("int").alias("l"), F.col(predicted).cast("int").alias("p"))
        .agg(F.count("*").alias("n"))
    )
    zero, n = F.lit(0).cast("bigint"), F.col("n")
    right = F.when(F.col("l") == F.col("p"), n).otherwise(zero)
    sides = F.array(  # class, support, predicted, right
        F.struct(F.col("l").alias("c"), n.alias("s"), zero.alias("q"), right.alias("t")),
        F.struct(F.col("p").alias("c"), zero.alias("s"), n.alias("q"), zero.alias("t")),
    )
    counts = confusion.select(F.inline(sides)).groupBy("c").agg(*[F.sum(x).alias(x) for x in "sqt"])

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    classes = counts.withColumns({"precision": ratio(F.col("t"), F.col("q")), "recall": ratio(F.col("t"), F.col("s"))})
    f1 = ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    classes = classes.withColumn("f1", f1)
    measures = ["precision", "recall", "f1"]
    # one row per class: the averages are a single small aggregate over them
    summary = classes.agg(
        ratio(F.sum("t"), F.sum("s")).alias("acc"),
        F.sum("s").alias("support"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[ratio(F.sum(F.col(m) * F.col("s")), F.sum("s")).alias(f"weighted_{m}") for m in measures],
    )
    def line(name: str, columns: list[str]) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            *[F.col(c).alias(m) for c, m in zip(columns, measures)],
            F.col("support").alias("support"),
        )

    averages = summary.select(
        F.inline(
            F.array(
                line("accuracy", ["acc"] * 3),
                line("macro avg", [f"macro_{m}" for m in measures]),
                line("weighted avg", [f"weighted_{m}" for m in measures]),
            )
        )
    )
    per_class = classes.select(F.col("c").cast("string").alias("name"), *measures, F.col("s").alias("support"))
    return per_class.unionByName(averages)


def hit_at_k(hits: DataFrame, relevant: DataFrame, key: list[str], k: int) -> DataFrame:
    """One row: queries with a relevance judgement and the share with a relevant row in the top k.

    ``relevant`` holds (query_id, key...).
    """
    # relevant rows are read once: they may be as dear to make as the hits
    found = hits.where(F.col("rank") <= k).select("query_id", *key).distinct().withColumn("_hit", F.lit(1))
    judged = relevant.select("query_id", *key).join(found, ["query_id", *key], "left")
    return judged.groupBy("query_id").agg(F.max(F.coalesce("_hit", F.lit(0))).alias("hit")).agg(
        F.count("*").alias("queries"), F.avg("hit").alias("hit_rate")
    )
