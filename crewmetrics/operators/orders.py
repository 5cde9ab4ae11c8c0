"""Row numbers, and permutations of them that need no sort."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: rounds of a permutation
ROUNDS = 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permuted(numbers: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed one-to-one map of 0 .. n - 1 onto itself, number by number.

    A round pairs each number with the round's constant less the number, modulo n, and a hash of the larger one of a pair
    decides whether the two change places.  That is one-to-one for every n, so no number has to be looked for.
    """
    x = numbers.astype(np.int64)
    if n < 2:
        return x
    for r in range(rounds):
        seed = _mixed(np.array([(key * 0x9E3779B97F4A7C15 + r + 1) & (1 << 64) - 1], np.uint64))
        partner = (int(seed[0] % np.uint64(n)) - x) % n
        larger = np.maximum(x, partner).astype(np.uint64)
        change = (_mixed(larger * np.uint64(0x9E3779B97F4A7C15) ^ seed) >> np.uint64(63)) > 0
        x = np.where(change, partner, x)
    return x


def split_starts(table: DataFrame) -> tuple[dict[int, int], int]:
    """How many rows of a written table come before each of its splits, and the number of all rows; one small row for a split."""
    counts = table.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("n")).orderBy("split").collect()
    starts, total = {}, 0
    for row in counts:
        starts[row.split] = total
        total += row.n
    return starts, total


def numbered(table: DataFrame, starts: dict[int, int], number: str = "_number", moved: str | None = None, n: int = 0, keys: list[int] = ()) -> DataFrame:
    """The rows of a written table with dense numbers, in the order of its splits.

    With ``moved``, each row comes once for each of ``keys``, which stands beside it as ``_rep``, and under the number that the
    permutation of that key of ``n`` rows gives it.
    """
    fields = [T.StructField(number, T.LongType())] + [T.StructField("_rep", T.IntegerType())] * bool(moved)

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        at = None
        for batch in batches:
            if at is None:
                at = starts[TaskContext.get().partitionId()]
            own = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            if moved is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, number])
                continue
            for rep, key in enumerate(keys):
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(permuted(own, n, key)), pa.array(np.full(len(own), rep, np.int32))], [*batch.schema.names, number, "_rep"]
                )

    return table.mapInArrow(count, T.StructType([*table.schema, *fields]))
