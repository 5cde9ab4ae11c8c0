"""Rows in numbered chunks, and entries that meet by bucket and go back to their chunk.

A chunk keeps its rows and their order in one written row, so that several passes number its words alike, whatever
tasks are lost.  Entries travel as arrays, one row for each chunk and bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewmetrics.llm.scratch import written
from crewmetrics.llm.words import Words, slices, text_column

#: bytes of text in a chunk, and words for one bucket
CHUNK_BYTES, BUCKET_WORDS = 4 << 20, 4_000_000


def chunked(rows: DataFrame, text: str) -> DataFrame:
    """``chunk, n_words, packed`` from all columns of ``rows``; null texts become empty; no rows, no chunks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, text, CHUNK_BYTES):
                part = part.set_column(part.schema.get_field_index(text), text, text_column(part.column(text)))
                part = part.take(pa.array(range(part.num_rows)))  # without the rest of the batch
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_pydict({
                    "chunk": [f"{task}-{number}"], "n_words": [len(Words(part.column(text)))], "packed": [sink.getvalue().to_pybytes()],
                })
                number += 1

    return written(rows.mapInArrow(pack, "chunk string, n_words long, packed binary"), "none")


def unpacked(packed: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed.as_buffer()).read_next_batch()


def bucket_count(chunks: DataFrame) -> int:
    """Grows with the words; not under the session's shuffle partitions."""
    n_words = chunks.agg(F.sum("n_words")).first()[0] or 0
    return max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_words // BUCKET_WORDS))


def runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of each run of a sorted array."""
    if not len(values):
        return []
    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
    return [(int(values[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def by_bucket(rows: DataFrame, judge: Callable[[pa.Table], list[bytes | None]], name: str) -> DataFrame:
    """``chunk`` and, as array ``name`` of (bucket, found), what ``judge`` finds for each row of a bucket (none where null)."""

    def apply(table: pa.Table) -> pa.Table:
        kept = [(c, b, m) for c, b, m in zip(table["chunk"].to_pylist(), table["bucket"].to_pylist(), judge(table), strict=True) if m is not None]
        columns = zip(*kept, strict=True) if kept else ([], [], [])
        return pa.table([pa.array(list(x), k) for x, k in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["chunk", "bucket", "found"])

    found = rows.groupBy("bucket").applyInArrow(apply, "chunk string, bucket long, found binary")
    return found.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "found")).alias(name))


def found_by_bucket(column: pa.ListScalar) -> dict[int, bytes]:
    return {x["bucket"]: x["found"] for x in column.as_py() or []}
