"""Best-fit packing: bounded-space online best fit over a bitset of open bins keyed by free space."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewmetrics.llm.scratch import written
from crewmetrics.llm.tokens import ENCODED_BYTES, Encoder
from crewmetrics.llm.words import slices

#: bins that one task keeps open
OPEN_BINS = 1024
#: a bin that a first-round task closes for lack of room is done if at most this share of it is free
SPARE = 1 / 64
#: pieces for one task of the second round
SECOND_ROUND_PIECES = 16_000


class OpenBins:
    """At most ``limit`` open bins of ``size``; each holds what was placed in it until it closes."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.open, self.bits = size, limit, 0, 0
        self.by_free: dict[int, list[list]] = {}

    def _put(self, free: int, held: list) -> None:
        self.by_free.setdefault(free, []).append(held)
        self.bits |= 1 << free

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        held = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        return held

    def place(self, length: int, item) -> tuple[list, int] | None:
        """Put ``item`` where it leaves least room; gives back a bin that closed, with its room."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            held = self._take(free)
        else:
            free, held = self.size, []
            self.open += 1
        held.append((self.size - free, item))
        free -= length
        if not free:
            self.open -= 1
            return held, 0
        self._put(free, held)
        if self.open > self.limit:
            self.open -= 1
            fullest = (self.bits & -self.bits).bit_length() - 1
            return self._take(fullest), fullest
        return None

    def rest(self) -> Iterator[tuple[list, int]]:
        for free, bins in self.by_free.items():
            for held in bins:
                yield held, free


def cut_lengths(n: int, size: int) -> list[int]:
    """Lengths of a document's pieces: whole sequences, and before them what is over."""
    return [n] if n <= size else [n % size] * (n % size > 0) + [size] * (n // size)


def _schema(key_type, ids: bool) -> T.StructType:
    fields = [T.StructField("key", key_type)]
    fields += [T.StructField(c, T.LongType()) for c in ("piece", "start", "length", "crc", "bin", "place")]
    return T.StructType(fields + [T.StructField("done", T.BooleanType())] + [T.StructField("ids", T.BinaryType())] * ids)


def _rows(columns: list[list], schema: T.StructType, key_type: pa.DataType) -> pa.RecordBatch:
    kinds = [key_type] + [pa.int64()] * 6 + [pa.bool_(), pa.binary()][: len(schema) - 7]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)


def pack(
    docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text",
    open_bins: int = OPEN_BINS, keep_ids: bool = False,
) -> DataFrame:
    """A row for each piece: ``key, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    A document is its token ids and ``end_id``; a null or empty text is the end alone.  Longer ones are cut
    into pieces of ``size`` after a first piece with the rest.  Each task packs what it has encoded, best fit
    into at most ``open_bins`` open bins: the fullest closes when there are more.  Nearly full bins are done;
    the pieces of all others are dealt out by a hash of their content to a second round of the same rule,
    which closes all.  Offsets in a sequence have no gaps.  Repeated rows are packed each; null keys stay null.
    ``ids`` are little-endian unsigned 32-bit numbers.  Other columns are not read.
    """
    schema = _schema(docs.schema[key].dataType, keep_ids)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = Encoder.of(tokenizer), OpenBins(size, open_bins)
        number = TaskContext.get().partitionId() << 34
        out: list[list] = [[] for _ in schema]

        def close(held: list, done: bool) -> None:
            nonlocal number
            number += 1
            for place, item in held:
                for column, value in zip(out, (*item[:5], number, place, done, *item[5:]), strict=True):
                    column.append(value)

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(key).type
            for part in slices(batch, text, ENCODED_BYTES):
                ids, bounds = encoder.ids(part.column(text))
                for name, a, b in zip(part.column(key).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    whole = np.append(ids[a:b], end_id).astype("<u4")
                    start = 0
                    for piece, length in enumerate(cut_lengths(len(whole), size)):
                        raw = whole[start : start + length].tobytes()
                        item = (name, piece, start, length, zlib.crc32(raw), *[raw] * keep_ids)
                        start += length
                        closed = bins.place(length, item)
                        if closed:
                            close(closed[0], closed[1] <= size * SPARE)
                if len(out[0]) >= 4096:
                    yield _rows(out, schema, key_type)
                    out = [[] for _ in schema]
        for held, free in bins.rest():
            close(held, free <= size * SPARE)
        if out[0]:
            yield _rows(out, schema, key_type)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(size, open_bins)
        number = (1 << 62) + (TaskContext.get().partitionId() << 34)
        out: list[list] = [[] for _ in schema]

        def close(held: list) -> None:
            nonlocal number
            number += 1
            for place, item in held:
                for column, value in zip(out, (*item[:5], number, place, True, *item[5:]), strict=True):
                    column.append(value)

        key_type = None
        for batch in batches:
            key_type = batch.schema.field("key").type
            columns = [batch.column(c).to_pylist() for c in ("key", "piece", "start", "length", "crc", *["ids"] * keep_ids)]
            for item in zip(*columns, strict=True):
                closed = bins.place(item[3], item)
                if closed:
                    close(closed[0])
            if len(out[0]) >= 4096:
                yield _rows(out, schema, key_type)
                out = [[] for _ in schema]
        for held, _ in bins.rest():
            close(held)
        if out[0]:
            yield _rows(out, schema, key_type)

    placed = written(docs.select(key, text).mapInArrow(first, schema))
    left = placed.where(~F.col("done"))
    tasks = max(1, -(-left.count() // SECOND_ROUND_PIECES))
    again = left.repartition(tasks, F.xxhash64("key", "piece", "crc", "bin")).mapInArrow(second, schema)
    both = placed.where("done").unionByName(written(again))
    return both.select(
        F.col("key").alias(key), F.col("piece").cast("int").alias("piece"), "start", "length",
        F.col("crc").alias("ids_crc32"), F.col("bin").alias("sequence_id"), F.col("place").alias("offset"), *["ids"] * keep_ids,
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids`` from ``pack(keep_ids=True)``: the pieces one after the other, at most a sequence's tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
