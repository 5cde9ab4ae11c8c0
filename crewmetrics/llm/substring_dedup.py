"""Substring dedup: fixed blocks of reference text as anchors, probed with every rolling window.

A window of ``2 * block - 1`` words or more holds a whole block that starts at a multiple of ``block`` in its
document.  So a repeated window has, in each document, only blocks that occur at a second place of the corpus: these
blocks are the hits.  Windows whose blocks are all hits are the candidates; they are compared as whole windows, and
overlapping repeated windows make up the maximal exact repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewmetrics.llm.chunks import bucket_count, by_bucket, chunked, found_by_bucket, runs, unpacked
from crewmetrics.llm.scratch import written
from crewmetrics.llm.words import Words, buffers, rolling, within

#: bits of a window's hash within its bucket; others than those that choose the bucket
_PRINT = np.uint64((1 << 30) - 1)
_LAST = np.int64(2**63 - 1)


class _Chunk:
    """The anchors and windows of one chunk; the same from the same bytes, in every pass."""

    def __init__(self, batch: pa.RecordBatch, block: int, window: int, buckets: int):
        self.block, self.window, self.buckets = block, window, np.uint64(buckets)
        keys = batch.column("key")
        #: order of the documents; one without an id comes last
        self.ids = np.where(keys.is_null().to_numpy(zero_copy_only=False), _LAST, keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        self.words = Words(batch.column("text"))
        self.at_text = self.words.text_of()
        self.place = np.arange(len(self.words)) - self.words.first[:-1][self.at_text] if len(self.words) else np.zeros(0, np.int64)
        self.hash, self.other = self.words.hashed()

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct short windows (bucket and print), whether each is found twice, is a block; and the number of each block's window."""
        h = rolling(self.hash, self.block)
        ok = within(self.words.first, self.block, len(self.words))
        places = np.flatnonzero(ok)
        marks = ((h[places] >> np.uint64(32)) % self.buckets) << np.uint64(32) | (h[places] & _PRINT)
        order = np.argsort(marks, kind="stable")
        ranked = marks[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        starts = np.flatnonzero(new)
        number = np.empty(len(places), np.int64)
        number[order] = np.cumsum(new) - 1
        aligned = self.place[places] % self.block == 0
        is_block = np.zeros(len(starts), bool)
        is_block[number[aligned]] = True
        twice = np.diff(np.append(starts, len(ranked))) > 1
        block_number = np.full(len(self.words) + 1, -1, np.int64)
        block_number[places[aligned]] = number[aligned]
        return ranked[starts], twice, is_block, block_number

    def candidates(self, hits: np.ndarray, block_number: np.ndarray) -> np.ndarray:
        """The windows whose blocks are all hits; ``hits`` by number of the distinct short windows."""
        ok = within(self.words.first, self.window, len(self.words))
        if not len(ok):
            return np.zeros(0, np.int64)
        hit = np.append(hits, False)[block_number]  # by place; -1 where no block begins
        at = np.arange(len(ok))
        offset = -self.place[: len(ok)] % self.block
        found = ok.copy()
        for k in range(self.window // self.block + 1):
            begin = offset + k * self.block
            inside = begin + self.block <= self.window
            found &= ~inside | hit[np.minimum(at + begin, len(hit) - 1)]
        return np.flatnonzero(found)

    def windows(self, places: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct windows at ``places``: bucket, hash, smallest document id; the number of each place's window."""
        h, bucket = rolling(self.hash, self.window)[places], rolling(self.other, self.window)[places] % self.buckets
        ids = self.ids[self.at_text[places]]
        order = np.lexsort((ids, h, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        return bucket[first], h[first], ids[first], number


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _hits_of(distinct: np.ndarray, is_block: np.ndarray, masks: dict[int, bytes]) -> np.ndarray:
    hits = np.zeros(len(distinct), bool)
    for bucket, a, b in runs((distinct >> np.uint64(32)).astype(np.int64)):
        if bucket in masks:
            blocks = a + np.flatnonzero(is_block[a:b])
            hits[blocks] = _flags(masks[bucket], len(blocks))
    return hits


def _judge_anchors(table: pa.Table) -> list[bytes | None]:
    """For each chunk's short windows of a bucket: which blocks occur at a second place."""
    parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["entries"]]
    entries = np.concatenate(parts)
    order = np.argsort(entries >> 2, kind="stable")
    prints = entries[order] >> 2
    new = np.ones(len(prints), bool)
    new[1:] = prints[1:] != prints[:-1]
    starts = np.flatnonzero(new)
    again = np.diff(np.append(starts, len(prints))) > 1
    again |= np.maximum.reduceat((entries[order] >> 1) & 1, starts).astype(bool)
    hit = np.empty(len(entries), bool)
    hit[order] = again[np.cumsum(new) - 1]
    out, at = [], 0
    for part in parts:
        mine = hit[at : at + len(part)][(part & 1).astype(bool)]
        out.append(_bits(mine) if mine.any() else None)
        at += len(part)
    return out


def _judge_windows(table: pa.Table) -> list[bytes | None]:
    """For each chunk's windows of a bucket: which occur in a document with a smaller id than all of the chunk's."""
    hashes, ids = [], []
    for row in range(table.num_rows):
        hashes.append(np.frombuffer(table["hashes"][row].as_buffer(), np.uint64))
        held = np.frombuffer(table["ids"][row].as_buffer(), np.int64)
        ids.append(held[np.frombuffer(table["numbers"][row].as_buffer(), np.uint32)])
    h, d = np.concatenate(hashes), np.concatenate(ids)
    order = np.lexsort((d, h))
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    least = d[order][new][np.cumsum(new) - 1]
    earlier = np.empty(len(h), bool)
    earlier[order] = d[order] > least
    out, at = [], 0
    for part in hashes:
        mine = earlier[at : at + len(part)]
        out.append(_bits(mine) if mine.any() else None)
        at += len(part)
    return out


def _removed(chunk: _Chunk, places: np.ndarray, number: np.ndarray, first_ids: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Which words the repeated ones among the windows at ``places`` cover."""
    text = chunk.at_text[places]
    order = np.lexsort((places, text, number))
    before = np.zeros(len(order), bool)  # the same window earlier in its own text
    before[1:] = (number[order][1:] == number[order][:-1]) & (text[order][1:] == text[order][:-1])
    repeated = earlier[number] | (chunk.ids[text] > first_ids[number])
    repeated[order] |= before
    cover = np.zeros(len(chunk.words) + 1, np.int32)
    np.add.at(cover, places[repeated], 1)
    np.add.at(cover, places[repeated] + chunk.window, -1)
    return np.cumsum(cover)[:-1] > 0


def repeats(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256, spans`` (and ``kept_text``) for each row.

    A window of ``window`` words is repeated if the same words start earlier: in a document with a smaller id, or
    before in the same one.  The words of repeated windows go; ``spans`` are their maximal runs (first word,
    number of words).  ``kept_sha256`` is of the kept words joined by one space.  Ids are integers; rows with equal
    ids are not earlier than each other, one without an id is later than all.  A null or empty text has no words.

    Short windows travel as 32-bit prints grouped by task, chunk and bucket, so one that the whole corpus shares costs
    one entry for each chunk; whole windows are compared by 64 bits within a bucket chosen by other bits.  The number
    of buckets grows with the words.  Other columns are not read.
    """
    if window < 3:
        raise ValueError("a window needs 3 words")
    block = (window + 1) // 2
    chunks = chunked(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text")
    buckets = bucket_count(chunks)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, packed in zip(batch.column("chunk").to_pylist(), batch.column("packed"), strict=True):
                distinct, twice, is_block, _ = _Chunk(unpacked(packed), block, window, buckets).anchors()
                entries = (distinct & _PRINT).astype(np.uint32) << 2 | twice.astype(np.uint32) << 1 | is_block
                rows = runs((distinct >> np.uint64(32)).astype(np.int64))
                if rows:
                    yield pa.RecordBatch.from_pydict({"bucket": [r[0] for r in rows], "chunk": [name] * len(rows), "entries": [entries[a:b].astype("<u4").tobytes() for _, a, b in rows]})

    anchors = chunks.select("chunk", "packed").mapInArrow(probe, "bucket long, chunk string, entries binary")
    hits = by_bucket(anchors, _judge_anchors, "hits")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, packed, masks in zip(batch.column("chunk").to_pylist(), batch.column("packed"), batch.column("hits"), strict=True):
                chunk = _Chunk(unpacked(packed), block, window, buckets)
                distinct, _, is_block, block_number = chunk.anchors()
                places = chunk.candidates(_hits_of(distinct, is_block, found_by_bucket(masks)), block_number)
                bucket, h, ids, _ = chunk.windows(places)
                marked = np.zeros(len(chunk.words), bool)
                marked[places] = True
                rows = runs(bucket.astype(np.int64))
                held = [np.unique(ids[a:b], return_inverse=True) for _, a, b in rows]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([r[0] for r in rows] + [-1], pa.int64()), "chunk": [name] * (len(rows) + 1),
                    "hashes": pa.array([h[a:b].tobytes() for _, a, b in rows] + [_bits(marked)], pa.binary()),
                    "numbers": pa.array([x[1].astype("<u4").tobytes() for x in held] + [None], pa.binary()),
                    "ids": pa.array([x[0].astype("<i8").tobytes() for x in held] + [None], pa.binary()),
                })

    with_hits = chunks.select("chunk", "packed").join(hits, "chunk")
    extended = written(with_hits.mapInArrow(extend, "bucket long, chunk string, hashes binary, numbers binary, ids binary"))
    marked = extended.where("bucket = -1").select("chunk", F.col("hashes").alias("marked"))
    earlier = by_bucket(extended.where("bucket >= 0"), _judge_windows, "earlier")

    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("n", T.LongType())]))),
    ] + [T.StructField("kept_text", T.StringType())] * keep_text)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, marks, masks in zip(batch.column("packed"), batch.column("marked"), batch.column("earlier"), strict=True):
                yield _finished(unpacked(packed), marks, found_by_bucket(masks), (block, window, buckets), schema.names)

    whole = chunks.select("chunk", "packed").join(marked.join(earlier, "chunk", "left"), "chunk", "left")
    return whole.mapInArrow(finish, schema)


def _finished(batch: pa.RecordBatch, marks: pa.Scalar, masks: dict[int, bytes], sizes: tuple[int, int, int], names: list[str]) -> pa.RecordBatch:
    """The result rows of one chunk."""
    words = Words(batch.column("text"))
    gone = np.zeros(len(words), bool)
    marked = np.flatnonzero(_flags(marks.as_py(), len(words))) if marks.is_valid else np.zeros(0, np.int64)
    if len(marked):
        texts = np.unique(words.text_of()[marked])  # only these are hashed again
        chunk = _Chunk(batch.take(pa.array(texts)), *sizes)
        shift = np.repeat(words.first[texts], words.counts()[texts]) + chunk.place
        places = np.searchsorted(shift, marked)
        bucket, _, ids, number = chunk.windows(places)
        earlier = np.zeros(len(bucket), bool)
        for name, a, b in runs(bucket.astype(np.int64)):
            if name in masks:
                earlier[a:b] = _flags(masks[name], b - a)
        gone[shift] = _removed(chunk, places, number, ids, earlier)
    data, bounds = buffers(batch.column("text"))
    raw, out = data.tobytes(), [[], [], [], [], []]
    for a, b, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        own, lost = raw[a:b].split(), gone[i:j]
        n_lost = int(lost.sum())
        if n_lost:
            own = [w for w, x in zip(own, lost.tolist(), strict=True) if not x]
        kept = b" ".join(own)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], lost, [False])).astype(np.int8))).reshape(-1, 2) if n_lost else []
        for column, value in zip(out, (j - i, n_lost, hashlib.sha256(kept).hexdigest(), [{"first": int(x), "n": int(y - x)} for x, y in edges], kept.decode()), strict=True):
            column.append(value)
    arrays = [batch.column("key"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
    arrays.append(pa.array(out[3], pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))))
    return pa.RecordBatch.from_arrays((arrays + [pa.array(out[4], pa.string())])[: len(names)], names)
