"""Ranked lexical search over a K2-treap: the best documents for each item by integer scores.

The index is a table of shards.  A shard is a grid of its terms (rows, by falling document frequency) and its documents
(columns, by length): a point is a term in a document, its value the term's impact there.  Points are held in Z order, so
a cell of any level of the quadtree is a run of them; cells with several points keep the greatest impact of the run, a
cell with one point is that point (the compressed part of the tree), an empty cell is not held.

A search descends the rows of an item's terms together, over ranges of documents: the sum of the weighted cell maxima
bounds every score in the range, the most promising ranges are halved first, rows whose cell is empty are left behind,
and ranges that can't reach the ranks held so far are dropped.  At a single document the cells are impacts and the sum is
its score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewmetrics.llm.scratch import written
from crewmetrics.llm.words import buffers, slices, text_column

#: bytes of text in a shard
SHARD_BYTES = 16 << 20
#: (item, term) pairs that one pass over the index holds: more items are searched in more passes
BLOCK_PAIRS = 1_000_000
#: items that a task searches together, and ranges of each that it halves at a time
ITEMS, RANGES = 256, 48

_LAST = np.iinfo(np.int64).max
_LEVEL = np.uint64(58)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of some texts (runs of ASCII letters, digits and characters beyond ASCII; A-Z lower-cased), and each text's bounds among them."""
    data, bounds = buffers(text_column(column))
    inside = _INSIDE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    begins[edges] = inside[edges]
    at = np.flatnonzero(begins)
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(inside, dtype=np.int64)))
    offsets = np.append(before[at], before[-1]).astype(np.int32)
    raw = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(_FOLD[data[inside]]))])
    return raw, np.searchsorted(at, bounds)


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2**32 at the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane; rising ones go as differences."""
    wide = numbers.dtype == np.uint64
    steps = np.diff(numbers, prepend=np.uint64(0)) if wide else numbers.astype(np.uint32)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), 8 if wide else 4).T)
    return zstandard.ZstdCompressor(3).compress(planes.tobytes())


def _widened(packed: pa.Scalar, wide: bool) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed.as_py()), np.uint8).reshape(8 if wide else 4, -1)
    steps = np.ascontiguousarray(planes.T).view(np.uint64 if wide else np.uint32).reshape(-1)
    return np.cumsum(steps, dtype=np.uint64) if wide else steps


def _listed(words: pa.Array) -> bytes:
    batch, sink = pa.RecordBatch.from_pydict({"w": words}), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's share of the score in a document of ``n`` terms, before its weight; 64-bit integers."""
    m = 100 - 50 + (50 * n.astype(np.int64) * n_docs) // max(1, n_terms)
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m)


def cells(z: np.ndarray, v: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells with at least two points at the levels above the points: (level and place, greatest value), by rising key."""
    keys, most = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for level in range(1, levels + 1):
        place = z >> np.uint64(2 * level)
        begins = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(z) else np.zeros(0, np.int64)
        several = np.diff(np.append(begins, len(z))) > 1
        if several.any():
            keys.append((np.uint64(level) << _LEVEL) | place[begins][several])
            most.append(np.maximum.reduceat(v, begins)[several])
    return np.concatenate(keys), np.concatenate(most)


@dataclass(frozen=True)
class Index:
    """Shards of the grid, the number of documents with a term, and the number of their terms with repeats."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Index every document; a written table of shards, made without a shuffle.

    ``key`` is an integer column.  Documents without a term, null and empty texts are not in the index; repeated rows are
    documents of their own.  A null key is held as the largest long, ranks behind all others and is given back as null.
    Other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SHARD_BYTES):
                n = np.diff(terms(part.column(text))[1])
                yield pa.RecordBatch.from_pydict({"docs": pa.array([int((n > 0).sum())]), "terms": pa.array([int(n.sum())])})

    total = docs.select(text).mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    names = ["shard", "keys", "terms", "dfs", "points", "impacts", "cells", "maxima"]
    schema = "shard string, keys array<long>, terms binary, dfs binary, points binary, impacts binary, cells binary, maxima binary"

    def grids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, text, SHARD_BYTES):
                raw, first = terms(part.column(text))
                if not len(raw):
                    continue
                n = np.diff(first)
                ids = pc.fill_null(part.column(key).cast(pa.int64()), _LAST).to_numpy(zero_copy_only=False)
                held = np.flatnonzero(n > 0)
                held = held[np.lexsort((ids[held], n[held]))]
                column = np.empty(len(n), np.int64)
                column[held] = np.arange(len(held))
                coded = raw.dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                pair, tf = np.unique(codes * len(held) + column[np.repeat(np.arange(len(n)), n)], return_counts=True)
                term, at = pair // len(held), pair % len(held)
                df = np.bincount(term, minlength=len(coded.dictionary))
                order = pc.sort_indices(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
                order = order[np.argsort(-df[order], kind="stable")]
                row = np.empty(len(order), np.int64)
                row[order] = np.arange(len(order))
                z = (_spread(row[term]) << np.uint64(1)) | _spread(at)
                along = np.argsort(z)
                z, v = z[along], impacts(tf, n[held][at], n_docs, n_terms)[along].astype(np.uint32)
                place, most = cells(z, v, _levels(len(order), len(held)))
                number += 1
                columns = [[f"{task}-{number}"], [ids[held]], [_listed(coded.dictionary.take(pa.array(order)))], [_squeezed(df[order])], [_squeezed(z)], [_squeezed(v)], [_squeezed(place)], [_squeezed(most)]]
                kinds = [pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return Index(written(docs.select(key, text).mapInArrow(grids, schema), "none"), n_docs, n_terms)


def _levels(rows: int, columns: int) -> int:
    return max(1, (max(rows, columns) - 1).bit_length())


class Grid:
    """A shard opened for searches."""

    def __init__(self, shard: pa.RecordBatch, row: int):
        get = lambda c: shard.column(c)[row]
        self.keys = shard.column("keys").slice(row, 1).flatten().to_numpy()
        self.terms = pa.ipc.open_stream(get("terms").as_buffer()).read_next_batch().column("w")
        self.z, self.v = _widened(get("points"), True), _widened(get("impacts"), False)
        self.places, self.maxima = _widened_cells(get("cells")), _widened(get("maxima"), False)
        self.levels = _levels(len(self.terms), len(self.keys))
        #: the smallest key of each range of documents, by level
        self.least = [self.keys]
        for level in range(1, self.levels + 1):
            self.least.append(np.minimum.reduceat(self.keys, np.arange(0, len(self.keys), 1 << level)))

    def greatest(self, level: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The greatest value in each cell, 0 where it is empty."""
        shift = np.uint64(2) * level
        at = np.searchsorted(self.z, place << shift)
        there = at < len(self.z)
        at[~there] = 0
        there &= (self.z[at] >> shift) == place
        out = np.where(there, self.v[at], 0).astype(np.int64)
        if len(self.places):
            wanted = (level << _LEVEL) | place
            several = np.flatnonzero(there & (level > 0))
            found = np.minimum(np.searchsorted(self.places, wanted[several]), len(self.places) - 1)
            hit = self.places[found] == wanted[several]
            out[several[hit]] = self.maxima[found[hit]]
        return out


def _widened_cells(packed: pa.Scalar) -> np.ndarray:
    return _widened(packed, True)


class Ranks:
    """The best documents so far of each item of a group: by falling score, then by rising key."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.item, self.score, self.key = (np.zeros(0, np.int64) for _ in range(3))
        #: score and key of the last rank, once all are taken
        self.least, self.last = np.ones(n, np.int64), np.full(n, _LAST)
        self.full = np.zeros(n, bool)

    def add(self, item: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        item, score, key = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.key, key)))
        order = np.lexsort((key, -score, item))
        order = order[_rank(item[order]) < self.k]
        self.item, self.score, self.key = item[order], score[order], key[order]
        ends = np.flatnonzero(_rank(self.item) == self.k - 1)
        who = self.item[ends]
        self.full[who], self.least[who], self.last[who] = True, self.score[ends], self.key[ends]

    def open(self, item: np.ndarray, bound: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Whether something with this bound and no smaller key may still get a rank."""
        least = self.least[item]
        return (bound > least) | ((bound == least) & (~self.full[item] | (key < self.last[item])))


def _rank(sorted_items: np.ndarray) -> np.ndarray:
    """Place of each entry among those of its item, which stand together."""
    begins = np.flatnonzero(np.concatenate(([True], sorted_items[1:] != sorted_items[:-1]))) if len(sorted_items) else np.zeros(0, np.int64)
    return np.arange(len(sorted_items)) - np.repeat(begins, np.diff(np.append(begins, len(sorted_items))))


def search_grid(grid: Grid, rows: np.ndarray, weights: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], ranks: Ranks, ranges: int = RANGES) -> int:
    """Bring the ranks of a group of items up to date with a shard; gives the number of cells looked at.

    ``rows`` and ``weights`` by term (row -1 where the shard lacks it), ``pairs`` the (item, term) of the group by item.
    """
    spread, looked = _spread(np.maximum(rows, 0)), 0
    held = rows[pairs[1]] >= 0
    owner, term = pairs[0][held], pairs[1][held]
    # one entry for each item: the whole range of documents, and the rows of its terms
    item, counts = np.unique(owner, return_counts=True)
    level, column = np.full(len(item), grid.levels, np.uint64), np.zeros(len(item), np.int64)
    bound = np.full(len(item), _LAST)
    while len(item):
        order = np.lexsort((-bound, item))
        chosen = np.zeros(len(item), bool)
        chosen[order[_rank(item[order]) < ranges]] = True
        chosen &= level > 0
        # halve the chosen ranges; the rows of both halves start from the rows that the range still has
        first = np.cumsum(counts) - counts
        own = np.flatnonzero(chosen)
        size = counts[own]
        place = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        child_term = np.concatenate((term[place], term[place]))
        child_level = np.tile(level[own] - np.uint64(1), 2)
        child_column = np.concatenate((2 * column[own], 2 * column[own] + 1))
        child_item, child_size = np.tile(item[own], 2), np.tile(size, 2)
        wide = np.repeat(child_level, child_size)
        cell = ((spread[child_term] >> (np.uint64(2) * wide)) << np.uint64(1)) | np.repeat(_spread(child_column), child_size)
        value = grid.greatest(wide, cell)
        looked += len(value)
        child = np.repeat(np.arange(len(child_item)), child_size)
        live = value > 0
        child_counts = np.bincount(child[live], minlength=len(child_item))
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(weights[child_term] * value)))
        ends = np.cumsum(child_size)
        child_bound = sums[ends] - sums[ends - child_size]
        # what is left of the old entries, and the new ones
        stay = ~chosen
        term = np.concatenate((term[np.repeat(stay, counts)], child_term[live]))
        item, level, column = np.concatenate((item[stay], child_item)), np.concatenate((level[stay], child_level)), np.concatenate((column[stay], child_column))
        bound, counts = np.concatenate((bound[stay], child_bound)), np.concatenate((counts[stay], child_counts))
        single = np.flatnonzero((level == 0) & (bound > 0))
        if len(single):
            ranks.add(item[single], bound[single], grid.keys[column[single]])
        key = np.full(len(item), _LAST)
        for lv in np.unique(level):
            some = np.flatnonzero((level == lv) & (bound > 0))
            key[some] = grid.least[int(lv)][column[some]]
        keep = (level > 0) & (bound > 0)
        keep &= ranks.open(item, bound, key)
        term = term[np.repeat(keep, counts)]
        item, level, column, bound, counts = (x[keep] for x in (item, level, column, bound, counts))
        # the terms stand in the order of the entries, and entries of an item need not stand together
    return looked


def _document_frequencies(index: Index, asked: pa.Array) -> dict[int, int]:
    """How many documents hold each asked term, by its number."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held = pa.ipc.open_stream(batch.column("terms")[row].as_buffer()).read_next_batch().column("w")
                at = pc.index_in(asked, value_set=held)
                known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                df = _widened(batch.column("dfs")[row], False)[at.drop_null().to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(known.astype(np.int64)), pa.array(df.astype(np.int64))], ["term", "df"])

    found = index.shards.select("terms", "dfs").mapInArrow(look, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in found.collect()}


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(index: Index, items: DataFrame, k: int = 50, item: str = "item_id", text: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``item, rank, doc_id, score``: the ``k`` best documents of each item, equal scores by rising key.

    Only scores above 0 count, so an item may have fewer than ``k`` rows, or none (null, empty or unknown texts).  Rows with
    the same item id are one item with all their terms; rows without one are left out.  Items are searched in blocks of about
    ``block_pairs`` terms: the terms of one block, their frequencies and weights are held by every task, the documents
    never are.  Each task keeps ``k`` ranks for each item over all its shards, and those are ranked once more.
    """
    kind = items.schema[item].dataType

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, first = terms(batch.column(text))
            owners = batch.column(item).take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(first))))
            yield pa.RecordBatch.from_arrays([owners, raw], ["item", "term"])

    asked = items.where(F.col(item).isNotNull()).select(item, text)
    asked = asked.mapInArrow(listed, T.StructType([T.StructField("item", kind), T.StructField("term", T.BinaryType())])).distinct()
    asked = written(asked)
    blocks = max(1, -(-asked.count() // block_pairs))
    schema = T.StructType([T.StructField("item", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    best = [_search_block(index, asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k, schema) for b in range(blocks)]
    found = best[0]
    for more in best[1:]:
        found = found.unionByName(more)
    ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return found.select(F.col("item").alias(item), "rank", F.nullif("doc_id", F.lit(_LAST)).alias("doc_id"), "score")


def _search_block(index: Index, asked: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    pairs = asked.toArrow().combine_chunks()
    coded = [c.combine_chunks().dictionary_encode() if isinstance(c, pa.ChunkedArray) else c.dictionary_encode() for c in pairs.columns]
    coded = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in coded]
    names, words = (c.dictionary for c in coded)
    owner, term = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in coded)
    order = np.argsort(owner, kind="stable")
    owner, term = owner[order], term[order]
    df = _document_frequencies(index, words) if len(words) else {}
    weights = np.array([weight(index.n_docs, df[t]) if t in df else 0 for t in range(len(words))], np.int64)
    shared = index.shards.sparkSession.sparkContext.broadcast((names, words, owner, term, weights))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, words, owner, term, weights = shared.value
        groups = range(0, len(names), ITEMS)
        ranks = [Ranks(min(ITEMS, len(names) - g), k) for g in groups]
        for batch in batches:
            for row in range(batch.num_rows):
                grid = Grid(batch, row)
                rows = pc.fill_null(pc.index_in(words, value_set=grid.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                for g, held in zip(groups, ranks, strict=True):
                    a, b = np.searchsorted(owner, [g, g + ITEMS])
                    search_grid(grid, rows, weights, (owner[a:b] - g, term[a:b]), held)
        for g, held in zip(groups, ranks, strict=True):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(held.item + g)), pa.array(held.key), pa.array(held.score)], schema.names)

    return index.shards.drop("dfs").mapInArrow(best, schema)
