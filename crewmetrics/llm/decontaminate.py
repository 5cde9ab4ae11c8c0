"""Benchmark decontamination: spaced-seed hashes that leave fixed token positions open, and verified overlaps around hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewmetrics.llm.words import Words, mixed, rolling, slices, within

#: each mask reads the positions marked 1 of a window of 9 words; any one position is open in one mask
MASKS = ("011011011", "101101101", "110110110")
SPAN = len(MASKS[0])
#: words that are compared on each side of a hit's window
AROUND = 15
WIDTH = SPAN + 2 * AROUND
#: an overlap scores 1 for a word that is equal and this for another; from LEAST on, or this share of a shorter item's words, it is a leak
OTHER, LEAST, SHARE = -2, 10, 0.4
#: items of fewer words than a window are compared whole, from so many words on
SHORTEST = 5
#: bits of the table that tells which hashes cannot be in the benchmark: its size is fixed, whatever the benchmark's
FILTER_BITS = 25

_FACTORS = np.random.default_rng(3).integers(0, 2**63, SPAN, np.uint64) * np.uint64(2) + np.uint64(1)


def seeds(h: np.ndarray) -> list[np.ndarray]:
    """For each mask the hash of every window's marked words."""
    n = max(0, len(h) - SPAN + 1)
    out = []
    for number, mask in enumerate(MASKS):
        total = np.full(n, number + 1, np.uint64)
        for i, marked in enumerate(mask):
            if marked == "1":
                total += h[i : i + n] * _FACTORS[i]
        out.append(mixed(total))
    return out


def _contexts(prints: np.ndarray, first: np.ndarray, texts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The prints of the words around each window, 0 beyond its text."""
    at = places[:, None] + np.arange(-AROUND, SPAN + AROUND)[None, :]
    inside = (at >= first[texts][:, None]) & (at < first[texts + 1][:, None])
    return np.where(inside, prints[np.clip(at, 0, max(len(prints) - 1, 0))], np.uint32(0))


def best_overlap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: score of the best stretch of aligned words, and how many of its words are equal."""
    equal, beyond = a == b, (a == 0) | (b == 0)
    score, same = np.zeros(len(a), np.int32), np.zeros(len(a), np.int32)
    top, top_same = score.copy(), same.copy()
    for i in range(a.shape[1]):
        score = np.maximum(np.where(equal[:, i], score + 1, score + OTHER), 0)
        score[beyond[:, i]] = 0
        same = np.where(score > 0, same + equal[:, i], 0)
        better = score > top
        top, top_same = np.where(better, score, top), np.where(better, same, top_same)
    return top, top_same


def least(b: np.ndarray) -> np.ndarray:
    """The score from which an overlap with an item counts, from the prints around its windows (all of an item of up to 24 words)."""
    n = (b != 0).sum(1)
    return np.where(n < SPAN, n, np.minimum(LEAST, np.ceil(SHARE * n))).astype(np.int32)


def _places(words: Words, h: np.ndarray, short: list[int], whole: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, places and hashes of the windows: those of the masks, and of each ``short`` size all, or only ``whole`` texts."""
    places = np.flatnonzero(within(words.first, SPAN, len(words)))
    for hashes in seeds(h):
        yield SPAN, places, hashes[places]
    for size in short:
        places = np.flatnonzero(within(words.first, size, len(words)))
        if whole:
            places = places[words.counts()[words.text_of()[places]] == size]
        yield size, places, mixed(rolling(h, size)[places] + np.uint64(size))


def _hits(rows: DataFrame, key: str, text: str, usable, short: list[int], whole: bool = False) -> DataFrame:
    """``key, place, hash, words, size`` for each window of ``_places`` that ``usable`` (hashes to booleans) does not rule out."""
    schema = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("place", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("size", T.LongType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                words = Words(part.column(text))
                h, other = words.hashed(lower=True)
                at_text = words.text_of()
                prints = np.maximum(other >> np.uint64(32), np.uint64(1)).astype(np.uint32)
                for size, places, hashes in _places(words, h, short, whole):
                    kept = usable(hashes)
                    places, hashes = places[kept], hashes[kept]
                    for i in range(0, len(places), 8192):
                        some = places[i : i + 8192]
                        texts = at_text[some]
                        around = _contexts(prints, words.first, texts, some)
                        packed = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.arange(0, 4 * WIDTH * len(some) + 1, 4 * WIDTH, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(around))])
                        yield pa.RecordBatch.from_arrays([
                            part.column(key).take(pa.array(texts)), pa.array(some - words.first[texts]), pa.array(hashes[i : i + 8192].view(np.int64)), packed, pa.array(np.full(len(some), size, np.int64)),
                        ], schema.names)

    return rows.select(key, text).mapInArrow(find, schema)


def _table(seeded: DataFrame) -> np.ndarray:
    """A bit for each value that the top bits of a benchmark hash have, at most ``2 ** FILTER_BITS``."""
    slot = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    words = seeded.select(slot.alias("slot")).selectExpr("shiftright(slot, 5) AS word", "shiftleft(1L, int(slot % 32)) AS bit")
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    table[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return table


def overlaps(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``key, item, place, score, same``: for each document and benchmark item that overlap, their best overlap.

    Words are compared with A-Z lower-cased.  A hit is a window of ``SPAN`` words that is equal in the marked
    positions of a mask; the ``WIDTH`` words around it are compared one by one, and the overlap counts from a score of
    ``LEAST``, or for an item of fewer than 25 words from ``SHARE`` of its words.  ``place`` is the document's first word of the
    window (of several equally good the first).  Items of fewer words than a window match where all their words are in a
    row; items of fewer than ``SHORTEST`` words match nothing, null and empty texts neither.  Rows that repeat an id count
    as one document; rows without an id, on either side, are left out.

    The benchmark may be of any size: hashes meet in a join.  A table of fixed size (``2 ** FILTER_BITS`` bits), made
    of partial sums on the executors, keeps most windows that have no partner out of it.
    """
    known = _hits(benchmark.select(F.col(item).alias("key"), F.col(item_text).alias("text")).where("key is not null"), "key", "text", lambda h: np.ones(len(h), bool), list(range(SHORTEST, SPAN)), True)
    short = [r[0] for r in known.where(F.col("size") < SPAN).select("size").distinct().collect()]
    known = known.select(F.col("key").alias("item"), F.col("hash"), F.col("words").alias("item_words")).distinct()
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(_table(known.select("hash")))
    shift, low = np.uint64(64 - FILTER_BITS), np.uint64(31)

    def usable(h: np.ndarray) -> np.ndarray:
        slot = h >> shift
        return (table.value[slot >> np.uint64(5)] >> (slot & low).astype(np.uint32) & np.uint32(1)).astype(bool)

    hits = _hits(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null"), "key", "text", usable, short)
    schema = T.StructType([hits.schema["key"], known.schema["item"]] + [T.StructField(c, T.LongType()) for c in ("place", "score", "same")])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, WIDTH) for c in ("words", "item_words"))
            score, same = best_overlap(a, b)
            good = pa.array(score >= least(b))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("item"), batch.column("place"), pa.array(score.astype(np.int64)), pa.array(same.astype(np.int64))], schema.names).filter(good)

    found = hits.join(known, "hash").select("key", "item", "place", "words", "item_words").mapInArrow(verify, schema)
    best = F.max(F.struct("score", "same", (-F.col("place")).alias("back"))).alias("best")
    return found.groupBy("key", "item").agg(best).select(
        F.col("key").alias(key), F.col("item").alias(item), (-F.col("best.back")).alias("place"), "best.score", "best.same"
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **names: str) -> DataFrame:
    """``key, contaminated, n_items, best_score`` for each row, rows without an id (never contaminated) included."""
    item = names.get("item", "item_id")
    per = overlaps(docs, benchmark, key, **names).groupBy(F.col(key).alias("_of")).agg(F.count(item).alias("n_items"), F.max("score").alias("best_score"))
    joined = docs.select(key).join(per, F.col(key) == F.col("_of"), "left")
    return joined.select(key, F.col("_of").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "best_score")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **names: str) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, all columns as they are."""
    leaks = overlaps(docs, benchmark, key, **names).select(F.col(key).alias("_leak")).distinct()
    return docs.join(leaks, docs[key] == leaks["_leak"], "left_anti")
