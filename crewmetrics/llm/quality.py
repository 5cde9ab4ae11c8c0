"""Quality rules: statistics of texts, and an isolation forest over them with a threshold from labelled rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewmetrics.llm.scratch import written
from crewmetrics.llm.words import Words, mixed, rolling, slices, within
from crewmetrics.plans.prefix import by_value, running_totals

#: trees of the forest, and how many of all good rows each of them draws
TREES, TREE_ROWS = 200, 256
#: how far cuts may lie beyond the rows of a node, in ranges of the column
PAD = 0.1
#: share of the labelled good rows that the threshold may reject at most
LOSS = 0.002

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_digits", "n_distinct", "n_lines")
_SYMBOL, _UPPER, _DIGIT, _LATER = (np.zeros(256, np.int64) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER[0x41:0x5B] = 1
_DIGIT[0x30:0x3A] = 1
_LATER[0x80:0xC0] = 1  # bytes of a code point after its first


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def text_counts(column: pa.Array, window: int = 5) -> dict[str, np.ndarray]:
    """The ``COUNTS`` of each text; ``n_repeat_words`` are the words in windows found twice or more in their text."""
    words = Words(column)
    data, bounds, first = words.data, words.bounds, words.first
    n_words, n_bytes = words.counts(), np.diff(bounds)
    later = _per_text(_LATER[data], bounds)
    at_word = words.text_of()
    blanks = n_bytes - np.bincount(at_word, words.lengths, len(n_bytes)).astype(np.int64)
    h, _ = words.hashed()
    own = mixed(h ^ mixed(at_word.astype(np.uint64) + np.uint64(1)))
    n_distinct = np.bincount(at_word[np.unique(own, return_index=True)[1]], minlength=len(n_words)) if len(own) else np.zeros(len(n_words), np.int64)
    repeated = np.zeros(len(words) + 1, np.int32)
    places = np.flatnonzero(within(first, window, len(words)))
    if len(places):
        _, inverse, times = np.unique(rolling(own, window)[places], return_inverse=True, return_counts=True)
        found = places[times[inverse] > 1]
        np.add.at(repeated, found, 1)
        np.add.at(repeated, found + window, -1)
    n_lines, n_dup = [], []
    raw = data.tobytes()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
        n_lines.append(len(lines))
        n_dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": n_words, "word_chars": n_bytes - blanks - later, "n_symbols": _per_text(_SYMBOL[data], bounds), "n_dup_lines": np.array(n_dup, np.int64),
        "n_repeat_words": _per_text((np.cumsum(repeated)[:-1] > 0).astype(np.int64), first), "n_chars": n_bytes - later,
        "n_upper": _per_text(_UPPER[data], bounds), "n_digits": _per_text(_DIGIT[data], bounds), "n_distinct": n_distinct, "n_lines": np.array(n_lines, np.int64),
    }


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the ``COUNTS`` for each row, over whole texts; a null text counts as empty (all 0).

    Lines end at ``\\n``; those without a word are no lines.  Repeated rows and null keys stay; other columns are not read.
    """
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                counts = text_counts(part.column(text))
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], schema.names)

    return docs.select(key, text).mapInArrow(count, schema)


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray, least_words: int = 10, most_repeated: int = 20) -> np.ndarray:
    """Too few words, or too large a share (in percent) of them in repeated windows."""
    return (n_words < least_words) | (100 * n_repeat_words > most_repeated * n_words)


FEATURES = ("symbols", "repeated", "dup_lines", "upper", "digits", "word_length", "distinct", "words")


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The rule statistics of each row as ratios, one column for each of ``FEATURES``."""
    c = {k: np.asarray(v, float) for k, v in counts.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([
        np.log1p(c["n_symbols"] / words), c["n_repeat_words"] / words, c["n_dup_lines"] / lines, c["n_upper"] / chars, c["n_digits"] / chars,
        c["word_chars"] / words, c["n_distinct"] / words ** 0.9, np.log1p(c["n_words"]),
    ], 1)


@dataclass
class Forest:
    """Random trees as arrays: split column (-1 at a leaf), cut, first child, and depth with the leaf's expected rest."""

    column: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    length: np.ndarray
    usual: float
    threshold: float = math.inf

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path length over the usual one: near 1 for anomalies."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for column, cut, child, length in zip(self.column, self.cut, self.child, self.length, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                split = column[at]
                inner = split >= 0
                if not inner.any():
                    break
                at = np.where(inner, child[at] + (x[rows, np.maximum(split, 0)] >= cut[at]), at)
            total += length[at]
        return 2.0 ** (-total / (len(self.column) * self.usual))


def _usual_path(n: int) -> float:
    """Mean length of an unsuccessful search in a random tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def fit_forest(drawn: list[np.ndarray], scale: np.ndarray, seed: int = 7) -> Forest:
    """Isolation trees, each over the rows drawn for it, split at random columns and cuts.

    Cuts are drawn from a node's range widened on both ends by ``PAD`` times ``scale`` (the columns' ranges), so
    values beyond all rows of a tree end early, also in a column where those rows are alike.
    """
    random = np.random.default_rng(seed)
    trees, rows, pad = len(drawn), max(len(x) for x in drawn), PAD * scale
    deepest = max(1, math.ceil(math.log2(max(rows, 2))))
    size = 2 ** (deepest + 1)
    column, child = np.full((trees, size), -1), np.zeros((trees, size), np.int64)
    cut, length = np.zeros((trees, size)), np.zeros((trees, size))
    for tree in range(trees):
        waiting, free = [(0, drawn[tree], 0)], 1
        while waiting:
            node, part, depth = waiting.pop()
            low, high = (part.min(0) - pad, part.max(0) + pad) if len(part) else (pad, pad)
            split = np.flatnonzero(high > low)
            if depth == deepest or not len(split):
                length[tree, node] = depth + _usual_path(len(part))
                continue
            pick = random.choice(split)
            column[tree, node], cut[tree, node], child[tree, node] = pick, random.uniform(low[pick], high[pick]), free
            right = part[:, pick] >= cut[tree, node]
            waiting += [(free, part[~right], depth + 1), (free + 1, part[right], depth + 1)]
            free += 2
    return Forest(column, cut, child, length, max(_usual_path(rows), 1e-9))


def calibrate(scored: DataFrame, loss: float = LOSS) -> float:
    """The score from which a row goes: most bad rows above, less good ones, while at most ``loss`` of the good ones go.

    ``scored`` has ``score`` and ``good`` (boolean); all of its rows count, by running totals over the distinct scores.
    """
    good = F.col("good").cast("long")
    counted = written(scored.groupBy("score").agg(F.sum(good).alias("good"), F.sum(1 - good).alias("bad")))
    total = counted.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not total.good or not total.bad:
        return math.inf
    below = running_totals(by_value(counted, "score"), [F.col("score")], {"good_below": "good", "bad_below": "bad"})
    out = below.select("score", *[(1 - F.col(f"{side}_below") / F.lit(total[side])).alias(f"{side}_out") for side in ("good", "bad")])
    gains = out.where(F.col("good_out") <= loss).withColumn("gain", F.col("bad_out") - F.col("good_out"))
    best = gains.where("gain > 0").orderBy(F.col("gain").desc(), "score").first()
    if best is None:
        return math.inf
    under = counted.where(F.col("score") < best.score).agg(F.max("score")).first()[0]
    return best.score if under is None else (best.score + under) / 2


def _draws(good: DataFrame, n: int) -> list[np.ndarray]:
    """For each tree the features of ``TREE_ROWS`` of the ``n`` rows (all, if fewer): those with its smallest hashes of row and tree.

    Rows far from being drawn stay where they are; about 1.6 times as many as are drawn meet, tree by tree.
    """
    share = min(1.0, (TREE_ROWS + 10 * math.sqrt(TREE_ROWS)) / n)
    limit = np.uint64(min(2**64 - 1, int(share * 2**64)))
    trees, names = TREES, [f"x{i}" for i in range(len(FEATURES))]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in COUNTS})
            h = batch.column("_h").to_numpy().astype(np.uint64)
            for tree in range(trees):
                place = mixed(h ^ mixed(np.array([tree + 1], np.uint64)))
                at = np.flatnonzero(place <= limit)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), tree, np.int32)), pa.array((place[at] >> np.uint64(1)).astype(np.int64)), *(pa.array(c) for c in x[at].T)], ["tree", "place", *names]
                    )

    hashed = good.select(F.xxhash64("_of", *COUNTS).alias("_h"), *COUNTS)
    rows = hashed.mapInArrow(draw, "tree int, place long, " + ", ".join(f"{c} double" for c in names))
    first = F.row_number().over(Window.partitionBy("tree").orderBy("place", *names))
    # at most TREES times TREE_ROWS rows
    got = rows.withColumn("n", first).where(F.col("n") <= TREE_ROWS).drop("n").toPandas().sort_values(["tree", "place", *names])
    return [own[names].to_numpy() for _, own in got.groupby("tree")]


def _scale(rows: DataFrame) -> np.ndarray:
    """The range of each feature over all rows."""
    names = [f"x{i}" for i in range(len(FEATURES))]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = features({c: batch.column(c).to_numpy() for c in COUNTS})
                yield pa.RecordBatch.from_arrays([pa.array([low, high]) for low, high in zip(x.min(0), x.max(0), strict=True)], names)

    found = rows.select(*COUNTS).mapInArrow(ends, ", ".join(f"{c} double" for c in names))
    return np.array(found.agg(*[F.max(c) - F.min(c) for c in names]).first(), float)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Forest | None:
    """A forest grown on the good labelled rows, its threshold from good and bad ones.

    ``labels`` has ``key`` and 1 (good) or 0; null labels, null keys and keys without a row are left out, repeated labels of a
    key count once (bad if any is).  None without good rows; a threshold that rejects nothing without bad ones.
    """
    return fit_counts(written(statistics(docs.where(F.col(key).isNotNull()), key, text)), labels, key, label)


def fit_counts(counts: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Forest | None:
    """``fit`` from written ``statistics``.  All labelled rows count: trees draw from all of them, ranges and threshold are those of all."""
    told = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_of")).agg(F.min(label).alias("_label"))
    rows = written(counts.join(told, F.col(key) == F.col("_of")).select("_of", (F.col("_label") == 1).alias("good"), *COUNTS))
    n = rows.where("good").count()
    if not n:
        return None
    forest = fit_forest(_draws(rows.where("good"), n), _scale(rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.scores(features({c: batch.column(c).to_numpy() for c in COUNTS}))), batch.column("good")], ["score", "good"])

    forest.threshold = calibrate(rows.select("good", *COUNTS).mapInArrow(score, "score double, good boolean"))
    return forest


def _verdicts(counts: dict[str, np.ndarray], forest: Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Whether each text fails a base rule, is kept, and its anomaly."""
    failed = base_failed(counts["n_words"], counts["n_repeat_words"])
    scores = forest.scores(features(counts)) if forest else None
    return failed, ~failed & (scores < forest.threshold) if forest else ~failed, scores


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the ``COUNTS``, ``base_failed``, ``anomaly`` and ``kept`` (false if a base rule fails, else the forest's verdict).

    Whole texts, read once: the counts are written, and fit and verdicts read them.  A null text counts as empty; repeated rows
    and null keys stay; an empty table gives no rows.  Without a forest ``anomaly`` is null and the base rules decide.  Other
    columns are not read.
    """
    counted = written(statistics(docs, key, text))
    forest = fit_counts(counted, labels, key)
    more = [T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, kept, scores = _verdicts({c: batch.column(c).to_numpy() for c in COUNTS}, forest)
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(failed), pa.nulls(batch.num_rows, pa.float64()) if scores is None else pa.array(scores), pa.array(kept),
            ], [*batch.schema.names, "base_failed", "anomaly", "kept"])

    return counted.mapInArrow(judge, T.StructType([*counted.schema, *more]))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, all columns as they are; texts are not shuffled, and nothing else leaves the JVM."""
    forest = fit(docs, labels, key, text)

    @F.arrow_udf("boolean")
    def good(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        return pa.concat_arrays([pa.array(_verdicts(text_counts(part.column(0)), forest)[1], pa.bool_()) for part in slices(batch, "text")] or [pa.array([], pa.bool_())])

    return docs.where(good(F.col(text)))
