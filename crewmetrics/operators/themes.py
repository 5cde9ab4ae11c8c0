"""Themes in free text: a non-negative factorisation X ~ W H of TF-IDF vectors.

X (texts x terms) and W (texts x themes) stay distributed; H has at most
themes x ``max_features`` numbers and lives on the driver.  For a given H every row of W is its
own small least-squares problem, so W is recomputed inside the pass that uses it: it is never
stored, carries no lineage from one round to the next, and a lost executor costs only its tasks.
Each pass returns the sums W'X, W'W and the squared error, which are themes x terms rows in all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewmetrics.functions import text as tx
from crewmetrics.operators import tfidf
from crewmetrics.plans.scratch import written
from crewmetrics.schemas import has

MAX_THEMES = 100
_SWEEPS = 40


def _products():
    """Products of a batch of sparse rows with dense matrices; no row is ever dense.

    The functions travel inside the closures that use them, so workers need no installed package.
    """

    def parts(batch):
        lists = batch.column("indices")
        row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
        return row, np.asarray(lists.flatten(), dtype=np.int64), np.asarray(batch.column("weights").flatten(), dtype=np.float64)

    def times(batch, matrix):
        """X M for M (terms x columns)."""
        row, term, weight = parts(batch)
        return np.stack([np.bincount(row, weight * matrix[term, j], batch.num_rows) for j in range(matrix.shape[1])], axis=1)

    def transposed_times(batch, matrix, width):
        """M' X for M (rows x columns)."""
        row, term, weight = parts(batch)
        return np.stack([np.bincount(term, weight * matrix[row, j], width) for j in range(matrix.shape[1])])

    def squares(batch):
        return float((parts(batch)[2] ** 2).sum())

    return times, transposed_times, squares


def _block_solver(components: np.ndarray, sweeps: int):
    """A function from an Arrow batch of sparse rows to (X H', W)."""
    times = _products()[0]
    turned, g = np.ascontiguousarray(components.T), components @ components.T

    def solve(batch):
        a = times(batch, turned)
        w = np.zeros_like(a)
        for _ in range(sweeps):
            before = w.copy()
            for j in range(w.shape[1]):
                if g[j, j] > 0:
                    w[:, j] = np.maximum(0.0, w[:, j] + (a[:, j] - w @ g[:, j]) / g[j, j])
            if np.abs(w - before).max(initial=0.0) < 1e-9:
                break
        return a, w

    return solve


def _summed(x: DataFrame, shape: tuple[int, int], work) -> np.ndarray:
    """The sum of ``work`` over all blocks of rows: one matrix of the given shape, added up by tasks, then by cell."""

    def partial(batches):
        import pyarrow as pa

        sums = np.zeros(shape)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                sums += work(batch.slice(at, 2000))
        r, c = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"r": pa.array(r, pa.int32()), "c": pa.array(c, pa.int32()), "v": pa.array(sums[r, c])})

    cells = x.select("indices", "weights").mapInArrow(partial, "r int, c int, v double").groupBy("r", "c").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(shape)
    for cell in cells:
        total[cell.r, cell.c] = cell.v
    return total


def _pass(x: DataFrame, components: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """W'X, W'W and the squared error of one round."""
    solve = _block_solver(components, _SWEEPS)
    _, transposed_times, squares = _products()
    k, width = components.shape
    g = components @ components.T

    def work(batch):
        a, w = solve(batch)
        own = w.T @ w
        error = squares(batch) - 2.0 * (w * a).sum() + (own * g).sum()
        return np.hstack([transposed_times(batch, w, width), own, np.full((k, 1), error)])

    total = _summed(x, (k, width + k + 1), work)
    return total[:, :width], total[:, width : width + k], max(0.0, float(total[0, -1]))


def _start(x: DataFrame, k: int, width: int, seed: int, more: int = 8) -> np.ndarray:
    """Themes to begin with: the non-negative sides of the leading directions of X, from a randomised range finder.

    Two passes: X'(X R) for a few random columns R spans the directions, and X'X within them orders them.  Both sums have at
    most terms x (themes + ``more``) numbers.  Each direction is turned so that its larger side is the positive one.
    """
    times, transposed_times, _ = _products()
    columns = min(width, k + more)
    random = np.random.default_rng(seed).normal(size=(width, columns))
    basis = np.linalg.qr(_summed(x, (columns, width), lambda batch: transposed_times(batch, times(batch, random), width)).T)[0]

    def inside(batch):
        own = times(batch, basis)
        return own.T @ own

    values, vectors = np.linalg.eigh(_summed(x, (basis.shape[1],) * 2, inside))
    order = np.argsort(-values, kind="stable")[:k]
    directions = (basis @ vectors[:, order]).T
    up, down = np.maximum(directions, 0.0), np.maximum(-directions, 0.0)
    larger = (up**2).sum(axis=1) >= (down**2).sum(axis=1)
    h = np.where(larger[:, None], up, down) + 1e-3 / np.sqrt(width)
    if len(h) < k:  # fewer directions than themes
        h = np.vstack([h, np.abs(np.random.default_rng(seed + 1).normal(size=(k - len(h), width))) / np.sqrt(width)])
    return h


def _improve(h: np.ndarray, wx: np.ndarray, ww: np.ndarray, sweeps: int = _SWEEPS) -> np.ndarray:
    h = h.copy()
    for _ in range(sweeps):
        for t in range(len(h)):
            if ww[t, t] > 0:
                h[t] = np.maximum(0.0, h[t] + (wx[t] - ww[t] @ h) / ww[t, t])
    return h


@dataclass
class Themes:
    """A fitted factorisation."""

    components: np.ndarray
    terms: list[str]
    vocab: DataFrame
    losses: list[float] = field(default_factory=list)

    @property
    def n_themes(self) -> int:
        return len(self.components)

    def top_terms(self, n: int = 9) -> list[str]:
        """The ``n`` heaviest terms of each theme, joined by a comma."""
        ranked = np.argsort(self.components, axis=1, kind="stable")[:, ::-1][:, :n]
        return [", ".join(self.terms[i] for i in row) for row in ranked]

    def term_table(self, spark, n: int = 9) -> DataFrame:
        rows = [(i + 1, terms) for i, terms in enumerate(self.top_terms(n))]
        return spark.createDataFrame(rows, "theme int, terms string")

    def scores(self, vecs: DataFrame, key: str | list[str]) -> DataFrame:
        """(key, theme_1_score .. theme_k_score) of vectors over this vocabulary."""
        solve, k = _block_solver(self.components, _SWEEPS), self.n_themes
        keys = [key] if isinstance(key, str) else key
        schema = T.StructType([*[vecs.schema[c] for c in keys], *[T.StructField(f"theme_{i + 1}_score", T.DoubleType()) for i in range(k)]])

        def score(batches):
            import pyarrow as pa

            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    _, w = solve(part)
                    columns = {c: part.column(c) for c in keys}
                    columns.update({f"theme_{i + 1}_score": pa.array(w[:, i].copy()) for i in range(k)})
                    yield pa.RecordBatch.from_pydict(columns)

        return vecs.select(*keys, "indices", "weights").mapInArrow(score, schema)


def fit_themes(
    docs: DataFrame,
    key: str,
    text: str = "free_text",
    n_themes: int = 5,
    max_features: int = 1000,
    max_iter: int = 200,
    tolerance: float = 1e-4,
    seed: int = 42,
    stop_words: tuple[str, ...] | None = None,
) -> tuple[Themes, DataFrame]:
    """Fit themes; returns them with the vectors they were fitted on, a written table."""
    corpus = tfidf.survey_terms(docs, [key], text, stop_words, max_features)
    return _fit(corpus, n_themes, max_iter, tolerance, seed)


def _fit(corpus: tfidf.Corpus, n_themes: int, max_iter: int = 200, tolerance: float = 1e-4, seed: int = 42) -> tuple[Themes, DataFrame]:
    if not 1 <= n_themes <= MAX_THEMES:
        raise ValueError(f"n_themes must be between 1 and {MAX_THEMES}")
    terms = [r.term for r in corpus.vocab.orderBy("idx").collect()]  # at most max_features rows
    if not terms:
        raise ValueError("no term occurs in two texts")
    vecs = written(corpus.vectors)
    k, width = min(n_themes, vecs.count()), len(terms)
    h = _start(vecs, k, width, seed)
    losses: list[float] = []
    for _ in range(max_iter):
        wx, ww, loss = _pass(vecs, h)
        losses.append(loss)
        if len(losses) > 1 and losses[-2] - loss <= tolerance * max(losses[0], 1e-12):
            break
        h = _improve(h, wx, ww)
    return Themes(h, terms, corpus.vocab, losses), vecs


def survey_themes(
    surveys: DataFrame, key: str, n_themes: int = 5, text: str = "free_text", max_features: int = tfidf.MAX_FEATURES,
    stop_words: tuple[str, ...] | None = None, **options,
) -> DataFrame:
    """Theme scores on every response; a response without text scores 0.

    The responses are written once with their counted terms, from which themes are fitted and all responses are weighed
    and scored where they are: nothing is tokenised twice, and nothing is shuffled beside the fit.
    """
    how = tfidf.survey_setting(stop_words)
    none = F.array().cast("array<struct<term:string,tf:int>>")
    counted = written(surveys.withColumn("terms", F.coalesce(tfidf.counted_terms(F.col(text), how), none)))
    spoken = counted.where(tx.not_blank(F.col(text))).select(key, "terms")
    vocab = tfidf.vocabulary(spoken, max_features, 2)
    themes, _ = _fit(tfidf.Corpus(vocab, tfidf.vectors(spoken, vocab, [key])), n_themes, **options)
    return themes.scores(tfidf.vectors(counted, themes.vocab, surveys.columns), surveys.columns)


def theme_summary(scored: DataFrame, employees: DataFrame, n_themes: int = 5) -> DataFrame:
    """Responses, mean theme scores and dominant theme (ties: lower number) per practice.

    Sums are formed per employee before the join, as in ``team_sentiment``.
    """
    names = [f"theme_{i + 1}_score" for i in range(n_themes)]
    if not has(scored, *names):
        raise ValueError(f"scores {names} are not all present")
    per_person = scored.groupBy("employee_id").agg(
        F.count("*").alias("_rows"),
        *[F.sum(c).alias(f"_s_{c}") for c in names],
        *[F.count(c).alias(f"_n_{c}") for c in names],
    )

    def mean(c: str) -> Column:
        return F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}").cast("double")).alias(c)

    teams = (
        per_person.join(employees.select("employee_id", "practice"), "employee_id")
        .where(F.col("practice").isNotNull())
        .groupBy(F.col("practice").alias("team"))
        .agg(F.sum("_rows").alias("response_count"), *[mean(c) for c in names])
    )
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("v"), F.lit(-i).alias("i")) for i, c in enumerate(names)]))
    return teams.withColumn("_best", best).select(
        "team",
        "response_count",
        F.concat(F.lit("Topic "), (1 - F.col("_best.i")).cast("string")).alias("dominant_theme"),
        F.col("_best.v").alias("dominant_theme_score"),
        *names,
    )
