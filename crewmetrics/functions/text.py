"""Text expressions.  Word characters and white space are Unicode-aware throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crewmetrics.plans.constants import bind

_SPACE = r"(?U)[\s\x1c-\x1f]+"
_NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"
_PUNCTUATION = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]"
_TERM = r"[\p{L}\p{N}_]{2,}"


def words(text: Column) -> Column:
    """White-space separated words; an empty or blank text has none."""
    return F.array_remove(F.split(text, _SPACE), "")


def clean_words(text: Column) -> Column:
    """Lower-case words with punctuation deleted, not replaced: ``work-life`` is ``worklife``."""
    return words(F.regexp_replace(F.lower(text), _PUNCTUATION, ""))


def terms(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def not_blank(text: Column) -> Column:
    return text.isNotNull() & text.rlike(_NOT_SPACE)


def mentions_any(text: Column, keywords: list[str]) -> Column:
    """1 if the lower-cased text contains one of the keywords, else 0; null counts as 0."""
    low = F.lower(text)
    hit = F.lit(False)
    for keyword in keywords:
        hit = hit | low.contains(keyword)
    return F.coalesce(hit.cast("int"), F.lit(0))


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by one space."""
    pairs = F.zip_with(
        tokens,
        F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.filter(pairs, lambda p: p.isNotNull())


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of one text, counted inside the row.

    Sorting the tokens puts equal ones together, so a count is the distance between two run
    starts.  No shuffle by (text, term) is needed.
    """

    def runs(s: Column) -> Column:
        n = F.size(s)
        positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(positions, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return bind(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p).alias("term"),
                    (F.coalesce(F.get(st, j + 1), n) - p).alias("tf"),
                ),
            ),
        )

    return bind(F.sort_array(tokens), runs)


def lexicon_score(text: Column, positive: list[str], negative: list[str]) -> Column:
    """(positive - negative) / words within [-1, 1]; a text without words scores 0."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("s"))

    def add(acc: Column, word: Column) -> Column:
        step = F.when(word.isin(positive), 1).otherwise(0) - F.when(word.isin(negative), 1).otherwise(0)
        return F.struct((acc["n"] + 1).alias("n"), (acc["s"] + step).alias("s"))

    def finish(acc: Column) -> Column:
        # greatest and least skip nulls, so "no words" has to become 0 before the clamp
        share = F.coalesce(F.try_divide(acc["s"].cast("double"), acc["n"].cast("double")), F.lit(0.0))
        return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), share))

    return F.coalesce(F.aggregate(clean_words(text), zero, add, finish), F.lit(0.0))


def chunk_count(text: Column, size: int, overlap: int) -> Column:
    """How many chunks ``chunk_structs`` makes of a text, from its number of words alone."""
    n = F.size(words(text))
    later = F.ceil((n - size) / F.lit(size - overlap))
    return F.when(n <= 0, 0).when(n <= size, 1).otherwise(later + 1).cast("bigint")


def chunk_structs(text: Column, size: int, overlap: int) -> Column:
    """``array<struct<chunk_index, text>>``: windows of ``size`` words that share ``overlap``.

    The last window is the first one that reaches the end of the text.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")
    step = size - overlap

    def cut(ws: Column) -> Column:
        n = F.size(ws)
        last = F.when(n <= size, 0).otherwise((F.ceil((n - size) / F.lit(step)) * step).cast("int"))
        starts = F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            starts,
            lambda at, i: F.struct(
                i.alias("chunk_index"), F.array_join(F.slice(ws, at + 1, size), " ").alias("text")
            ),
        )

    return bind(words(text), cut)
