import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crewmetrics import reference as ref
from crewmetrics.functions import dates, masking
from crewmetrics.functions import text as tx
from crewmetrics.operators import sentiment, tfidf


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(column).collect()]


def test_lexicon_goldens(spark):
    score = tx.lexicon_score(F.col("t"), ref.POSITIVE_WORDS, ref.NEGATIVE_WORDS)
    got = one(spark, score, "Great team collaboration", "", None, "Supportive manager", " \t", "bad BAD bad", "!!!")
    assert got == pytest.approx([1 / 3, 0, 0, 0.5, 0, -1, 0])


def test_clean_words(spark):
    assert one(spark, tx.clean_words(F.col("t")), "work-life, été!", "a b\x1cc") == [["worklife", "été"], ["a", "b", "c"]]


def test_terms_and_counts(spark):
    texts = ["The the cat_1 à é12 x", "", None]
    assert one(spark, tx.terms(F.col("t")), *texts) == [["the", "the", "cat_1", "é12"], [], None]
    counts = one(spark, tx.term_counts(tx.terms(F.col("t"))), *texts)
    assert {r.term: r.tf for r in counts[0]} == {"the": 2, "cat_1": 1, "é12": 1}
    assert not counts[1] and not counts[2]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab cé_-1", max_size=30), min_size=1, max_size=6))
def test_term_counts_match_counter(spark, texts):
    import regex

    got = one(spark, tx.term_counts(tx.terms(F.col("t"))), *texts)
    for text, rows in zip(texts, got):
        assert {r.term: r.tf for r in rows} == dict(Counter(regex.findall(r"[\p{L}\p{N}_]{2,}", text.lower())))


def test_bigrams(spark):
    tokens = F.split("t", " ")
    assert one(spark, tx.bigrams(tokens), "a b c", "a") == [["a b", "b c"], []]


def test_blank_and_mentions(spark):
    assert one(spark, tx.not_blank(F.col("t")), "a", "  \n", "", None) == [True, False, False, False]
    assert one(spark, tx.mentions_any(F.col("t"), ref.MEETING_KEYWORDS), "My MANAGER", "1:1", "x", None) == [1, 1, 0, 0]


@pytest.mark.parametrize("n, count", [(0, 0), (1, 1), (800, 1), (801, 2), (1500, 2), (1501, 3), (2200, 3)])
def test_chunk_counts(spark, n, count):
    words = [f"w{i}" for i in range(n)]
    chunks = one(spark, tx.chunk_structs(F.col("t"), 800, 100), " ".join(words))[0]
    assert len(chunks) == count == one(spark, tx.chunk_count(F.col("t"), 800, 100), " ".join(words))[0]
    rebuilt = [w for i, c in enumerate(chunks) for w in c.text.split()[100 if i else 0:]]
    assert rebuilt == words and [c.chunk_index for c in chunks] == list(range(count))


def test_chunk_arguments():
    with pytest.raises(ValueError):
        tx.chunk_structs(F.lit("a"), 10, 10)


def test_masking(spark):
    df = spark.createDataFrame(
        [("E_1001", "Ann", "a@x", "p", None)], "employee_id string, c_name string, Email string, provider string, id string"
    )
    assert masking.pii_columns(df) == ["employee_id", "c_name", "Email", "id"]
    assert "provider" in masking.pii_columns(df, compat=True)
    row = masking.mask_columns(df, ["employee_id", "c_name", "Email", "id", "absent"], "s").first()
    assert row.employee_id == "H_b214044a81356823" and row.provider == "p" and row.id is None
    assert row.c_name.startswith("masked_H_") and row.Email.endswith("@example.com")


def test_bucket_dates(spark):
    df = spark.createDataFrame([("2024-05-31",), ("no",), (None,)], "d string")
    rows = masking.bucket_dates(df, ["d", "absent"]).collect()
    assert tuple(rows[0])[1:] == (2024, 2, 5) and tuple(rows[1])[1:] == (None, None, None)


def test_calendar(spark):
    from datetime import date

    df = spark.createDataFrame([("2024-12-30", "2025-01-06")], "a string, b string")
    df = df.select(F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    assert [r.week for r in dates.week_buckets(df, F.col("a"), F.col("b")).collect()] == ["2025-W01", "2025-W02"]
    assert [r.month for r in dates.month_buckets(df, F.col("a"), F.col("b")).collect()] == ["2024-12", "2025-01"]
    assert dates.week_buckets(df, F.col("b"), F.col("a")).count() == 0
    assert dates.month_buckets(df, F.col("b"), F.col("a")).count() == 0
    weeks = dates.recent_weeks(date(2025, 5, 10))
    assert weeks[0] == "2025-W08" and weeks[-1] == "2025-W19" and len(weeks) == 12
    assert dates.recent_months(date(2025, 5, 10)) == ["2025-03", "2025-04", "2025-05"]
    assert dates.recent_weeks(date(2024, 1, 9)) == ["2024-W01", "2024-W02"]
    assert dates.recent_months(date(2024, 1, 9)) == ["2024-01"]
    assert dates.recent_weeks(date(2024, 1, 1)) == [] and dates.recent_months(date(2024, 1, 1)) == []


def test_weighted_sentiment(spark):
    df = spark.createDataFrame([(1, "good good bad"), (2, "nothing"), (3, None), (4, "")], "id int, t string")
    for lexicon in ({"good": 1.0, "bad": -0.5},
                    spark.createDataFrame([("good", 1.0), ("bad", -0.5)], "word string, weight double")):
        got = {r.id: r.polarity for r in sentiment.weighted_sentiment(df, "id", "t", lexicon).collect()}
        assert got == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0}


def test_team_sentiment_counts_scored_only(spark):
    responses = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 0.0), ("x", 1.0)], "employee_id string, survey_sentiment double")
    people = spark.createDataFrame([("a", "P"), ("b", "P"), ("c", None)], "employee_id string, practice string")
    assert [tuple(r) for r in sentiment.team_sentiment(responses, people).collect()] == [("P", 0.5, 2)]


def test_tfidf_against_plain_python(spark):
    texts = ["red red blue", "blue green the", "red green green red", "blue", "zz 1 !"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    corpus = tfidf.tfidf(docs, ["id"], "t", tfidf.Terms(("the",), (1, 1)), 3, 2)
    vocab, vecs = corpus.vocab, corpus.vectors
    df = {"red": 2, "blue": 3, "green": 2}
    assert {r.term: r.df for r in vocab.collect()} == df
    got = {}
    for r in tfidf.weights(vecs, vocab, ["id"]).collect():
        got.setdefault(r.id, {})[r.term] = r.weight
    for i, text in enumerate(texts):
        raw = {t: text.split().count(t) * (math.log(6 / (1 + df[t])) + 1) for t in df if t in text.split()}
        length = math.sqrt(sum(v * v for v in raw.values())) or 1
        assert got.get(i, {}) == pytest.approx({t: v / length for t, v in raw.items()})
    assert {r.id: len(r.indices) for r in vecs.collect()}[4] == 0


def test_top_terms_tie_by_name(spark):
    docs = spark.createDataFrame([(1, "bb aa cc"), (2, "bb aa cc")], "id int, t string")
    vocab = tfidf.tfidf(docs, ["id"], "t", max_features=2).vocab
    assert [(r.idx, r.term) for r in vocab.collect()] == [(0, "aa"), (1, "bb")]


def test_texts_are_weighed_in_pieces(spark, monkeypatch):
    """Pieces of a batch give the vectors of the whole batch, texts without a known term between them included."""
    docs = spark.createDataFrame([(i, " ".join(["red", "blue", "green"][: i % 4])) for i in range(23)], "id long, t string").coalesce(1)
    whole, pieces = [], []
    for size, out in ((500, whole), (3, pieces)):
        monkeypatch.setattr(tfidf, "BATCH_TEXTS", size)
        out += sorted(map(tuple, tfidf.tfidf(docs, ["id"], "t").vectors.collect()))
    assert len(whole) == 23 and whole == pieces
