"""Sentiment of texts and of teams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewmetrics import reference as ref
from crewmetrics.functions import text as tx


def lexicon_sentiment(
    df: DataFrame,
    text: str = "free_text",
    positive: list[str] = ref.POSITIVE_WORDS,
    negative: list[str] = ref.NEGATIVE_WORDS,
    name: str = "sentiment_score",
) -> DataFrame:
    """Word-list sentiment; one pass over each text, no shuffle."""
    return df.withColumn(name, tx.lexicon_score(F.col(text), positive, negative))


def weighted_sentiment(df: DataFrame, key: str, text: str, lexicon: DataFrame | dict[str, float]) -> DataFrame:
    """(key, polarity): mean weight of the lexicon words in the text, 0 without any, within [-1, 1].

    A text reaches the join as distinct words with counts.  The lexicon carries no hint: Spark
    broadcasts it if it is measured small and otherwise joins by word, splitting hot words.
    """
    if isinstance(lexicon, dict):
        lexicon = df.sparkSession.createDataFrame(list(lexicon.items()), "word string, weight double")
    counted = df.select(key, F.explode_outer(tx.term_counts(tx.clean_words(F.col(text)))).alias("t"))
    matched = counted.select(key, F.col("t.term").alias("word"), F.col("t.tf").alias("tf")).join(
        lexicon, "word", "left"
    )
    hits = F.when(F.col("weight").isNotNull(), F.col("tf"))
    mean = F.try_divide(F.sum(F.col("weight") * F.col("tf")), F.sum(hits).cast("double"))
    polarity = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce(mean, F.lit(0.0))))
    return matched.groupBy(key).agg(polarity.alias("polarity"))


def team_sentiment(responses: DataFrame, employees: DataFrame, score: str = "survey_sentiment") -> DataFrame:
    """Mean sentiment and number of scored responses per practice.

    Responses are summed per employee before they meet the employees, so one employee's or one
    practice's mass of responses is never moved as rows.
    """
    per_person = responses.groupBy("employee_id").agg(F.sum(score).alias("_s"), F.count(score).alias("_n"))
    return (
        per_person.join(employees.select("employee_id", "practice"), "employee_id")
        .where(F.col("practice").isNotNull())
        .groupBy(F.col("practice").alias("team"))
        .agg(
            F.try_divide(F.sum("_s"), F.sum("_n").cast("double")).alias("avg_sentiment"),
            F.sum("_n").alias("response_count"),
        )
    )
