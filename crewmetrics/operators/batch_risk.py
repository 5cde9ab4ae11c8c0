"""The batch job's risk model: recent weeks and months, logistic person risk, team roll-up."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewmetrics import reference as ref
from crewmetrics.functions.dates import recent_months, recent_weeks
from crewmetrics.functions.ranking import top_names
from crewmetrics.schemas import has


def _gauss(x: Column, centre: float, width: float) -> Column:
    return F.exp(-F.pow(x - centre, F.lit(2.0)) / (2.0 * width * width))


def person_risk(
    employees: DataFrame,
    surveys: DataFrame,
    timesheets: DataFrame,
    *,
    as_of: date,
    leave_hours: float = 0.1,
    weights: dict[str, float] = ref.BATCH_WEIGHTS,
    defaults: dict[str, float] = ref.BATCH_DEFAULTS,
) -> DataFrame:
    """Risk and top-3 drivers of every employee from the last 12 weeks and 3 months before ``as_of``.

    The period filters are ``IN`` lists of at most 12 literals and reach the parquet scan.
    """
    people = employees if has(employees, "employee_id") else employees.withColumnRenamed("id", "employee_id")
    weeks, months = recent_weeks(as_of), recent_months(as_of)
    hours = (
        timesheets.where(F.col("week").isin(weeks) & F.col("employee_id").isNotNull())
        .groupBy("employee_id")
        .agg(
            F.avg("hours").alias("avg_hours_wk"),
            F.avg(F.coalesce((F.col("hours") <= leave_hours).cast("int"), F.lit(0))).alias("pto_rate"),
        )
    )
    ratings = (
        surveys.where(F.col("month").isin(months) & F.col("employee_id").isNotNull())
        .groupBy("employee_id")
        .agg(F.avg("rating").alias("avg_rating"))
    )
    joined = (
        people.select("employee_id", "practice", "tenure_weeks")
        .join(hours, "employee_id", "left")
        .join(ratings, "employee_id", "left")
        .fillna(defaults)
    )
    tenure = F.col("tenure_weeks").cast("double")
    bump = sum((height * _gauss(tenure, centre, width) for height, centre, width in ref.TENURE_BUMPS), F.lit(0.0))
    measured = joined.withColumns(
        {
            "workload_ratio": F.col("avg_hours_wk") / 40.0,
            "sentiment_m1p1": (F.col("avg_rating") / 5.0) * 2.0 - 1.0,
            "tenure_bump": bump,
        }
    )
    logit = (
        weights["workload"] * (F.greatest(F.col("workload_ratio"), F.lit(1.0)) - 1.0)
        - weights["sentiment"] * F.col("sentiment_m1p1")
        + weights["pto"] * F.col("pto_rate")
        + weights["tenure"] * F.col("tenure_bump")
        - weights["bias"]
    )
    scored = measured.withColumn("risk", 1.0 / (1.0 + F.exp(-logit)))
    zero, rating = F.lit(0.0), F.col("avg_rating")
    drivers = {
        "workload_ratio": weights["workload"] * F.greatest(zero, F.col("workload_ratio") - 1.0),
        "low_sentiment": weights["sentiment"] * F.greatest(zero, -F.col("sentiment_m1p1")),
        "pto_spike": weights["pto"] * F.col("pto_rate"),
        "tenure_transition": weights["tenure"] * F.col("tenure_bump"),
        "low_1on1": F.when((rating <= 3.0) & (F.col("workload_ratio") >= 1.05), 0.6).otherwise(0.0),
        "low_recognition": F.when(rating <= 3.2, 0.4).otherwise(0.0),
        "low_growth": F.when((rating <= 3.2) & (F.col("tenure_weeks") > 80), 0.5).otherwise(0.0),
    }
    top = scored.withColumn("_top", top_names(drivers, 3, ties="first"))
    return top.withColumns({f"top_driver_{i + 1}": F.get("_top", F.lit(i)) for i in range(3)}).drop("_top")


def team_risk(people: DataFrame) -> DataFrame:
    """Mean risk (2 digits, half-even) and the most frequent driver at each rank per practice.

    The mode counts driver names, of which there are seven, so its state does not grow; of
    equally frequent names the smallest wins.
    """
    return (
        people.where(F.col("practice").isNotNull())
        .groupBy(F.col("practice").alias("team"))
        .agg(
            (F.rint(F.avg("risk") * 100.0) / 100.0).alias("avg_risk"),
            *[F.mode(f"top_driver_{i}", True).alias(f"top_driver_{i}") for i in (1, 2, 3)],
        )
    )


def batch_job(
    employees: DataFrame, surveys: DataFrame, timesheets: DataFrame, *, as_of: date, **options
) -> tuple[DataFrame, DataFrame]:
    """The whole job: (team table, person table)."""
    people = person_risk(employees, surveys, timesheets, as_of=as_of, **options)
    return team_risk(people), people
