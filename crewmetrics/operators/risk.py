"""Risk by team, drill-downs and thresholds over the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewmetrics.functions.ranking import top_names
from crewmetrics.operators.features import risk_score
from crewmetrics.schemas import has

TEAM_MEANS = {
    "avg_risk": "risk_score",
    "avg_skill_gap": "skill_gap_score",
    "avg_sentiment": "survey_sentiment",
    "avg_workload_ratio": "workload_ratio",
    "avg_pto_spike": "pto_spike_rate",
    "avg_manager_1on1": "manager_1on1_cadence",
}


def _with_risk(features: DataFrame) -> DataFrame:
    return features if has(features, "risk_score") else risk_score(features)


def _means(df: DataFrame) -> list[Column]:
    return [
        (F.avg(source) if has(df, source) else F.lit(None).cast("double")).alias(name)
        for name, source in TEAM_MEANS.items()
    ]


def top_drivers(df: DataFrame, n: int = 3) -> DataFrame:
    """``top_driver_1..n`` from the team means; of equal values the later driver comes first."""
    drivers = {
        "skill_gap": F.col("avg_skill_gap"),
        "sentiment": 1.0 - F.col("avg_sentiment"),
        "workload_ratio": F.greatest(F.lit(0.0), F.col("avg_workload_ratio") - 1.0),
        "pto_spike": F.col("avg_pto_spike"),
        "manager_1on1": 1.0 - F.col("avg_manager_1on1"),
    }
    ranked = df.withColumn("_top", top_names(drivers, n, ties="last"))
    return ranked.withColumns({f"top_driver_{i + 1}": F.get("_top", F.lit(i)) for i in range(n)}).drop("_top")


def team_risk(features: DataFrame, team: str = "practice") -> DataFrame:
    """Mean risk and drivers per team; people without a team are left out."""
    scored = _with_risk(features)
    means = (
        scored.where(F.col(team).isNotNull()).groupBy(F.col(team).alias("team")).agg(*_means(scored))
    )
    return top_drivers(means)


def risk_drilldown(features: DataFrame, levels: tuple[str, ...] = ("practice", "role")) -> DataFrame:
    """Heat map of the organisation: one row per rollup level; ``level`` counts the levels given.

    Append ``"employee_id"`` to drill down to persons.
    """
    scored = _with_risk(features)
    full = 2 ** len(levels) - 1
    depth = F.lit(0)
    for i in range(1, len(levels) + 1):
        depth = F.when(F.col("_grouping") == full >> i, i).otherwise(depth)
    return (
        scored.rollup(*levels)
        .agg(F.grouping_id().alias("_grouping"), F.count("*").alias("people"), *_means(scored))
        .withColumn("level", depth)
        .drop("_grouping")
    )


def top_teams(teams: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` teams with the highest mean risk."""
    return teams.orderBy(F.col("avg_risk").desc(), F.col("team")).limit(n)


def drivers_of(teams: DataFrame, team: str) -> DataFrame:
    """Top drivers of one team, one row per rank."""
    rows = F.array(
        *[F.struct(F.lit(i).alias("rank"), F.col(f"top_driver_{i}").alias("driver")) for i in (1, 2, 3)]
    )
    return teams.where(F.col("team") == team).select("team", F.inline(rows))


def decide(scores: DataFrame, risk: str = "attrition_risk", threshold: float = 0.3) -> DataFrame:
    """Flag people whose risk reaches the decision threshold."""
    return scores.withColumn("at_risk", F.coalesce(F.col(risk) >= threshold, F.lit(False)))
