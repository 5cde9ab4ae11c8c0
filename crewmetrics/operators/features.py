"""Employee features: tenure, workload, leave, sentiment, one-on-ones, moves, skill gaps.

Scale notes
* every side table is reduced by one ``groupBy(employee_id)`` with map-side partial sums, so
  a single employee with a third of all rows reaches the shuffle as one row per map task;
* a rate that has to stand on every row goes back to the rows by ``plans.skew.attach_groups``,
  not by a window that would put one employee's rows into one task.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewmetrics import reference as ref
from crewmetrics.functions import text as tx
from crewmetrics.plans.constants import constant
from crewmetrics.plans.prefix import by_value
from crewmetrics.plans.skew import attach_groups
from crewmetrics.schemas import has, require

BASELINE_HOURS = 40.0
_WIDE_LIMIT = 64


# --------------------------------------------------------------------------- row features


def tenure_weeks(employees: DataFrame, as_of: date) -> DataFrame:
    """Keep ``tenure_weeks`` if present, else weeks since ``hire_date`` (half-even), else 0."""
    if has(employees, "tenure_weeks"):
        return employees
    if not has(employees, "hire_date"):
        return employees.withColumn("tenure_weeks", F.lit(0))
    hired = F.col("hire_date").try_cast("date")
    weeks = F.rint(F.datediff(F.lit(as_of), hired) / F.lit(7.0))
    return employees.withColumn("tenure_weeks", weeks.cast("int"))


def rating_on_unit_scale(rating: Column, low: float = 1.0, high: float = 5.0) -> Column:
    return 2.0 * (rating - low) / (high - low) - 1.0


def sentiment_columns(
    df: DataFrame,
    positive: list[str] = ref.POSITIVE_WORDS,
    negative: list[str] = ref.NEGATIVE_WORDS,
) -> dict[str, Column]:
    """The sentiment columns that the table's own columns allow."""
    score = tx.lexicon_score(F.col("free_text"), positive, negative) if has(df, "free_text") else F.lit(0.0)
    if not has(df, "rating"):
        return {"sentiment_score": score, "survey_sentiment": score}
    rating = rating_on_unit_scale(F.col("rating"))
    return {"sentiment_score": score, "normalized_rating": rating, "survey_sentiment": (score + rating) / 2.0}


def survey_sentiment(surveys: DataFrame, **lexicon) -> DataFrame:
    """Text score averaged with the rating on [-1, 1]; the score alone where no rating column is."""
    return surveys.withColumns(sentiment_columns(surveys, **lexicon))


def monthly_sentiment(surveys: DataFrame, **lexicon) -> DataFrame:
    """Mean sentiment of the employee's month on every response."""
    scores = {} if has(surveys, "survey_sentiment") else sentiment_columns(surveys, **lexicon)
    means = {"avg_monthly_sentiment": F.avg("survey_sentiment")}
    return attach_groups(surveys, ["employee_id", "month"], means, scores)


def workload_ratio(timesheets: DataFrame, baseline: float = BASELINE_HOURS) -> DataFrame:
    return timesheets.withColumn("workload_ratio", F.col("hours") / F.lit(baseline))


def _mention(keywords: list[str]) -> Column:
    return tx.mentions_any(F.col("free_text"), keywords)


def one_on_one_cadence(surveys: DataFrame, keywords: list[str] = ref.MEETING_KEYWORDS) -> DataFrame:
    """Share of the employee's responses that mention a meeting with the manager."""
    mention = {"manager_meeting_mention": _mention(keywords)}
    return attach_groups(surveys, ["employee_id"], {"manager_1on1_cadence": F.avg("manager_meeting_mention")}, mention)


def _short_week(baseline: float, share: float) -> Column:
    return F.coalesce((F.col("hours") < share * baseline).cast("int"), F.lit(0))


def pto_spike(timesheets: DataFrame, baseline: float = BASELINE_HOURS, share: float = 0.5) -> DataFrame:
    """Flag weeks below half the baseline and attach the employee's rate; null hours count as 0."""
    flag = {"pto_spike": _short_week(baseline, share)}
    return attach_groups(timesheets, ["employee_id"], {"pto_spike_rate": F.avg("pto_spike")}, flag)


def internal_moves(history: DataFrame, ts: str = "changed_at", role: str = "role", tie: str | None = None) -> DataFrame:
    """Role changes per employee in a history table, in the order of time, then of ``tie``.

    The summary of a stretch of history (first role, last role, changes inside) can be merged with that of the next.  The
    stretches are ranges of time with about as many rows each (``plans.prefix``), so one employee's history, a single day of
    it included, is split where its rows are; the second window only sees one row per employee and stretch.
    """
    at = F.col(ts).try_cast("timestamp").cast("double")
    rows = history.where(F.col("employee_id").isNotNull()).select(
        "employee_id", at.alias("_t"), F.struct(at.alias("t"), *[F.col(c) for c in (ts, tie) if c]).alias("_at"), F.col(role).alias("_role")
    )
    inside = Window.partitionBy("employee_id", "_range").orderBy("_at")
    counted = by_value(rows, "_t").withColumn("_moved", (F.col("_role") != F.lag("_role").over(inside)).cast("int"))
    stretches = counted.groupBy("employee_id", "_range").agg(
        F.sum(F.coalesce("_moved", F.lit(0))).alias("_inside"),
        F.min_by("_role", "_at").alias("_first"),
        F.max_by("_role", "_at").alias("_last"),
    )
    between = Window.partitionBy("employee_id").orderBy("_range")
    crossed = (F.col("_first") != F.lag("_last").over(between)).cast("int")
    return (
        stretches.withColumn("_cross", F.coalesce(crossed, F.lit(0)))
        .groupBy("employee_id")
        .agg(F.sum(F.col("_inside") + F.col("_cross")).cast("int").alias("internal_moves"))
    )


# --------------------------------------------------------------------------- skills


def skills_wide(skills: DataFrame, vocabulary: list[str], fill: float = 0.0) -> DataFrame:
    """One column per named skill: mean level, ``fill`` where the employee lacks it."""
    return (
        skills.groupBy("employee_id")
        .pivot("skill", vocabulary)
        .agg(F.avg("level"))
        .fillna(fill, subset=vocabulary)
    )


def skill_levels(skills: DataFrame, vocabulary: list[str], how: str = "mean") -> DataFrame:
    """``levels map<skill, level>`` per employee over the skills of a rule table.

    ``how="mean"`` averages duplicate rows, ``how="last"`` keeps the row with the highest
    ``ordinal``.  Up to 64 skills are aggregated side by side in one shuffle; a longer
    vocabulary takes a second one, from (employee, skill) rows to maps no longer than the
    vocabulary.
    """
    known = skills.where(F.col("employee_id").isNotNull())
    if how == "last":
        require(known, "ordinal")

    def reduce_(at: Column | None) -> Column:
        if how == "last":
            ordinal = F.col("ordinal") if at is None else F.when(at, F.col("ordinal"))
            return F.max_by("level", ordinal)
        return F.avg("level" if at is None else F.when(at, F.col("level")))

    if len(vocabulary) <= _WIDE_LIMIT:
        wide = known.groupBy("employee_id").agg(
            F.count(F.when(F.col("skill").isNotNull() & F.col("level").isNotNull(), 1)).alias("skill_rows"),
            *[reduce_(F.col("skill") == s).cast("double").alias(f"_s{i}") for i, s in enumerate(vocabulary)],
        )
        levels = F.map_from_arrays(
            F.array(*[F.lit(s) for s in vocabulary]), F.array(*[F.col(f"_s{i}") for i in range(len(vocabulary))])
        )
        return wide.select("employee_id", "skill_rows", levels.alias("levels"))
    wanted = constant(vocabulary, "array<string>")
    tall = known.groupBy("employee_id", "skill").agg(
        reduce_(None).cast("double").alias("level"), F.count("level").alias("_rows")
    )
    return tall.groupBy("employee_id").agg(
        F.sum(F.when(F.col("skill").isNotNull(), F.col("_rows")).otherwise(0)).alias("skill_rows"),
        F.map_from_entries(
            F.collect_list(F.when(F.array_contains(wanted, F.col("skill")), F.struct("skill", "level")))
        ).alias("levels"),
    )


def _needs(requirements: dict[str, dict[str, float]]) -> Column:
    table = {
        role: [{"skill": s, "need": float(n)} for s, n in needs.items()] for role, needs in requirements.items()
    }
    return constant(table, "map<string,array<struct<skill:string,need:double>>>")


def skill_gap_score(
    employees: DataFrame,
    skills: DataFrame,
    requirements: dict[str, dict[str, float]] = ref.FEATURE_REQUIREMENTS,
    compat: bool = False,
) -> DataFrame:
    """Share of the role's required levels the employee misses; 0 for a role without requirements.

    A skill the employee does not list has level 0.  ``compat=True`` keeps a quirk of the
    original for employees without any skill row: a skill some employee has is then no gap.
    """
    skill_names = ref.vocabulary(requirements)
    levels = skill_levels(skills, skill_names)
    joined = employees.join(levels, "employee_id", "left")
    missing_gap = F.lit(False)
    seen = F.lit(None).cast("array<string>")
    if compat:
        held = skills.where(F.col("level").isNotNull() & F.col("skill").isin(skill_names))
        held = held.join(employees.select("employee_id"), "employee_id", "left_semi")
        # no more names than the requirement table has
        seen = held.agg(F.collect_set("skill").alias("seen")).scalar()
        missing_gap = F.coalesce(F.col("skill_rows"), F.lit(0)) == 0
    joined = joined.withColumns(
        {"_needs": F.try_element_at(_needs(requirements), F.col("role")), "_no_rows": missing_gap, "_seen": seen}
    )

    def gap(need: Column) -> Column:
        level = F.coalesce(F.try_element_at(F.col("levels"), need["skill"]), F.lit(0.0))
        full = F.greatest(F.lit(0.0), need["need"] - level)
        return F.when(F.col("_no_rows") & F.array_contains("_seen", need["skill"]), 0.0).otherwise(full)

    missed = F.aggregate("_needs", F.lit(0.0), lambda a, n: a + gap(n))
    asked = F.aggregate("_needs", F.lit(0.0), lambda a, n: a + n["need"])
    score = F.coalesce(F.try_divide(missed, asked), F.lit(0.0))
    return joined.withColumn("skill_gap_score", score).select(
        *[employees[c] for c in employees.columns], "skill_gap_score"
    )


# --------------------------------------------------------------------------- feature table


def timesheet_means(timesheets: DataFrame, baseline: float = BASELINE_HOURS) -> DataFrame:
    return (
        timesheets.where(F.col("employee_id").isNotNull())
        .groupBy("employee_id")
        .agg(
            F.avg(F.col("hours") / baseline).alias("workload_ratio"),
            F.avg(_short_week(baseline, 0.5)).alias("pto_spike_rate"),
        )
    )


def survey_means(
    surveys: DataFrame,
    positive: list[str] = ref.POSITIVE_WORDS,
    negative: list[str] = ref.NEGATIVE_WORDS,
    keywords: list[str] = ref.MEETING_KEYWORDS,
) -> DataFrame:
    return (
        survey_sentiment(surveys.where(F.col("employee_id").isNotNull()), positive=positive, negative=negative)
        .groupBy("employee_id")
        .agg(
            F.avg("survey_sentiment").alias("survey_sentiment"),
            F.avg(_mention(keywords)).alias("manager_1on1_cadence"),
        )
    )


def employee_features(
    employees: DataFrame,
    skills: DataFrame,
    *,
    as_of: date,
    surveys: DataFrame | None = None,
    timesheets: DataFrame | None = None,
    history: DataFrame | None = None,
    requirements: dict[str, dict[str, float]] = ref.FEATURE_REQUIREMENTS,
    compat: bool = False,
    positive: list[str] = ref.POSITIVE_WORDS,
    negative: list[str] = ref.NEGATIVE_WORDS,
    keywords: list[str] = ref.MEETING_KEYWORDS,
    history_tie: str | None = None,
) -> DataFrame:
    """One row per employee.  A missing side table leaves its columns out; missing values are 0.

    All side tables arrive hash-partitioned by employee_id, so the employees are shuffled once.
    Only numeric features are zero-filled: role and practice stay null where unknown.
    """
    base = tenure_weeks(employees, as_of)
    out = skill_gap_score(base, skills, requirements, compat)
    if history is None:
        out = out.withColumn("internal_moves", F.lit(0))
    else:
        out = out.join(internal_moves(history, tie=history_tie), "employee_id", "left")
    names = ["employee_id", "role", "practice", "tenure_weeks", "internal_moves", "skill_gap_score"]
    if timesheets is not None:
        out = out.join(timesheet_means(timesheets), "employee_id", "left")
        names += ["workload_ratio", "pto_spike_rate"]
    if surveys is not None:
        out = out.join(survey_means(surveys, positive, negative, keywords), "employee_id", "left")
        names += ["survey_sentiment", "manager_1on1_cadence"]
    label = ["left_company"] if has(employees, "left_company") else []
    return out.select(*names, *label).fillna(0, subset=names[3:])


def risk_score(features: DataFrame, weights: dict[str, float] = ref.HEURISTIC_WEIGHTS) -> DataFrame:
    """Heuristic person risk; a feature column that is absent takes a neutral value."""

    def value(name: str, neutral: float) -> Column:
        return F.col(name) if has(features, name) else F.lit(neutral)

    overload = F.least(F.lit(1.0), F.greatest(F.lit(0.0), value("workload_ratio", 1.0) - 1.0))
    risk = (
        weights["skill_gap"] * F.col("skill_gap_score")
        + weights["sentiment"] * (1.0 - value("survey_sentiment", 0.5))
        + weights["workload_ratio"] * overload
        + weights["pto_spike"] * value("pto_spike_rate", 0.0)
        + weights["manager_1on1"] * (1.0 - value("manager_1on1_cadence", 0.5))
        + weights["tenure"] * (F.col("tenure_weeks") < 52).cast("double")
    )
    return features.withColumn("risk_score", risk)
