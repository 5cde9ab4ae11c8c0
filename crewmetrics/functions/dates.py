"""Calendar buckets: months ``yyyy-MM`` and ISO weeks ``YYYY-Www``."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iso_week(day: Column) -> Column:
    """ISO year and week; the week's year, so 2024-12-30 is 2025-W01."""
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def month_buckets(df: DataFrame, start: Column, end: Column, name: str = "month") -> DataFrame:
    """One row per calendar month from ``start`` to ``end``; none if ``end`` is earlier."""
    first, last = F.trunc(start, "MM"), F.trunc(end, "MM")
    months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))
    return df.withColumn(name, F.explode(months)).withColumn(name, F.date_format(name, "yyyy-MM"))


def week_buckets(df: DataFrame, start: Column, end: Column, name: str = "week") -> DataFrame:
    """One row per ISO week touched by ``start`` .. ``end``; stepping by Mondays visits each once."""
    monday = F.date_trunc("week", start).cast("date")
    last = end.cast("date")
    weeks = F.when(start.cast("date") <= last, F.sequence(monday, last, F.expr("interval 7 days")))
    return df.withColumn(name, F.explode(weeks)).withColumn(name, iso_week(F.col(name)))


def recent_weeks(as_of: date, count: int = 12, start: date = date(2024, 1, 1)) -> list[str]:
    """The last ``count`` ISO weeks of ``start`` .. the day before ``as_of``, oldest first."""
    end, found = as_of - timedelta(days=1), []
    day = end
    while len(found) < count and (day >= start or day.isocalendar()[:2] == start.isocalendar()[:2]):
        if end < start:
            break
        year, week, _ = day.isocalendar()
        found.append(f"{year:04d}-W{week:02d}")
        day -= timedelta(days=7)
    return found[::-1]


def recent_months(as_of: date, count: int = 3, start: date = date(2024, 1, 1)) -> list[str]:
    """The last ``count`` months of ``start`` .. the day before ``as_of``, oldest first."""
    end = as_of - timedelta(days=1)
    lowest, at = start.year * 12 + start.month - 1, end.year * 12 + end.month - 1
    serials = range(max(lowest, at - count + 1), at + 1)
    return [f"{s // 12:04d}-{s % 12 + 1:02d}" for s in serials]
