"""Declared table schemas and the check that a frame has the columns an operator needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
}


def table(columns: str) -> T.StructType:
    """A schema from ``name type`` pairs; usable before a session exists."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


EMPLOYEES = table(
    "employee_id string, role string, practice string, tenure_weeks int, "
    "manager_id string, seniority string, left_company int"
)
SURVEYS = table("employee_id string, month string, free_text string, rating double")
TIMESHEETS = table("employee_id string, week string, hours double")
SKILLS = table("employee_id string, skill string, level double")
LD_CATALOG = table("course_id string, title string, skill string, provider string")
ROLE_HISTORY = table("employee_id string, changed_at timestamp, role string")
POLICIES = table("doc_id bigint, source string, title string, text string")
ANSWERS = table("query_id bigint, answer string")
NEXT_STEPS = table(
    "employee_id string, attrition_risk double, top_drivers string, recommendations_json string, "
    "owner string, suggested_check_in_weeks int, practice string, tenure_weeks double, "
    "avg_hours_last_12w double, pto_rate_last_12w double, avg_rating_last_3m double, "
    "workload_ratio double, created_at timestamp_ntz"
)

TABLES = {
    "employees": EMPLOYEES,
    "surveys": SURVEYS,
    "timesheets": TIMESHEETS,
    "skills": SKILLS,
    "ld_catalog": LD_CATALOG,
}


# columns a file may leave out: the operators have a rule for each of them
OPTIONAL = {
    "employees": {"tenure_weeks", "manager_id", "seniority", "left_company"},
    "surveys": {"free_text", "rating"},
}


def has(df: DataFrame, *names: str) -> bool:
    return all(name in df.columns for name in names)


def require(df: DataFrame, *names: str) -> DataFrame:
    """Fail while the plan is built, not in the middle of a job."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; present: {df.columns}")
    return df


def validate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` first, cast to its types; further columns are kept behind them."""
    require(df, *schema.fieldNames())
    extra = [name for name in df.columns if name not in schema.fieldNames()]
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema], *extra)
