"""The reference workflows as jobs over a folder of tables.

``home`` holds one parquet folder per table, as written by ``sources.ingest.ingest``.  Each job
writes its result before the next one reads it, so nothing is computed twice and a failed job can
be run again by itself.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewmetrics.operators import batch_risk, career, explain, features, model, next_steps, retrieval, risk
from crewmetrics.sources import artifacts, files, snapshots

FEATURES, TEAM_RISK = "derived_employee_features", "derived_team_risk"


def _table(spark: SparkSession, home: str, name: str) -> DataFrame | None:
    path = f"{home}/{name}"
    return files.read_parquet(spark, path) if files.exists(spark, path) else None


def _needed(spark: SparkSession, home: str, name: str) -> DataFrame:
    df = _table(spark, home, name)
    if df is None:
        raise FileNotFoundError(f"table {name} is missing in {home}")
    return df


def build_features(spark: SparkSession, home: str, as_of: date, **options) -> tuple[DataFrame, DataFrame]:
    """Write the feature table and the team risk table; returns both as read back."""
    made = features.employee_features(
        _needed(spark, home, "employees"), _needed(spark, home, "skills"), as_of=as_of,
        surveys=_table(spark, home, "surveys"), timesheets=_table(spark, home, "timesheets"),
        history=_table(spark, home, "role_history"), **options,
    )
    files.write_parquet(made, f"{home}/{FEATURES}")
    built = _needed(spark, home, FEATURES)
    files.write_parquet(risk.team_risk(built), f"{home}/{TEAM_RISK}")
    return built, _needed(spark, home, TEAM_RISK)


def export_team_risk(spark: SparkSession, home: str, path: str) -> None:
    files.write_csv(_needed(spark, home, TEAM_RISK), path)


def train_model(spark: SparkSession, home: str, kind: str = model.LINEAR, **options) -> model.AttritionModel:
    """Train on the feature table and save the model beside it."""
    trained = model.train(_needed(spark, home, FEATURES), kind, **options)
    artifacts.save_model(trained, f"{home}/models/{trained.kind}")
    return trained


def predict_attrition(
    spark: SparkSession, home: str, kind: str = model.LINEAR, ids: DataFrame | list | None = None
) -> DataFrame:
    """Scores from the saved model; raises if none was trained."""
    return model.predict(artifacts.load_model(f"{home}/models/{kind}"), _needed(spark, home, FEATURES), ids)


def explain_attrition(
    spark: SparkSession, home: str, kind: str = model.LINEAR, ids: DataFrame | list | None = None, method: str = "auto"
) -> DataFrame:
    return explain.explain_model(artifacts.load_model(f"{home}/models/{kind}"), _needed(spark, home, FEATURES), ids, method)


def index_folder(
    spark: SparkSession, folder: str, home: str, pattern: str = "*.txt", extract=None, **options
) -> retrieval.Index | None:
    """Index the documents of a folder; None if it holds none with text."""
    docs = files.read_documents(spark, folder, pattern, extract)
    return None if docs.isEmpty() else artifacts.build_and_save(docs, f"{home}/index", **options)


def question_prompts(
    spark: SparkSession, home: str, questions: DataFrame, k: int = retrieval.TOP_K, company: str = "the company"
) -> DataFrame:
    """Prompts for a batch of questions from the saved index."""
    index = artifacts.load_index(spark, f"{home}/index")
    return retrieval.prompts(questions, retrieval.contexts(retrieval.retrieve(questions, index, k), index.chunks), company)


def career_plans(spark: SparkSession, home: str, path: str, **options) -> DataFrame:
    """Write every employee's plan as JSON, one row each."""
    plans = career.career_plans(
        _needed(spark, home, "employees"), _needed(spark, home, "skills"), _table(spark, home, "ld_catalog"), **options
    )
    files.write_json(plans, path)
    return spark.read.json(path)


def batch(
    employees: DataFrame,
    surveys: DataFrame,
    timesheets: DataFrame,
    skills: DataFrame,
    out: str,
    *,
    as_of: date,
    created_at: Column | None = None,
    replies: DataFrame | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Team risk as CSV, next steps as JSON, saved rows upserted and their newest state as CSV.

    Returns the team table and the saved rows.
    """
    spark = employees.sparkSession
    people = batch_risk.person_risk(employees, surveys, timesheets, as_of=as_of, **options)
    files.write_parquet(people, f"{out}/person_risk")
    people = files.read_parquet(spark, f"{out}/person_risk")
    teams = batch_risk.team_risk(people)
    files.write_csv(teams, f"{out}/team_risk_csv")
    files.write_parquet(next_steps.next_steps(people, skills, replies), f"{out}/records")
    records = files.read_parquet(spark, f"{out}/records")
    files.write_json(records, f"{out}/next_steps_json")
    rows = next_steps.saved_rows(records, F.current_timestamp() if created_at is None else created_at)
    saved = snapshots.upsert_buckets(rows, f"{out}/next_steps")
    newest = next_steps.latest_per_key(saved, "employee_id", [F.col("created_at").desc()])
    files.write_csv(newest.drop("recommendations_json"), f"{out}/saved_rows_csv")
    return teams, saved
