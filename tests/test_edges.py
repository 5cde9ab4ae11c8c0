"""Empty inputs, ties and other rows at the edge, operator by operator."""

from datetime import date

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crewmetrics import reference as ref
from crewmetrics.functions.ranking import top_names
from crewmetrics.operators import batch_risk, career, features, next_steps, retrieval, risk, sentiment
from verification.oracles import ORACLES
from verification.queries import BY_NAME

AS_OF = date(2025, 5, 10)


def test_empty_tables_give_empty_results(spark, sample):
    none = {name: df.limit(0) for name, df in sample.items()}
    made = features.employee_features(
        none["employees"], none["skills"], surveys=none["surveys"], timesheets=none["timesheets"], as_of=AS_OF
    )
    assert made.isEmpty() and risk.team_risk(made).isEmpty() and risk.top_teams(risk.team_risk(made)).isEmpty()
    teams, people = batch_risk.batch_job(none["employees"], none["surveys"], none["timesheets"], as_of=AS_OF)
    assert teams.isEmpty() and people.isEmpty() and next_steps.next_steps(people, none["skills"]).isEmpty()
    assert career.career_plans(none["employees"], none["skills"], none["ld_catalog"]).isEmpty()
    assert features.pto_spike(none["timesheets"]).isEmpty() and features.monthly_sentiment(none["surveys"]).isEmpty()
    scored = features.survey_sentiment(none["surveys"])
    assert sentiment.team_sentiment(scored, sample["employees"]).isEmpty()
    docs = spark.createDataFrame([], "doc_id long, source string, title string, text string")
    assert retrieval.chunks(docs).isEmpty() and retrieval.with_chunk_ids(docs).isEmpty()


def test_side_tables_without_rows_for_anyone(sample):
    made = features.employee_features(
        sample["employees"], sample["skills"].limit(0), surveys=sample["surveys"].limit(0),
        timesheets=sample["timesheets"].limit(0), as_of=AS_OF,
    )
    rows = features.risk_score(made).collect()
    assert len(rows) == 10 and {r.skill_gap_score for r in rows} == {1.0}
    assert {round(r.risk_score, 6) for r in rows} == {0.5, 0.6}


def test_catalog_without_rows(sample):
    plan = career.career_plans(sample["employees"], sample["skills"], sample["ld_catalog"].limit(0)).first()
    assert plan.recommended_courses == []


def test_all_practices_unknown(sample):
    people = sample["employees"].withColumn("practice", F.lit(None).cast("string"))
    made = features.employee_features(people, sample["skills"], as_of=AS_OF)
    assert made.count() == 10 and risk.team_risk(made).isEmpty()
    mentors = career.recommend_mentors(people).collect()
    assert {m.recommended_mentor.mentor_id for m in mentors if m.seniority == "Junior"} == {"E_1001"}


def test_surveys_without_rating_or_text(spark):
    df = spark.createDataFrame([("a", "good")], "employee_id string, free_text string")
    assert features.survey_sentiment(df).first().survey_sentiment == 1.0
    only_rating = spark.createDataFrame([("a", 5.0), ("b", 1.0)], "employee_id string, rating double")
    assert [r.survey_sentiment for r in features.survey_sentiment(only_rating).orderBy("employee_id").collect()] == [0.5, -0.5]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.1, 0.1 + 1e-13, 0.5, 1.0]), min_size=5, max_size=5))
def test_rank_ties(spark, values):
    columns = {f"d{i}": F.lit(v) for i, v in enumerate(values)}
    row = spark.range(1).select(
        top_names(columns, 3, "last").alias("last"), top_names(columns, 3, "first").alias("first")
    ).first()
    rounded = [round(v, 9) for v in values]
    later_first = np.argsort(rounded, kind="stable")[::-1][:3]
    earlier_first = sorted(range(5), key=lambda i: -rounded[i])[:3]
    assert row.last == [f"d{i}" for i in later_first] and row.first == [f"d{i}" for i in earlier_first]


def test_mode_ties_take_the_smallest_name(spark):
    rows = [("P", 0.1, d, "x", "y") for d in ("b", "a", "b", "a")] + [(None, 0.9, "z", "z", "z")]
    people = spark.createDataFrame(rows, "practice string, risk double, top_driver_1 string, top_driver_2 string, top_driver_3 string")
    assert [tuple(r) for r in batch_risk.team_risk(people).collect()] == [("P", 0.1, "a", "x", "y")]


def test_registered_names():
    assert set(ORACLES) <= set(BY_NAME)
    without_sql = set(BY_NAME) - set(ORACLES)
    assert without_sql == {
        "themes_nmf", "theme_terms", "attrition_scores", "boosted_scores", "linear_importance", "permutation_importance",
    }
    assert all(set(path) <= set(ref.CAREER_REQUIREMENTS) for path in ref.CAREER_PATHS.values())
