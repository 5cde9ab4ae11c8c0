from datetime import date

import pytest
from pyspark.sql import functions as F

from crewmetrics.operators import batch_risk, features, risk
from crewmetrics.plans import prefix

GAPS = {
    "E_1001": (0.666667, 1.275, 0, 0.0, 0, 0.488333),
    "E_1002": (0.2, 0, 0, 0, 0, 0.34),
    "E_1042": (0.75, 1.0875, 0, 0.0, 0, 0.4675),
    "E_1111": (0.833333, 1.475, 0, -0.25, 1, 0.611667),
    "E_1205": (0.5, 1.0, 0, 0.666667, 0, 0.266667),
    "E_1308": (0.733333, 1.2, 0, 0.35, 0, 0.516667),
    "E_1402": (0.583333, 1.05, 0, 0.0, 0, 0.426667),
    "E_1503": (0.333333, 0.95, 0, 0.416667, 0, 0.283333),
    "E_1607": (0.4, 1.375, 0, 0.0, 1, 0.355),
    "E_1704": (0.5, 1.025, 0, 0.5, 1, 0.205),
}


def build(sample, compat):
    return features.risk_score(
        features.employee_features(
            sample["employees"], sample["skills"], surveys=sample["surveys"], timesheets=sample["timesheets"],
            as_of=date(2025, 5, 10), compat=compat,
        )
    )


def test_feature_goldens(sample):
    for row in build(sample, True).collect():
        got = (row.skill_gap_score, row.workload_ratio, row.pto_spike_rate, row.survey_sentiment,
               row.manager_1on1_cadence, row.risk_score)
        assert got == pytest.approx(GAPS[row.employee_id], abs=1e-6), row.employee_id


def test_strict_gap(sample):
    row = build(sample, False).where("employee_id = 'E_1002'").first()
    assert row.skill_gap_score == 1.0 and row.risk_score == pytest.approx(0.5)


def test_team_goldens(sample):
    teams = {r.team: r for r in risk.team_risk(build(sample, True)).collect()}
    expected = {
        "AI": (0.403889, 0.444444, 0.116667, 0.858333, 0, 0.333333),
        "Cloud": (0.3775, 0.583333, 0.333333, 1.1375, 0, 0),
        "Data": (0.398833, 0.6, 0.133333, 1.1175, 0, 0.4),
    }
    order = {
        "AI": ["sentiment", "manager_1on1", "skill_gap"],
        "Cloud": ["manager_1on1", "sentiment", "skill_gap"],
        "Data": ["sentiment", "manager_1on1", "skill_gap"],
    }
    for team, values in expected.items():
        row = teams[team]
        assert tuple(row[1:7]) == pytest.approx(values, abs=1e-6)
        assert list(row[7:10]) == order[team]
    strict = risk.team_risk(build(sample, False)).where("team = 'AI'").first()
    assert strict.avg_risk == pytest.approx(0.457222, abs=1e-6)
    assert list(strict[7:10]) == ["sentiment", "skill_gap", "manager_1on1"]


BATCH = {
    "E_1001": (0.515620, "low_1on1, low_growth, low_recognition"),
    "E_1002": (0.318928, "pto_spike, tenure_transition, workload_ratio"),
    "E_1042": (0.390848, "low_1on1, low_growth, low_recognition"),
    "E_1111": (0.658636, "low_1on1, workload_ratio, low_recognition"),
    "E_1205": (0.192599, "tenure_transition, workload_ratio, low_sentiment"),
    "E_1308": (0.324300, "workload_ratio, tenure_transition, low_sentiment"),
    "E_1402": (0.433606, "low_1on1, low_growth, low_recognition"),
    "E_1503": (0.265171, "tenure_transition, workload_ratio, low_sentiment"),
    "E_1607": (0.510585, "low_1on1, low_growth, workload_ratio"),
    "E_1704": (0.272478, "workload_ratio, tenure_transition, low_sentiment"),
}


def test_batch_goldens(sample):
    teams, people = batch_risk.batch_job(
        sample["employees"], sample["surveys"], sample["timesheets"], as_of=date(2025, 5, 10)
    )
    for row in people.collect():
        risk_, names = BATCH[row.employee_id]
        assert row.risk == pytest.approx(risk_, abs=1e-6)
        assert ", ".join([row.top_driver_1, row.top_driver_2, row.top_driver_3]) == names
    got = {r.team: (r.avg_risk, r.top_driver_1, r.top_driver_2, r.top_driver_3) for r in teams.collect()}
    assert got == {
        "AI": (0.38, "low_1on1", "tenure_transition", "workload_ratio"),
        "Cloud": (0.35, "low_1on1", "low_growth", "low_recognition"),
        "Data": (0.40, "low_1on1", "low_growth", "low_recognition"),
    }


def test_batch_defaults_outside_window(sample):
    teams, _ = batch_risk.batch_job(
        sample["employees"], sample["surveys"], sample["timesheets"], as_of=date(2025, 8, 22)
    )
    assert {r.team: r.avg_risk for r in teams.collect()} == {"AI": 0.34, "Cloud": 0.36, "Data": 0.34}


def test_absent_side_tables_take_neutral_values(sample):
    made = features.employee_features(sample["employees"], sample["skills"], as_of=date(2025, 5, 10))
    assert "survey_sentiment" not in made.columns
    row = features.risk_score(made).where("employee_id = 'E_1001'").first()
    assert row.risk_score == pytest.approx(0.2 * 2 / 3 + 0.1 + 0.05)
    assert risk.team_risk(made).count() == 3


def test_tenure_from_hire_date(spark):
    rows = [("a", "2024-01-01"), ("b", "2024-01-04"), ("c", "soon"), ("d", None)]
    df = spark.createDataFrame(rows, "employee_id string, hire_date string")
    got = {r.employee_id: r.tenure_weeks for r in features.tenure_weeks(df, date(2024, 1, 25)).collect()}
    assert got == {"a": 3, "b": 3, "c": None, "d": None}
    assert features.tenure_weeks(df.drop("hire_date"), date(2024, 1, 1)).first().tenure_weeks == 0


def test_row_features_edges(spark):
    sheets = spark.createDataFrame(
        [("a", 0.0), ("a", 0.1), ("a", 19.99), ("a", 20.0), ("b", None), (None, 3.0)], "employee_id string, hours double"
    )
    got = {(r.employee_id, r.hours): (r.pto_spike, r.pto_spike_rate) for r in features.pto_spike(sheets).collect()}
    assert got[("a", 19.99)] == (1, 0.75) and got[("a", 20.0)] == (0, 0.75)
    assert got[("b", None)] == (0, 0.0) and got[(None, 3.0)] == (1, None)
    surveys = spark.createDataFrame(
        [("a", "2025-01", None, 1.0), ("a", "2025-01", "Weekly CHECK-IN was good", 5.0), ("b", "2025-01", " ", None)],
        "employee_id string, month string, free_text string, rating double",
    )
    cadence = {r.free_text: r.manager_1on1_cadence for r in features.one_on_one_cadence(surveys).collect()}
    assert cadence == {None: 0.5, "Weekly CHECK-IN was good": 0.5, " ": 0.0}
    monthly = {r.free_text: (r.survey_sentiment, r.avg_monthly_sentiment)
               for r in features.monthly_sentiment(surveys).collect()}
    assert monthly[None][0] == -0.5 and monthly[" "] == (None, None)
    assert monthly[None][1] == pytest.approx((-0.5 + (0.25 + 1) / 2) / 2)


@pytest.mark.parametrize("rows_each", [500_000, 2, 1])
def test_internal_moves_cross_ranges(spark, rows_each, monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_ROWS", rows_each)
    rows = [("a", "2024-01-01", "x"), ("a", "2024-01-09", "y"), ("a", "2024-02-01", "y"), ("a", "2024-04-01", "x"),
            ("b", "2024-01-01", "x"), ("c", "2024-01-01", "x"), ("c", "2024-02-01", "z"),
            ("d", None, "x"), ("d", "2024-01-01", "y"), ("e", "2024-01-01", None), ("e", "2024-01-02", "x"), ("e", "2024-01-03", None), (None, "2024-01-01", "x")]
    df = spark.createDataFrame(rows, "employee_id string, changed_at string, role string")
    for kind in ("timestamp", "string"):
        got = {r.employee_id: r.internal_moves for r in features.internal_moves(df.withColumn("changed_at", F.col("changed_at").cast(kind))).collect()}
        assert got == {"a": 2, "b": 0, "c": 1, "d": 1, "e": 0}


def test_one_day_of_one_employee_is_split(spark, monkeypatch):
    """An employee-day with a third of all rows lies in about a third of the ranges, and gives the moves of a single pass."""
    monkeypatch.setattr(prefix, "RANGE_ROWS", 200)
    hot = spark.range(2000).select(F.lit("hot").alias("employee_id"), F.expr("timestamp'2024-05-01' + make_dt_interval(0, 0, 0, id)").alias("changed_at"), (F.col("id") * 7 % 3).cast("string").alias("role"))
    rest = spark.range(4000).select((F.col("id") % 50).cast("string").alias("employee_id"), F.expr("timestamp'2024-01-01' + make_dt_interval(cast(id % 300 as int), 0, 0, id)").alias("changed_at"), (F.col("id") % 4).cast("string").alias("role"))
    both = hot.unionByName(rest)
    ranged = prefix.by_value(both.withColumn("_t", F.col("changed_at").cast("double")), "_t")
    groups = ranged.groupBy("employee_id", "_range").count()
    assert groups.where("employee_id = 'hot'").count() >= 8 and groups.agg(F.max("count")).first()[0] < 500
    got = {r.employee_id: r.internal_moves for r in features.internal_moves(both).collect()}
    roles = [r.role for r in hot.orderBy("changed_at").collect()]
    assert got["hot"] == sum(x != y for x, y in zip(roles, roles[1:])) and len(got) == 51


def test_skill_levels_both_paths_agree(spark, monkeypatch):
    rows = [("a", "s1", 1.0, 1), ("a", "s1", 3.0, 2), ("a", "zz", 9.0, 3), ("b", "s2", None, 4), ("c", None, 1.0, 5)]
    df = spark.createDataFrame(rows, "employee_id string, skill string, level double, ordinal long")
    for how, expected in (("mean", 2.0), ("last", 3.0)):
        wide = features.skill_levels(df, ["s1", "s2"], how)
        monkeypatch.setattr(features, "_WIDE_LIMIT", 0)
        tall = features.skill_levels(df, ["s1", "s2"], how)
        monkeypatch.undo()
        for frame in (wide, tall):
            got = {r.employee_id: (r.skill_rows, (r.levels or {}).get("s1")) for r in frame.collect()}
            assert got == {"a": (3, expected), "b": (0, None), "c": (0, None)}


def test_skills_wide(spark, sample):
    row = features.skills_wide(sample["skills"], ["SQL", "Python"]).where("employee_id = 'E_1205'").first()
    assert (row.SQL, row.Python) == (3.0, 3.0)


def test_drilldown_top_teams_drivers(sample):
    scored = build(sample, True)
    rows = risk.risk_drilldown(scored).collect()
    assert [r.people for r in rows if r.level == 0] == [10]
    assert sum(r.people for r in rows if r.level == 1) == 10
    assert {(r.practice, r.role) for r in rows if r.level == 2} >= {("Cloud", "Data Engineer")}
    teams = risk.team_risk(scored)
    assert [r.team for r in risk.top_teams(teams, 2).collect()] == ["AI", "Data"]
    assert [(r.rank, r.driver) for r in risk.drivers_of(teams, "Cloud").collect()][0] == (1, "manager_1on1")
    flagged = risk.decide(scored.withColumnRenamed("risk_score", "attrition_risk"))
    assert flagged.where("at_risk").count() == 7
