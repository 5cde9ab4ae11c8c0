import pytest
from pyspark.sql import functions as F

from crewmetrics import reference as ref
from crewmetrics.operators import career
from crewmetrics.plans import sizes

GOLDEN = {
    "E_1001": ("Senior Data Engineer", 0.866667, "C401 C501 C1001 C901", "E_1503", "Data Visualization Dashboard"),
    "E_1002": ("Senior ML Engineer", 1.0, "C401 C601 C501 C101*", "E_1607", "ML Model Deployment"),
    "E_1042": ("Senior Data Engineer", 0.866667, "C401 C501 C1001 C201", "E_1503", "Data Visualization Dashboard"),
    "E_1111": ("Data Engineer", 0.894737, "C401 C1001 C201 C101", "E_1042", "Data Migration Project"),
    "E_1205": ("Senior Data Engineer", 0.8, "C1001 C201 C101 C901", "E_1503", "Data Migration Project"),
    "E_1308": ("Senior ML Engineer", 0.882353, "C601 C501 C401 C101*", "E_1607", "Data Migration Project"),
    "E_1402": ("Senior Analyst", 0.807692, "C401 C501 C701 C101*", "E_1042", "ML Model Deployment"),
    "E_1503": ("Senior Data Engineer", 0.666667, "C1001 C201 C101 C901", None, "Data Migration Project"),
    "E_1607": ("Senior ML Engineer", 0.735294, "C601 C501 C101* C201*", None, "Customer Analytics Project"),
    "E_1704": ("Senior Analyst", 0.769231, "C701 C401 C501 C101*", "E_1042", "Data Visualization Dashboard"),
}


@pytest.mark.parametrize("small", [1000, 0])
def test_plan_goldens(sample, small, monkeypatch):
    monkeypatch.setattr(sizes, "SMALL_ROWS", small)
    plans = career.career_plans(sample["employees"], sample["skills"], sample["ld_catalog"]).collect()
    assert len(plans) == 10
    for p in plans:
        target, gap, courses, mentor, project = GOLDEN[p.employee_id]
        assert p.target_role == target and p.skill_gap_score == pytest.approx(gap, abs=1e-6)
        listed = [c.course_id + ("*" if c.reason.startswith("General") else "") for c in p.recommended_courses]
        assert " ".join(listed) == courses, p.employee_id
        assert p.recommended_mentor.mentor_id == mentor
        assert p.recommended_project_rotation.title == project
    none = [p for p in plans if p.employee_id == "E_1503"][0].recommended_mentor
    assert none.mentor_name is None and none.reason == "No suitable mentors found"


def test_manager_and_unknown_role(spark):
    people = spark.createDataFrame(
        [("m", "Manager", None, "Manager", 0), ("u", "Pilot", "X", None, 1), ("n", None, "X", "Lead", 2)],
        "employee_id string, role string, practice string, seniority string, ordinal long",
    )
    skills = spark.createDataFrame(
        [("m", s, float(n), i) for i, (s, n) in enumerate(ref.CAREER_REQUIREMENTS["Manager"].items())],
        "employee_id string, skill string, level double, ordinal long",
    )
    plans = {p.employee_id: p for p in career.career_plans(people, skills).collect()}
    assert plans["m"].target_role == "Manager" and plans["m"].skill_gap_score == 0
    assert [c.course_id for c in plans["m"].recommended_courses] == ["C101", "C102", "C103", "C104"]
    assert plans["m"].recommended_project_rotation.reason == "General skill development"
    assert plans["u"].target_role == "Pilot" and plans["u"].skill_gap_score == 1 and plans["u"].skill_gaps == {}
    assert plans["u"].recommended_mentor.mentor_id == "n"
    assert plans["n"].target_role is None and plans["n"].recommended_mentor.mentor_id == "m"


def test_last_skill_row_wins(spark):
    skills = spark.createDataFrame(
        [("a", "SQL", 4.0, 1), ("a", "SQL", 2.0, 7), ("a", "dbt", 1.0, 3)],
        "employee_id string, skill string, level double, ordinal long",
    )
    assert career.employee_skills(skills).first().skills == {"SQL": 2.0, "dbt": 1.0}
    goals = spark.createDataFrame([("a", "Data Engineer"), ("b", "Analyst"), ("a", "x")], "employee_id string, target_role string")
    got = {(r.employee_id, r.target_role): r for r in career.skill_gaps(goals, skills).collect()}
    assert got[("a", "Data Engineer")].skill_gaps["SQL"] == 1.0 and got[("a", "Data Engineer")].skill_gaps["dbt"] == 1.0
    assert got[("b", "Analyst")].skill_gap_score == 1.0 and got[("a", "x")].skill_gap_score == 1.0


def test_fewer_catalog_rows_than_limit(spark, sample):
    short = sample["ld_catalog"].where("course_id = 'C301'")
    plan = career.career_plans(sample["employees"], sample["skills"], short).first()
    assert [c.course_id for c in plan.recommended_courses] == ["C301"]


def test_demand(sample):
    rows = career.skill_demand(sample["employees"], sample["skills"]).where(F.col("role") == "Data Engineer")
    top = rows.orderBy("demand_rank").collect()
    assert [r.demand_rank for r in top] == [1, 2, 3, 4, 5] and top[0].people == 4
    assert top[0].total_gap >= top[1].total_gap
