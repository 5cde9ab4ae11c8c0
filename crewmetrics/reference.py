"""Rule tables of the domain: lexicon, role requirements, career paths, projects, weights.

All of them are small values held by the driver.  Operators turn them into literals of the
plan, so they never need a join and never grow with the data.
"""

from __future__ import annotations

# --------------------------------------------------------------------------- fixed values
# Everything in this file is a fixed value: results depend on these exact words and numbers.

POSITIVE_WORDS = [
    "good", "great", "excellent", "amazing", "wonderful", "fantastic", "awesome",
    "love", "like", "enjoy", "happy", "pleased", "satisfied", "appreciate",
    "helpful", "supportive", "collaborative", "productive", "efficient",
]

NEGATIVE_WORDS = [
    "bad", "terrible", "awful", "horrible", "hate", "dislike", "disappointed",
    "frustrated", "angry", "upset", "sad", "unhappy", "dissatisfied",
    "unhelpful", "unsupportive", "difficult", "stressful", "overwhelmed",
]

MEETING_KEYWORDS = ["manager", "1:1", "1 on 1", "meeting", "check-in", "check in"]

# skills a role asks for when employee features are built
FEATURE_REQUIREMENTS = {
    "Data Engineer": {"Python": 3, "SQL": 3, "dbt": 2, "Airflow": 2, "Snowflake": 2},
    "ML Engineer": {"Python": 4, "TensorFlow": 3, "PyTorch": 3, "Scikit-learn": 3, "SQL": 2},
    "Analyst": {"SQL": 3, "Excel": 3, "Tableau": 2, "Python": 2, "Statistics": 2},
    "Manager": {
        "Leadership": 4, "Communication": 3, "Project Management": 3, "Excel": 2, "SQL": 1,
    },
}

# skills a target role asks for when a career plan is drawn up
CAREER_REQUIREMENTS = {
    "Data Engineer": {
        "Python": 3, "SQL": 3, "dbt": 2, "Airflow": 2, "Snowflake": 2,
        "Data Modeling": 2, "ETL": 3, "Cloud": 2,
    },
    "ML Engineer": {
        "Python": 4, "TensorFlow": 3, "PyTorch": 3, "Scikit-learn": 3, "SQL": 2,
        "Statistics": 3, "Machine Learning": 4, "Deep Learning": 3,
    },
    "Analyst": {
        "SQL": 3, "Excel": 3, "Tableau": 2, "Python": 2, "Statistics": 2,
        "Data Visualization": 2, "Business Acumen": 2,
    },
    "Manager": {
        "Leadership": 4, "Communication": 3, "Project Management": 3, "Excel": 2, "SQL": 1,
        "Team Building": 3, "Strategic Thinking": 3,
    },
    "Senior Data Engineer": {
        "Python": 4, "SQL": 4, "dbt": 3, "Airflow": 3, "Snowflake": 3,
        "Data Modeling": 3, "ETL": 4, "Cloud": 3, "Architecture": 3,
    },
    "Senior ML Engineer": {
        "Python": 4, "TensorFlow": 4, "PyTorch": 4, "Scikit-learn": 4, "SQL": 3,
        "Statistics": 4, "Machine Learning": 4, "Deep Learning": 4, "MLOps": 3,
    },
    "Senior Analyst": {
        "SQL": 4, "Excel": 4, "Tableau": 3, "Python": 3, "Statistics": 3,
        "Data Visualization": 3, "Business Acumen": 3, "Storytelling": 3,
    },
}

CAREER_PATHS = {
    "Data Engineer": ["Senior Data Engineer", "Manager"],
    "ML Engineer": ["Senior ML Engineer", "Manager"],
    "Analyst": ["Senior Analyst", "Data Engineer", "ML Engineer"],
    "Senior Data Engineer": ["Manager"],
    "Senior ML Engineer": ["Manager"],
    "Senior Analyst": ["Manager"],
}

PROJECT_ROTATIONS = [
    {"title": "Data Migration Project", "skills": ["SQL", "ETL", "Cloud"], "duration": "3 months"},
    {"title": "ML Model Deployment", "skills": ["Python", "MLOps", "Cloud"], "duration": "4 months"},
    {"title": "Data Visualization Dashboard", "skills": ["Tableau", "SQL", "Python"], "duration": "2 months"},
    {"title": "Data Quality Initiative", "skills": ["Python", "SQL", "Data Modeling"], "duration": "3 months"},
    {"title": "Customer Analytics Project", "skills": ["SQL", "Statistics", "Business Acumen"], "duration": "3 months"},
]

# used when no learning catalog was ingested: course_id, title, skill, provider
FALLBACK_CATALOG = [
    ("C101", "Python Advanced Programming", "Python", "Internal"),
    ("C102", "SQL for Data Analysis", "SQL", "Internal"),
    ("C103", "Machine Learning Fundamentals", "Machine Learning", "External"),
    ("C104", "Data Visualization with Tableau", "Tableau", "Internal"),
    ("C105", "Leadership Training", "Leadership", "External"),
    ("C106", "Cloud Computing Fundamentals", "Cloud", "External"),
    ("C107", "ETL Best Practices", "ETL", "Internal"),
    ("C108", "Statistical Analysis", "Statistics", "External"),
    ("C109", "Project Management", "Project Management", "External"),
    ("C110", "Communication Skills", "Communication", "Internal"),
]

SENIORITY_RANK = {"Junior": 0, "Mid": 1, "Senior": 2, "Lead": 3, "Manager": 4}

# person risk from features; tenure counts when below 52 weeks
HEURISTIC_WEIGHTS = {
    "skill_gap": 0.2, "sentiment": 0.2, "workload_ratio": 0.2,
    "pto_spike": 0.2, "manager_1on1": 0.1, "tenure": 0.1,
}

# person risk of the batch job
BATCH_WEIGHTS = {"workload": 1.1, "sentiment": 1.2, "pto": 0.8, "tenure": 0.5, "bias": 0.3}
BATCH_DEFAULTS = {"avg_hours_wk": 38.0, "pto_rate": 0.02, "avg_rating": 3.5}
# height, centre and width in weeks of the two tenure bumps
TENURE_BUMPS = [(0.8, 26.0, 10.0), (0.6, 104.0, 15.0)]

NEXT_STEP_RECOMMENDATIONS = [
    "Set bi-weekly 1:1s for 6 weeks with a clear agenda (recognition, growth, load balancing).",
    "Target workload ≤ 40 hrs/week for two sprints; rebalance tickets.",
    "Enroll in focused upskilling: {weak_skills} (4 weeks).",
    "Assign a 4-week cross-team project rotation.",
    "Create a written growth plan with milestones; mid-point review in 3 weeks.",
]

PERSON_PROMPT = """You are an HR analyst AI. Using the employee profile below, propose 4-6 concrete, non-generic next steps to reduce attrition risk and support growth.
Make them specific (cadence, duration, owner).

Employee:
- employee_id: %s
- practice: %s
- tenure_weeks: %s
- avg_hours_last_12w: %s
- pto_rate_last_12w: %s
- avg_rating_last_3m: %s
- workload_ratio: %s
- attrition_risk: %s
- top_drivers: [%s, %s, %s]
- skills: %s

Return JSON with fields:
{
  "employee_id": "...",
  "attrition_risk": <0..1>,
  "recommendations": ["...", "...", "..."],
  "owner": "manager|hr|employee",
  "suggested_check_in_weeks": 6
}"""

CONTEXT_ENTRY = "\nDocument [%d]\nTitle: %s\nSource: %s\nContent: %s\n"

QUESTION_PROMPT = """
You are an HR policy assistant for %s. Answer the user's question based on the provided context.

Context:
%s

Question: %s

Instructions:
1. Answer the question based only on the provided context.
2. If the context doesn't contain the answer, say "I don't have enough information to answer this question."
3. Cite the source documents using [1], [2], etc. notation.
4. Be concise and direct in your answer.

Answer:
"""

NO_ANSWER = "I don't have enough information to answer this question."

# which file feeds which table in one ingest run
INGEST_FILES = {
    "employees.csv": "employees",
    "surveys.csv": "surveys",
    "timesheets.csv": "timesheets",
    "skills.csv": "skills",
    "ld_catalog.csv": "ld_catalog",
}
# ----------------------------------------------------------------------- end of fixed values


def vocabulary(requirements: dict[str, dict[str, float]]) -> list[str]:
    """Distinct skills named by a requirement table, in order of first mention."""
    return list(dict.fromkeys(skill for needs in requirements.values() for skill in needs))
