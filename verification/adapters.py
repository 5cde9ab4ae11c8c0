"""The given tables as workforce tables, once for Spark and once as SQL.

``customer`` plays the employees, ``events`` the timesheets and skills, ``documents`` the survey
responses and the policy corpus, ``part`` the course catalog, ``orders`` role history and saved
rows, ``conversations`` questions with answers.
"""

from __future__ import annotations


from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewmetrics import reference as ref
from crewmetrics.functions.dates import iso_week
from crewmetrics.sources.files import read_parquet

AS_OF = date(2024, 2, 1)
SALT = "check-salt"
POSITIVE = ["the", "and", "le", "et"]
NEGATIVE = ["of", "in", "de", "la"]
KEYWORDS = ["nt the", "ment de", "ing"]
STOP_WORDS = ("the", "and", "of", "in", "le", "la", "de", "et", "un", "une", "les", "des")
WEIGHTS = {"the": 0.5, "and": 0.25, "of": -0.75, "in": -0.5, "le": 1.0, "de": -1.0, "et": 0.125}
LEAVE_HOURS = 12.0
MONTHS = ["2024-01", "2023-12", "2023-11", "2023-10", "2023-09"]
ROLES = ["Data Engineer", "ML Engineer", "Analyst", "Manager"]
SENIORITY = ["Junior", "Mid", "Senior", "Lead", "Manager"]
EVENT_TYPES = ["view", "click", "purchase", "signup", "error"]

REQUIREMENTS = {
    "Data Engineer": {"view": 4, "click": 3, "purchase": 2, "signup": 2, "error": 1},
    "ML Engineer": {"view": 5, "signup": 4, "error": 3, "refund": 2},
    "Analyst": {"click": 5, "purchase": 4},
    "Manager": {"purchase": 3, "signup": 5, "view": 2},
    "Senior Data Engineer": {"view": 5, "click": 5, "purchase": 4, "signup": 4, "error": 3},
    "Senior ML Engineer": {"view": 5, "signup": 5, "error": 5, "refund": 3},
    "Senior Analyst": {"click": 5, "purchase": 5, "view": 3},
}
PATHS = {
    "Data Engineer": ["Senior Data Engineer", "Manager"],
    "ML Engineer": ["Senior ML Engineer", "Manager"],
    "Analyst": ["Senior Analyst", "Data Engineer", "ML Engineer"],
}
PROJECTS = [
    {"title": "Funnel rebuild", "skills": ["view", "click"], "duration": "3 months"},
    {"title": "Checkout repair", "skills": ["purchase", "error"], "duration": "2 months"},
    {"title": "Growth sprint", "skills": ["signup", "view"], "duration": "4 months"},
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet", spread=name in ("documents", "conversations", "embeddings"))


def _pick(values: list[str], position) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), position.cast("int"))


def employees(spark, folder) -> DataFrame:
    c = table(spark, folder, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.cast("string").alias("employee_id"),
        F.when(k % 11 == 10, "Consultant").otherwise(_pick(ROLES, k % 4)).alias("role"),
        F.when(k % 13 != 12, F.col("c_mktsegment")).alias("practice"),
        (k % 260).cast("int").alias("tenure_weeks"),
        _pick(SENIORITY, k % 5).alias("seniority"),
        (F.col("c_acctbal") < 0).cast("int").alias("left_company"),
        k.alias("ordinal"),
    )


def timesheets(spark, folder) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", iso_week(F.col("ts")).alias("week"))
    return e.groupBy(F.col("user_id").cast("string").alias("employee_id"), "week").agg(
        (F.count("*") * 3.0).alias("hours")
    )


def surveys(spark, folder) -> DataFrame:
    d = table(spark, folder, "documents")
    i = F.col("doc_id")
    block = F.floor(i / 150)
    return d.select(
        i.alias("response_id"),
        (i % 150).cast("string").alias("employee_id"),
        _pick(MONTHS, block % 5).alias("month"),
        F.col("text").alias("free_text"),
        (1.0 + (7 * i + block) % 5).alias("rating"),
    )


def skills(spark, folder) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("employee_id"), F.col("event_type").alias("skill")).agg(
        (1.0 + F.count("*") % 5).alias("level"), F.min("event_id").alias("ordinal")
    )


def catalog(spark, folder) -> DataFrame:
    p = table(spark, folder, "part")
    k = F.col("p_partkey")
    return p.select(
        k.cast("string").alias("course_id"),
        F.col("p_name").alias("title"),
        _pick(EVENT_TYPES, k % 5).alias("skill"),
        F.col("p_brand").alias("provider"),
        k.alias("ordinal"),
    )


def role_history(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("employee_id"),
        F.col("o_orderdate").alias("changed_at"),
        F.col("o_orderpriority").alias("role"),
        "o_orderkey",
    )


def policies(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", "source", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), "text"
    )


def questions(spark, folder) -> DataFrame:
    """User turns; benchmark items are the questions of ``passages``."""
    return table(spark, folder, "conversations").where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question")
    )


def answers(spark, folder) -> DataFrame:
    """Assistant turns, each citing its turn number, as answers to the turn before."""
    reply = F.concat(F.col("text"), F.lit(" ["), F.col("turn").cast("string"), F.lit("]"))
    return table(spark, folder, "conversations").where(F.col("role") == "assistant").select(
        (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("query_id"), reply.alias("answer")
    )


def passages(spark, folder) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def scored_labels(spark, folder) -> DataFrame:
    joined = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    return joined.select(
        "doc_id", "quality", F.col("n_chars").cast("double").alias("score"), (F.col("n_chars") >= 700).cast("int").alias("predicted")
    )


# ------------------------------------------------------------------------------------ SQL


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _rows(rows) -> str:
    def one(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


def clean_words(column: str) -> str:
    return (
        rf"list_filter(regexp_split_to_array(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+'), "
        "lambda w: w <> '')"
    )


def lexicon_score(column: str) -> str:
    ws = clean_words(column)
    return (
        f"coalesce(greatest(-1.0, least(1.0, CASE WHEN len({ws}) = 0 THEN 0.0 ELSE "
        f"(len(list_filter({ws}, lambda w: w IN {_in(POSITIVE)})) - len(list_filter({ws}, lambda w: w IN {_in(NEGATIVE)})))"
        f"::DOUBLE / len({ws}) END)), 0.0)"
    )


CTE = {
    "employees": f"""employees AS (SELECT CAST(c_custkey AS VARCHAR) AS employee_id,
  CASE WHEN c_custkey % 11 = 10 THEN 'Consultant' ELSE {_list(ROLES)}[c_custkey % 4 + 1] END AS role,
  CASE WHEN c_custkey % 13 <> 12 THEN c_mktsegment END AS practice,
  CAST(c_custkey % 260 AS INTEGER) AS tenure_weeks, {_list(SENIORITY)}[c_custkey % 5 + 1] AS seniority,
  CAST(c_custkey % 5 AS INTEGER) AS rnk, CAST(c_acctbal < 0 AS INTEGER) AS left_company, c_custkey AS ordinal FROM customer)""",
    "timesheets": """timesheets AS (SELECT CAST(user_id AS VARCHAR) AS employee_id, strftime(ts, '%G-W%V') AS week,
  3.0 * count(*) AS hours FROM events GROUP BY user_id, strftime(ts, '%G-W%V'))""",
    "surveys": f"""surveys AS (SELECT doc_id AS response_id, CAST(doc_id % 150 AS VARCHAR) AS employee_id,
  {_list(MONTHS)}[(doc_id // 150) % 5 + 1] AS month, text AS free_text,
  CAST(1 + (7 * doc_id + doc_id // 150) % 5 AS DOUBLE) AS rating FROM documents)""",
    "scored": f"""scored AS (SELECT *, {lexicon_score('free_text')} AS sentiment_score,
  ({lexicon_score('free_text')} + (2.0 * (rating - 1) / 4 - 1)) / 2 AS survey_sentiment,
  CAST(coalesce({' OR '.join(f"contains(lower(free_text), '{k}')" for k in KEYWORDS)}, false) AS INTEGER) AS mention FROM surveys)""",
    "skills": """skills AS (SELECT CAST(user_id AS VARCHAR) AS employee_id, event_type AS skill,
  CAST(1 + count(*) % 5 AS DOUBLE) AS level, min(event_id) AS ordinal FROM events GROUP BY user_id, event_type)""",
    "catalog": f"""catalog AS (SELECT CAST(p_partkey AS VARCHAR) AS course_id, p_name AS title,
  {_list(EVENT_TYPES)}[p_partkey % 5 + 1] AS skill, p_brand AS provider, p_partkey AS ordinal FROM part)""",
    "needs": f"""needs AS (SELECT * FROM (VALUES {_rows((r, i, s, float(n)) for r, ns in REQUIREMENTS.items() for i, (s, n) in enumerate(ns.items()))}) t(role, ord, skill, need))""",
    "paths": f"""paths AS (SELECT * FROM (VALUES {_rows((r, i, t) for r, ts in PATHS.items() for i, t in enumerate(ts))}) t(role, ord, target))""",
    "ref_needs": f"""needs AS (SELECT * FROM (VALUES {_rows((r, i, s, float(n)) for r, ns in ref.CAREER_REQUIREMENTS.items() for i, (s, n) in enumerate(ns.items()))}) t(role, ord, skill, need))""",
    "ref_paths": f"""paths AS (SELECT * FROM (VALUES {_rows((r, i, t) for r, ts in ref.CAREER_PATHS.items() for i, t in enumerate(ts))}) t(role, ord, target))""",
    "ref_catalog": f"""catalog AS (SELECT * FROM (VALUES {_rows((*c, i) for i, c in enumerate(ref.FALLBACK_CATALOG))}) t(course_id, title, skill, provider, ordinal))""",
    "projects": f"""projects AS (SELECT * FROM (VALUES {_rows((i, p['title'], p['duration']) for i, p in enumerate(PROJECTS))}) t(ord, title, duration))""",
    "project_skills": f"""project_skills AS (SELECT * FROM (VALUES {_rows((i, s) for i, p in enumerate(PROJECTS) for s in p['skills'])}) t(ord, skill))""",
    "lexicon": f"""lexicon AS (SELECT * FROM (VALUES {_rows(WEIGHTS.items())}) t(word, weight))""",
    "gaps": """gaps AS (SELECT e.employee_id, coalesce(sum(greatest(0, n.need - coalesce(s.level, 0))) / sum(n.need), 0.0) AS skill_gap_score
  FROM employees e LEFT JOIN needs n ON n.role = e.role
  LEFT JOIN skills s ON s.employee_id = e.employee_id AND s.skill = n.skill GROUP BY e.employee_id)""",
    "moves": """moves AS (SELECT employee_id, count(*) FILTER (WHERE role <> prev) AS internal_moves FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS employee_id, o_orderpriority AS role,
    lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) GROUP BY employee_id)""",
    "ts_means": """ts_means AS (SELECT employee_id, avg(hours / 40.0) AS workload_ratio,
  avg(CASE WHEN hours < 20 THEN 1.0 ELSE 0.0 END) AS pto_spike_rate FROM timesheets GROUP BY employee_id)""",
    "sv_means": """sv_means AS (SELECT employee_id, avg(survey_sentiment) AS survey_sentiment,
  avg(mention) AS manager_1on1_cadence FROM scored GROUP BY employee_id)""",
    "features": """features AS (SELECT e.employee_id, e.role, e.practice, e.tenure_weeks,
  CAST(coalesce(m.internal_moves, 0) AS INTEGER) AS internal_moves, g.skill_gap_score,
  coalesce(t.workload_ratio, 0) AS workload_ratio, coalesce(t.pto_spike_rate, 0) AS pto_spike_rate,
  coalesce(v.survey_sentiment, 0) AS survey_sentiment, coalesce(v.manager_1on1_cadence, 0) AS manager_1on1_cadence, e.left_company
  FROM employees e JOIN gaps g USING (employee_id) LEFT JOIN moves m USING (employee_id)
  LEFT JOIN ts_means t USING (employee_id) LEFT JOIN sv_means v USING (employee_id))""",
    "risky": """risky AS (SELECT *, 0.2 * skill_gap_score + 0.2 * (1 - survey_sentiment)
  + 0.2 * least(1.0, greatest(0.0, workload_ratio - 1)) + 0.2 * pto_spike_rate + 0.1 * (1 - manager_1on1_cadence)
  + 0.1 * CAST(tenure_weeks < 52 AS INTEGER) AS risk_score FROM features)""",
    "teams": """teams AS (SELECT *, list_reverse_sort([{'v': round(avg_skill_gap, 9), 'i': 0, 'n': 'skill_gap'},
    {'v': round(1 - avg_sentiment, 9), 'i': 1, 'n': 'sentiment'},
    {'v': round(greatest(0.0, avg_workload_ratio - 1), 9), 'i': 2, 'n': 'workload_ratio'},
    {'v': round(avg_pto_spike, 9), 'i': 3, 'n': 'pto_spike'},
    {'v': round(1 - avg_manager_1on1, 9), 'i': 4, 'n': 'manager_1on1'}]) AS top FROM (
  SELECT practice AS team, avg(risk_score) AS avg_risk, avg(skill_gap_score) AS avg_skill_gap, avg(survey_sentiment) AS avg_sentiment,
    avg(workload_ratio) AS avg_workload_ratio, avg(pto_spike_rate) AS avg_pto_spike, avg(manager_1on1_cadence) AS avg_manager_1on1
  FROM risky WHERE practice IS NOT NULL GROUP BY practice))""",
    "chunked": """chunked AS (SELECT doc_id, CAST(i // 700 AS INTEGER) AS chunk_index, array_to_string(ws[i + 1 : i + 800], ' ') AS text, source, title
  FROM (SELECT doc_id, source, 'doc-' || doc_id AS title, ws,
      unnest(generate_series(0, CASE WHEN len(ws) <= 800 THEN 0 ELSE CAST(ceil((len(ws) - 800) / 700.0) AS BIGINT) * 700 END, 700)) AS i
    FROM (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents)
    WHERE len(ws) > 0))""",
    "questions": """questions AS (SELECT conv_id * 1000 + turn AS query_id, text AS question FROM conversations WHERE role = 'user')""",
    "answers": """answers AS (SELECT conv_id * 1000 + turn - 1 AS query_id, text || ' [' || turn || ']' AS answer FROM conversations WHERE role = 'assistant')""",
    "passages": """questions AS (SELECT item_id AS query_id, text AS question FROM benchmark)""",
    "hits": r"""terms AS (SELECT doc_id, chunk_index, term, count(*) AS tf FROM (SELECT doc_id, chunk_index,
    unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM chunked) GROUP BY ALL),
  vocab AS (SELECT term, ln((1.0 + (SELECT count(*) FROM chunked)) / (1.0 + df)) + 1 AS idf FROM (
    SELECT term, count(*) AS df, sum(tf) AS total FROM terms GROUP BY term ORDER BY total DESC, term LIMIT 1000)),
  cw AS (SELECT doc_id, chunk_index, term, tf * idf AS w FROM terms JOIN vocab USING (term)),
  cn AS (SELECT doc_id, chunk_index, sqrt(sum(w * w)) AS n FROM cw GROUP BY ALL),
  qw AS (SELECT query_id, term, count(*) * any_value(idf) AS w FROM (SELECT query_id,
    unnest(regexp_extract_all(lower(question), '[\p{L}\p{N}_]{2,}')) AS term FROM questions) JOIN vocab USING (term) GROUP BY ALL),
  qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY ALL),
  dots AS (SELECT query_id, doc_id, chunk_index, sum(qw.w * cw.w) AS d FROM qw JOIN cw USING (term) GROUP BY ALL),
  sims AS (SELECT q.query_id, c.doc_id, c.chunk_index, round(coalesce(d.d / (qn.n * cn.n), 0.0), 9) AS score
    FROM questions q CROSS JOIN chunked c LEFT JOIN dots d ON d.query_id = q.query_id AND d.doc_id = c.doc_id AND d.chunk_index = c.chunk_index
    LEFT JOIN qn ON qn.query_id = q.query_id LEFT JOIN cn ON cn.doc_id = c.doc_id AND cn.chunk_index = c.chunk_index),
  hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) AS rank FROM sims) WHERE rank <= 4)""",
    "contexts": """contexts AS (SELECT query_id, string_agg(chr(10) || 'Document [' || rank || ']' || chr(10) || 'Title: ' || title || chr(10)
    || 'Source: ' || source || chr(10) || 'Content: ' || text || chr(10), chr(10) ORDER BY rank) AS context
  FROM hits JOIN chunked USING (doc_id, chunk_index) GROUP BY query_id)""",
    "levels": """levels AS (SELECT employee_id, skill, arg_max(level, ordinal) AS level FROM skills GROUP BY employee_id, skill)""",
    "options": """options AS (SELECT e.employee_id, e.role, coalesce(p.target, e.role) AS target, coalesce(p.ord, 0) AS pord
  FROM employees e LEFT JOIN paths p ON p.role = e.role)""",
    "role_gaps": """role_gaps AS (SELECT o.employee_id, o.role, o.target, o.pord, n.ord, n.skill, n.need,
    CASE WHEN n.skill IS NOT NULL THEN greatest(0, n.need - coalesce(l.level, 0)) END AS gap
  FROM options o LEFT JOIN needs n ON n.role = o.target LEFT JOIN levels l ON l.employee_id = o.employee_id AND l.skill = n.skill),
  targets AS (SELECT employee_id, role, target AS target_role, gap_score AS skill_gap_score FROM (
    SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY gap_score, pord) AS r FROM (
      SELECT employee_id, role, target, pord, coalesce(sum(gap) / sum(need), 1.0) AS gap_score FROM role_gaps GROUP BY ALL)) WHERE r = 1),
  wanted AS (SELECT g.employee_id, g.skill, g.gap, row_number() OVER (PARTITION BY g.employee_id ORDER BY g.gap DESC, g.ord) AS pos
    FROM role_gaps g JOIN targets t ON t.employee_id = g.employee_id AND t.target_role = g.target WHERE g.gap > 0)""",
    "courses": """first_course AS (SELECT skill, arg_min(course_id, ordinal) AS course_id FROM catalog GROUP BY skill),
  picked AS (SELECT employee_id, course_id, row_number() OVER (PARTITION BY employee_id ORDER BY pos) AS pos
    FROM wanted JOIN first_course USING (skill)),
  head AS (SELECT course_id, row_number() OVER (ORDER BY ordinal) AS hpos FROM catalog ORDER BY ordinal LIMIT 4),
  counted AS (SELECT e.employee_id, least(4, count(p.course_id)) AS n FROM employees e LEFT JOIN picked p USING (employee_id) GROUP BY e.employee_id),
  courses AS (SELECT employee_id, string_agg(course_id, ',' ORDER BY pos) AS courses, count(*) FILTER (WHERE pos > n) AS padded FROM (
    SELECT p.employee_id, p.course_id, p.pos, c.n FROM picked p JOIN counted c USING (employee_id) WHERE p.pos <= 4
    UNION ALL SELECT c.employee_id, h.course_id, c.n + h.hpos, c.n FROM counted c JOIN head h ON h.hpos <= 4 - c.n) GROUP BY employee_id)""",
    "mentors": """own AS (SELECT e.employee_id, arg_min(m.employee_id, m.ordinal) AS mentor_id FROM employees e
    JOIN employees m ON m.practice = e.practice AND m.rnk > e.rnk GROUP BY e.employee_id),
  anyone AS (SELECT r AS rnk, (SELECT arg_min(employee_id, ordinal) FROM employees WHERE rnk > r) AS mentor_id FROM range(5) t(r)),
  mentors AS (SELECT e.employee_id, coalesce(o.mentor_id, a.mentor_id) AS mentor_id FROM employees e
    LEFT JOIN own o USING (employee_id) LEFT JOIN anyone a ON a.rnk = e.rnk)""",
    "project_pick": """scored_projects AS (SELECT w.employee_id, p.ord, count(*) AS n FROM wanted w JOIN project_skills p ON p.skill = w.skill
    WHERE w.pos <= 2 GROUP BY ALL),
  project_pick AS (SELECT e.employee_id, coalesce(b.ord, 0) AS ord, b.ord IS NOT NULL AS matched FROM employees e LEFT JOIN (
    SELECT employee_id, ord, row_number() OVER (PARTITION BY employee_id ORDER BY n DESC, ord) AS r FROM scored_projects) b
    ON b.employee_id = e.employee_id AND b.r = 1)""",
    "people": f"""people_base AS (SELECT e.employee_id, e.practice, e.tenure_weeks, coalesce(h.hours, 38.0) AS avg_hours_wk,
    coalesce(h.pto, 0.02) AS pto_rate, coalesce(r.rating, 3.5) AS avg_rating FROM employees e
  LEFT JOIN (SELECT employee_id, avg(hours) AS hours, avg(CASE WHEN hours <= {LEAVE_HOURS} THEN 1.0 ELSE 0.0 END) AS pto
    FROM timesheets WHERE week BETWEEN '2024-W01' AND '2024-W05' GROUP BY employee_id) h USING (employee_id)
  LEFT JOIN (SELECT employee_id, avg(rating) AS rating FROM surveys WHERE month = '2024-01' GROUP BY employee_id) r USING (employee_id)),
  people_vars AS (SELECT *, avg_hours_wk / 40.0 AS workload_ratio, avg_rating / 5.0 * 2 - 1 AS sentiment_m1p1,
    0.8 * exp(-pow(tenure_weeks - 26, 2) / 200.0) + 0.6 * exp(-pow(tenure_weeks - 104, 2) / 450.0) AS tenure_bump FROM people_base),
  people AS (SELECT *, 1 / (1 + exp(-(1.1 * (greatest(workload_ratio, 1.0) - 1) - 1.2 * sentiment_m1p1 + 0.8 * pto_rate + 0.5 * tenure_bump - 0.3))) AS risk,
    list_reverse_sort([{{'v': round(1.1 * greatest(0.0, workload_ratio - 1), 9), 'i': 0, 'n': 'workload_ratio'}},
      {{'v': round(1.2 * greatest(0.0, -sentiment_m1p1), 9), 'i': -1, 'n': 'low_sentiment'}},
      {{'v': round(0.8 * pto_rate, 9), 'i': -2, 'n': 'pto_spike'}},
      {{'v': round(0.5 * tenure_bump, 9), 'i': -3, 'n': 'tenure_transition'}},
      {{'v': CASE WHEN avg_rating <= 3.0 AND workload_ratio >= 1.05 THEN 0.6 ELSE 0.0 END, 'i': -4, 'n': 'low_1on1'}},
      {{'v': CASE WHEN avg_rating <= 3.2 THEN 0.4 ELSE 0.0 END, 'i': -5, 'n': 'low_recognition'}},
      {{'v': CASE WHEN avg_rating <= 3.2 AND tenure_weeks > 80 THEN 0.5 ELSE 0.0 END, 'i': -6, 'n': 'low_growth'}}]) AS top FROM people_vars)""",
    "weak": """weak AS (SELECT employee_id, string_agg(skill, ', ' ORDER BY r) AS weak FROM (
  SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY level, skill) AS r FROM skills) WHERE r <= 2 GROUP BY employee_id)""",
}


def with_(names: str, body: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names.split()) + "\n" + body


