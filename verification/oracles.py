"""The same results as SQL over the given tables.

Doubles are rounded to 6 digits on both sides; ``+ 0.0`` makes a negative zero positive.
Queries whose result is not defined by SQL (trained models, factorisation, approximate search)
have no entry here; tests check their properties.
"""

from __future__ import annotations

from crewmetrics.reference import NEXT_STEP_RECOMMENDATIONS, QUESTION_PROMPT
from verification.adapters import CTE, SALT, STOP_WORDS, clean_words, lexicon_score, with_
from verification.adapters import KEYWORDS


def _r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def _r6(*names: str) -> str:
    return ", ".join(_r(n, n) for n in names)


def _hash(expression: str) -> str:
    return f"'H_' || substr(sha256(CAST({expression} AS VARCHAR) || '{SALT}'), 1, 16)"


_FEATURES = "employees timesheets surveys scored skills needs gaps moves ts_means sv_means features"
_RISK = _FEATURES + " risky"
_TEAMS = _RISK + " teams"
_PEOPLE = "employees timesheets surveys people"
_CAREER = "employees skills needs paths levels options role_gaps"
_STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
_MENTION = "CAST(" + " OR ".join(f"contains(lower(text), '{k}')" for k in KEYWORDS) + " AS INTEGER)"
_TOP3 = ", ".join(f"top[{i}].n AS top_driver_{i}" for i in (1, 2, 3))


def _prompt() -> str:
    """The question prompt as a concatenation."""
    parts = ["'" + part.replace("'", "''") + "'" for part in QUESTION_PROMPT.split("%s")]
    company, context, question = "'the company'", "context", "question"
    return " || ".join([parts[0], company, parts[1], context, parts[2], question, parts[3]])


def _steps() -> str:
    """The five recommendations as a concatenation."""
    text = "|".join(NEXT_STEP_RECOMMENDATIONS).replace("'", "''")
    return "'" + text.replace("{weak_skills}", "' || coalesce(weak, '') || '") + "'"


def _chunks(size: int, overlap: int) -> str:
    step = size - overlap
    return rf"""SELECT doc_id, CAST(i // {step} AS INTEGER) AS chunk_index, md5(array_to_string(ws[i + 1 : i + {size}], ' ')) AS text_md5
FROM (SELECT doc_id, ws, unnest(generate_series(0, CASE WHEN len(ws) <= {size} THEN 0
    ELSE CAST(ceil((len(ws) - {size}) / {step}.0) AS BIGINT) * {step} END, {step})) AS i
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents) WHERE len(ws) > 0)"""


def _knn(score: str, order: str, where: str = "rank <= 4") -> str:
    return f"""SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id, {score} AS score
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) q, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) c)) WHERE {where}"""


_L2 = _knn("power(list_distance(q.e, c.e), 2)", "ASC")
_COS = _knn("round(list_cosine_similarity(q.e, c.e), 9)", "DESC")

_ORDERS = """SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders"""
_SHOWN = "o_custkey AS employee_id, o_orderkey, round(o_totalprice, 6) + 0.0 AS attrition_risk, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at"

ORACLES = {
    "mask_ids": f"""SELECT {_hash('c_custkey')} AS customer_id, 'masked_' || {_hash('c_name')} AS c_name,
  'masked_' || {_hash("c_name || '@x.org'")} || '@example.com' AS email, c_mktsegment AS provider FROM customer""",
    "bucket_dates": """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS ordered_year, CAST(quarter(o_orderdate) AS INTEGER) AS ordered_quarter,
  CAST(month(o_orderdate) AS INTEGER) AS ordered_month FROM orders""",
    "month_buckets": """SELECT o_custkey, strftime(unnest(generate_series(date_trunc('month', a)::TIMESTAMP, date_trunc('month', b)::TIMESTAMP, INTERVAL 1 MONTH)), '%Y-%m') AS month
FROM (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY o_custkey)""",
    "week_buckets": """SELECT DISTINCT user_id, strftime(day, '%G-W%V') AS week FROM (SELECT user_id,
  unnest(generate_series(CAST(min(ts) AS DATE)::TIMESTAMP, CAST(max(ts) AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM events GROUP BY user_id)""",
    "event_weeks": "SELECT DISTINCT user_id, strftime(ts, '%G-W%V') AS week FROM events",
    "active_members": with_("employees", "SELECT employee_id, role, seniority FROM employees WHERE employee_id IN (SELECT CAST(user_id AS VARCHAR) FROM events)"),
    "unknown_members": with_("employees", "SELECT employee_id FROM employees WHERE employee_id NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events)"),
    "sql_parameters": f"""SELECT l_returnflag, l_linestatus, count(*) AS line_count, {_r('avg(l_discount)', 'avg_discount')}
FROM lineitem WHERE l_quantity >= 10.0 GROUP BY l_returnflag, l_linestatus""",
    "tenure_weeks": """SELECT o_orderkey, CAST(round_even(date_diff('day', CAST(o_orderdate AS DATE), DATE '2024-02-01') / 7.0, 0) AS INTEGER) AS tenure_weeks FROM orders""",
    "survey_sentiment": with_("surveys scored", f"""SELECT response_id, {_r6('sentiment_score')},
  {_r('2.0 * (rating - 1) / 4 - 1', 'normalized_rating')}, {_r6('survey_sentiment')} FROM scored"""),
    "monthly_sentiment": with_("surveys scored", f"""SELECT response_id, month,
  {_r('avg(survey_sentiment) OVER (PARTITION BY employee_id, month)', 'avg_monthly_sentiment')} FROM scored"""),
    "workload_ratio": with_("timesheets", f"SELECT employee_id, week, {_r('hours / 40.0', 'workload_ratio')} FROM timesheets"),
    "one_on_one_cadence": with_("surveys scored", f"""SELECT response_id, mention AS manager_meeting_mention,
  {_r('avg(mention) OVER (PARTITION BY employee_id)', 'manager_1on1_cadence')} FROM scored"""),
    "pto_spike": with_("timesheets", f"""SELECT employee_id, week, CAST(hours < 20 AS INTEGER) AS pto_spike,
  {_r('avg(CAST(hours < 20 AS INTEGER)) OVER (PARTITION BY employee_id)', 'pto_spike_rate')} FROM timesheets"""),
    "internal_moves": with_("moves", "SELECT employee_id, CAST(internal_moves AS INTEGER) AS internal_moves FROM moves"),
    "skills_pivot": with_("skills", "SELECT employee_id, " + ", ".join(
        f"coalesce(avg(level) FILTER (WHERE skill = '{t}'), 0.0) AS {t}" for t in ("view", "click", "purchase", "signup", "error")
    ) + " FROM skills GROUP BY employee_id"),
    "skill_gap": with_("employees skills needs gaps", f"SELECT employee_id, role, {_r6('skill_gap_score')} FROM gaps JOIN employees USING (employee_id)"),
    "employee_features": with_(_FEATURES, f"""SELECT employee_id, role, practice, tenure_weeks, internal_moves,
  {_r6('skill_gap_score', 'workload_ratio', 'pto_spike_rate', 'survey_sentiment', 'manager_1on1_cadence')}, left_company FROM features"""),
    "risk_score": with_(_RISK, f"SELECT employee_id, practice, {_r6('risk_score')} FROM risky"),
    "team_risk": with_(_TEAMS, f"""SELECT team, {_r6('avg_risk', 'avg_skill_gap', 'avg_sentiment', 'avg_workload_ratio', 'avg_pto_spike', 'avg_manager_1on1')},
  {_TOP3} FROM teams"""),
    "risk_rollup": with_(_RISK, f"""SELECT practice, role, CAST(2 - grouping(practice) - grouping(role) AS INTEGER) AS level, count(*) AS people,
  {_r('avg(risk_score)', 'avg_risk')}, {_r('avg(skill_gap_score)', 'avg_skill_gap')} FROM risky GROUP BY ROLLUP (practice, role)"""),
    "top_teams": with_(_TEAMS, f"SELECT team, {_r6('avg_risk')} FROM teams ORDER BY teams.avg_risk DESC, team LIMIT 3"),
    "team_drivers": with_(_TEAMS, """SELECT team, CAST(i AS INTEGER) AS rank, top[i].n AS driver FROM (SELECT team, top, unnest([1, 2, 3]) AS i FROM teams WHERE team = 'BUILDING')"""),
    "risk_decisions": with_(_RISK, "SELECT employee_id, CAST(round(risk_score, 6) >= 0.3 AS INTEGER) AS at_risk FROM risky"),
    "batch_person_risk": with_(_PEOPLE, f"""SELECT employee_id, practice, tenure_weeks,
  {_r6('avg_hours_wk', 'pto_rate', 'avg_rating', 'workload_ratio', 'sentiment_m1p1', 'tenure_bump', 'risk')}, {_TOP3} FROM people"""),
    "batch_team_risk": with_(_PEOPLE, f"""SELECT team, avg_risk, m1.n AS top_driver_1, m2.n AS top_driver_2, m3.n AS top_driver_3 FROM
(SELECT practice AS team, round_even(avg(risk), 2) AS avg_risk FROM people WHERE practice IS NOT NULL GROUP BY practice)
""" + "\n".join(f"""JOIN (SELECT practice, n FROM (SELECT practice, top[{i}].n AS n, row_number() OVER (PARTITION BY practice ORDER BY count(*) DESC, top[{i}].n) AS r
  FROM people GROUP BY practice, top[{i}].n) WHERE r = 1) m{i} ON m{i}.practice = team""" for i in (1, 2, 3))),
    "next_steps": with_(_PEOPLE + " skills weak", f"""SELECT employee_id, round_even(risk, 3) + 0.0 AS attrition_risk,
  {_steps()} AS steps, 'manager' AS owner, 6 AS suggested_check_in_weeks,
  {_r6('workload_ratio')}, top[1].n || ',' || top[2].n || ',' || top[3].n AS top_drivers FROM people LEFT JOIN weak USING (employee_id)"""),
    "person_prompts": with_(_PEOPLE + " skills", """SELECT employee_id, '[' || coalesce(s, '') || ']' AS skills_line,
  '[' || top[1].n || ', ' || top[2].n || ', ' || top[3].n || ']' AS drivers_line
FROM people LEFT JOIN (SELECT employee_id, string_agg('{''skill'': ''' || skill || ''', ''level'': ' || CAST(level AS INTEGER) || '}', ', ' ORDER BY level DESC, skill) AS s
  FROM skills GROUP BY employee_id) USING (employee_id)"""),
    "parsed_replies": """SELECT event_id, CASE WHEN t THEN '' ELSE event_type END AS owner, CASE WHEN t THEN -1.0::DOUBLE ELSE 0.5::DOUBLE END AS attrition_risk,
  CAST(CASE WHEN t OR event_id % 4 = 0 THEN -1 ELSE event_id % 9 END AS INTEGER) AS weeks,
  CASE WHEN t OR event_id % 5 = 0 THEN '' ELSE 'a|' || event_type END AS recommendations,
  CASE WHEN t THEN '' ELSE 'mood={"score":' || (event_id % 7) || '}' || CASE WHEN event_id % 5 = 0 THEN '|recommendations="rest"' ELSE '' END
    || CASE WHEN event_id % 4 = 0 THEN '|suggested_check_in_weeks="soon"' ELSE '' END END AS others,
  CASE WHEN t THEN 'note ' || props ELSE '' END AS model_response FROM (SELECT *, event_id % 3 = 0 AS t FROM events)""",
    "latest_per_key": f"SELECT {_SHOWN} FROM ({_ORDERS}) WHERE r = 1",
    "upsert_next_steps": f"""WITH old AS (SELECT * FROM ({_ORDERS} WHERE o_orderstatus = 'F') WHERE r = 1),
  new AS (SELECT * FROM ({_ORDERS} WHERE o_orderstatus <> 'F') WHERE r = 1)
SELECT {_SHOWN} FROM (SELECT * FROM old WHERE o_custkey NOT IN (SELECT o_custkey FROM new) UNION ALL SELECT * FROM new)""",
    "lexicon_sentiment": f"SELECT doc_id AS response_id, {_r(lexicon_score('text'), 'sentiment_score')} FROM documents",
    "weighted_sentiment": f"""WITH {CTE['lexicon']}, words AS (SELECT doc_id, unnest({clean_words('text')}) AS word FROM documents)
SELECT d.doc_id AS response_id, {_r('greatest(-1.0, least(1.0, coalesce(p, 0.0)))', 'polarity')} FROM documents d
LEFT JOIN (SELECT doc_id, avg(weight) AS p FROM words JOIN lexicon USING (word) GROUP BY doc_id) x ON x.doc_id = d.doc_id""",
    "team_sentiment": with_("employees surveys scored", f"""SELECT practice AS team, {_r('avg(survey_sentiment)', 'avg_sentiment')}, count(survey_sentiment) AS response_count
FROM scored JOIN employees USING (employee_id) WHERE practice IS NOT NULL GROUP BY practice"""),
    "keyword_mentions": rf"SELECT conv_id, turn, {_MENTION} AS mention, CAST(regexp_matches(text, '\S') AS INTEGER) AS spoken FROM conversations",
    "tfidf_terms": rf"""WITH spoken AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: t NOT IN {_STOP}) AS ts
  FROM documents WHERE regexp_matches(text, '\S')),
grams AS (SELECT doc_id, unnest(ts) AS term FROM spoken UNION ALL
  SELECT doc_id, ts[i] || ' ' || ts[i + 1] FROM (SELECT doc_id, ts, unnest(generate_series(1, len(ts) - 1)) AS i FROM spoken)),
counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS (SELECT term, ln((1.0 + (SELECT count(*) FROM spoken)) / (1.0 + df)) + 1 AS idf FROM (
  SELECT term, count(*) AS df, sum(tf) AS total FROM counts GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 1000))
SELECT doc_id AS response_id, term, {_r('tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY doc_id))', 'weight')} FROM counts JOIN vocab USING (term)""",
    "theme_summary": with_("employees surveys scored", f"""SELECT team, response_count, CASE WHEN a >= b AND a >= c THEN 'Topic 1' WHEN b >= c THEN 'Topic 2' ELSE 'Topic 3' END AS dominant_theme,
  {_r('greatest(a, b, c)', 'dominant_theme_score')}, {_r('a', 'theme_1_score')}, {_r('b', 'theme_2_score')}, {_r('c', 'theme_3_score')} FROM (
  SELECT practice AS team, count(*) AS response_count, avg(round(sentiment_score, 3)) AS a, avg(rating / 40.0) AS b, avg(length(free_text) / 16384.0) AS c
  FROM scored JOIN employees USING (employee_id) WHERE practice IS NOT NULL GROUP BY practice)"""),
    "theme_fit": r"SELECT count(*) FILTER (regexp_matches(text, '\S')) AS responses, 5 AS themes, 1 AS never_rises, 1 AS explains FROM documents",
    "team_themes": with_("employees surveys scored", """SELECT practice AS team, count(*) AS response_count, 1 AS named, 1 AS greatest
  FROM scored JOIN employees USING (employee_id) WHERE practice IS NOT NULL GROUP BY practice"""),
    "auc_exact": f"""WITH x AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id)),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM x)
SELECT {_r('(sum(k) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0))', 'auc')} FROM r""",
    "classification_report": f"""WITH x AS (SELECT quality AS y, CAST(n_chars >= 700 AS INTEGER) AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT k, count(*) FILTER (WHERE y = k AND p = k) AS t, count(*) FILTER (WHERE p = k) AS q, count(*) FILTER (WHERE y = k) AS s
  FROM x, (SELECT unnest([0, 1]) AS k) GROUP BY k),
p AS (SELECT k, s, t, coalesce(t / nullif(q, 0)::DOUBLE, 0) AS pr, coalesce(t / nullif(s, 0)::DOUBLE, 0) AS re FROM c),
m AS (SELECT *, coalesce(2.0 * pr * re / nullif(pr + re, 0), 0) AS f FROM p)
SELECT name, {_r6('precision', 'recall', 'f1')}, support FROM (
  SELECT CAST(k AS VARCHAR) AS name, pr AS precision, re AS recall, f AS f1, CAST(s AS BIGINT) AS support FROM m UNION ALL
  SELECT 'accuracy', sum(t) / sum(s), sum(t) / sum(s), sum(t) / sum(s), CAST(sum(s) AS BIGINT) FROM m UNION ALL
  SELECT 'macro avg', avg(pr), avg(re), avg(f), CAST(sum(s) AS BIGINT) FROM m UNION ALL
  SELECT 'weighted avg', sum(pr * s) / sum(s), sum(re * s) / sum(s), sum(f * s) / sum(s), CAST(sum(s) AS BIGINT) FROM m)""",
    "stratified_split": """WITH c AS (SELECT quality, count(*) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS t FROM labels GROUP BY quality)
SELECT quality, 'test' AS part, t AS n FROM c UNION ALL SELECT quality, 'train', n - t FROM c""",
    "explain_levels": with_(_RISK, f"""SELECT employee_id, {_r('risk_score', 'attrition_risk')},
  CASE WHEN risk_score > 0.7 THEN 'high' WHEN risk_score > 0.3 THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN workload_ratio > (SELECT median(workload_ratio) FROM risky) THEN 'high' ELSE 'low' END || ' workload ratio, ' ||
  CASE WHEN tenure_weeks > (SELECT median(tenure_weeks) FROM risky) THEN 'high' ELSE 'low' END || ' tenure weeks, low survey sentiment' AS drivers FROM risky"""),
    "chunks": _chunks(800, 100),
    "small_chunks": _chunks(512, 50),
    "chunk_ids": f"SELECT count(*) AS n, count(*) AS ids, CAST(0 AS BIGINT) AS lowest, count(*) - 1 AS highest FROM ({_chunks(800, 100)})",
    "knn_l2": f"SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, {_r6('score')} FROM ({_L2})",
    "knn_l2_similarity": f"SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, {_r('1.0 / (1.0 + score)', 'score')} FROM ({_L2})",
    "knn_cosine": f"SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, {_r6('score')} FROM ({_COS})",
    "importance_order": """SELECT feature, CAST(feature = 'balance' AS INTEGER) AS first, CAST(feature = 'balance' AS INTEGER) AS matters,
  CAST(feature <> 'balance' AS INTEGER) AS idle FROM (SELECT unnest(['balance', 'week', 'nation']) AS feature)""",
    "explained_people": f"""SELECT c_custkey, 'balance' AS feature, {_r('c_acctbal::DOUBLE', 'value')},
  CASE WHEN c_acctbal::DOUBLE > (SELECT median(c_acctbal::DOUBLE) FROM customer) THEN 'high' ELSE 'low' END || ' balance' AS description FROM customer""",
    "person_lookup": with_("employees", "SELECT employee_id, role, practice FROM employees WHERE employee_id = '42'"),
    "csv_round_trip": "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer",
    "catalog_table": "SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag",
    "knn_approximate": "SELECT vec_id AS query_id, least(4, (SELECT count(*) FROM embeddings)) AS found, vec_id AS first, CAST(0 AS DOUBLE) AS least FROM embeddings",
    "knn_approximate_recall": "SELECT CAST(sum(least(4, n)) AS BIGINT) AS neighbours, 1 AS recall_reached, 1 AS pruned FROM (SELECT count(*) OVER () AS n FROM embeddings)",
    "sparse_retrieval": with_("chunked passages hits", f"SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, chunk_index, {_r6('score')} FROM hits"),
    "context_prompt": with_("chunked passages hits contexts", f"""SELECT query_id, md5(context) AS context_md5, md5({_prompt()}) AS prompt_md5
  FROM contexts JOIN questions USING (query_id)"""),
    "citations": with_("chunked questions answers hits", r"""SELECT query_id, id, source,
  md5(CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END) AS preview FROM (
  SELECT DISTINCT query_id, TRY_CAST(unnest(regexp_extract_all(answer, '\[(\d+)\]', 1)) AS INTEGER) AS id FROM answers) c
JOIN hits USING (query_id) JOIN chunked USING (doc_id, chunk_index) WHERE rank = id"""),
    "ask": with_("chunked questions answers hits", r"""SELECT q.query_id, coalesce(md5(a.answer), '') AS answer_md5, coalesce(cited, '') AS cited
FROM questions q LEFT JOIN answers a USING (query_id) LEFT JOIN (
  SELECT query_id, string_agg(id || ':' || source, ',' ORDER BY id) AS cited FROM (
    SELECT DISTINCT query_id, TRY_CAST(unnest(regexp_extract_all(answer, '\[(\d+)\]', 1)) AS INTEGER) AS id FROM answers) c
  JOIN hits USING (query_id) JOIN chunked USING (doc_id, chunk_index) WHERE rank = id GROUP BY query_id) USING (query_id)"""),
    "hit_at_k": f"""WITH l AS ({_L2}), c AS ({_knn('round(list_cosine_similarity(q.e, c.e), 9)', 'DESC', 'rank = 2')})
SELECT count(*) AS queries, {_r('avg(CASE WHEN l.vec_id IS NULL THEN 0 ELSE 1 END)', 'hit_rate')} FROM c LEFT JOIN l ON l.query_id = c.query_id AND l.vec_id = c.vec_id""",
    "employee_skills": with_("skills levels", "SELECT employee_id, string_agg(skill || '=' || CAST(level AS INTEGER), ',' ORDER BY skill) AS skills FROM levels GROUP BY employee_id"),
    "career_target": with_(_CAREER, f"""SELECT employee_id, role, target_role, {_r6('skill_gap_score')}, coalesce(wanted, '') AS wanted FROM targets
LEFT JOIN (SELECT employee_id, string_agg(skill, ',' ORDER BY pos) AS wanted FROM wanted GROUP BY employee_id) USING (employee_id)"""),
    "target_gaps": with_("employees skills needs levels", f"""SELECT e.employee_id, e.role AS target_role,
  {_r('coalesce(sum(greatest(0, need - coalesce(level, 0))) / sum(need), 1.0)', 'skill_gap_score')}, CAST(count(need) AS INTEGER) AS skills,
  {_r('coalesce(sum(CASE WHEN need IS NOT NULL THEN greatest(0, need - coalesce(level, 0)) END), 0.0)', 'total_gap')}
FROM employees e LEFT JOIN needs n ON n.role = e.role LEFT JOIN levels l ON l.employee_id = e.employee_id AND l.skill = n.skill GROUP BY e.employee_id, e.role"""),
    "career_courses": with_(_CAREER + " catalog courses", "SELECT employee_id, courses, padded FROM courses"),
    "fallback_courses": with_("employees skills ref_needs ref_paths levels options role_gaps ref_catalog courses",
        "SELECT employee_id, target_role, courses FROM courses JOIN targets USING (employee_id)"),
    "career_mentor": with_("employees mentors", "SELECT employee_id, coalesce(mentor_id, 'none') AS mentor_id FROM mentors"),
    "career_project": with_(_CAREER + " projects project_skills project_pick", """SELECT k.employee_id, p.title,
  CASE WHEN matched THEN 'Addresses skill gaps in ' || w.two ELSE 'General skill development' END AS reason
FROM project_pick k JOIN projects p USING (ord) LEFT JOIN (SELECT employee_id, string_agg(skill, ', ' ORDER BY pos) AS two FROM wanted WHERE pos <= 2 GROUP BY employee_id) w
  ON w.employee_id = k.employee_id"""),
    "career_plan": with_(_CAREER + " catalog courses mentors projects project_skills project_pick", f"""SELECT t.employee_id, t.role AS current_role, t.target_role,
  {_r('t.skill_gap_score', 'skill_gap_score')}, c.courses, coalesce(m.mentor_id, 'none') AS mentor_id, p.title AS project
FROM targets t JOIN courses c USING (employee_id) JOIN mentors m USING (employee_id) JOIN project_pick k USING (employee_id) JOIN projects p ON p.ord = k.ord"""),
    "skill_demand": with_("employees skills needs levels", f"""SELECT role, skill, required_level, people, {_r6('avg_level', 'total_gap')},
  CAST(row_number() OVER (PARTITION BY role ORDER BY total_gap DESC, skill) AS INTEGER) AS demand_rank FROM (
  SELECT e.role, n.skill, CAST(max(need) AS DOUBLE) AS required_level, count(*) AS people, avg(coalesce(level, 0)) AS avg_level, sum(greatest(0, need - coalesce(level, 0))) AS total_gap
  FROM employees e JOIN needs n ON n.role = e.role LEFT JOIN levels l ON l.employee_id = e.employee_id AND l.skill = n.skill GROUP BY e.role, n.skill)"""),
}
