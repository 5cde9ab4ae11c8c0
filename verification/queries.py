"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewmetrics import reference as ref
from crewmetrics.functions import dates, masking
from crewmetrics.functions import text as tx
from crewmetrics.functions.dates import iso_week
from crewmetrics.operators import (
    batch_risk, buckets, career, evaluate, explain, features, knn as nn, model, next_steps, retrieval, risk, selection, sentiment,
    tfidf, themes,
)
from crewmetrics.plans.scratch import scratch_folder
from crewmetrics.sources import files, tables
from verification import adapters as a

LEXICON = {"positive": a.POSITIVE, "negative": a.NEGATIVE}
IMPORTANCE = [
    {"feature": "workload_ratio", "importance": 0.9},
    {"feature": "tenure_weeks", "importance": 0.7},
    {"feature": "survey_sentiment", "importance": 0.5, "coefficient": -0.5},
    {"feature": "skill_gap_score", "importance": 0.4, "coefficient": 0.4},
    {"feature": "internal_moves", "importance": 0.1},
    {"feature": "pto_spike_rate", "importance": 0.05},
]


def r6(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits; adding zero turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(F.col(f.name), 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema
        ]
    )


def _features(s, d) -> DataFrame:
    return features.employee_features(
        a.employees(s, d), a.skills(s, d), as_of=a.AS_OF, surveys=a.surveys(s, d), timesheets=a.timesheets(s, d),
        history=a.role_history(s, d), requirements=a.REQUIREMENTS, keywords=a.KEYWORDS, history_tie="o_orderkey", **LEXICON,
    )


def _people(s, d) -> DataFrame:
    return batch_risk.person_risk(
        a.employees(s, d), a.surveys(s, d), a.timesheets(s, d), as_of=a.AS_OF, leave_hours=a.LEAVE_HOURS
    )


def _scored(s, d) -> DataFrame:
    return features.survey_sentiment(a.surveys(s, d), **LEXICON)


# ----------------------------------------------------------- masking, buckets, selection


def mask_ids(s, d):
    c = a.table(s, d, "customer").select(
        F.col("c_custkey").alias("customer_id"), "c_name", F.concat("c_name", F.lit("@x.org")).alias("email"),
        F.col("c_mktsegment").alias("provider"),
    )
    return masking.mask_columns(c, masking.pii_columns(c), a.SALT)


def bucket_dates(s, d):
    o = a.table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("ordered"))
    return masking.bucket_dates(o, ["ordered"]).drop("ordered")


def month_buckets(s, d):
    o = a.table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return dates.month_buckets(o, F.col("a"), F.col("b")).select("o_custkey", "month")


def week_buckets(s, d):
    e = a.table(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return dates.week_buckets(e, F.col("a"), F.col("b")).select("user_id", "week")


def event_weeks(s, d):
    return a.table(s, d, "events").select("user_id", iso_week(F.col("ts")).alias("week")).distinct()


def active_members(s, d):
    people, ids = a.employees(s, d), a.timesheets(s, d).select("employee_id").distinct()
    return selection.among(people, "employee_id", ids).select("employee_id", "role", "seniority")


def unknown_members(s, d):
    return selection.unknown(a.employees(s, d).select("employee_id"), a.timesheets(s, d), "employee_id")


def sql_parameters(s, d):
    a.table(s, d, "lineitem").createOrReplaceTempView("lineitem_view")
    return r6(
        tables.query(
            s,
            "SELECT l_returnflag, l_linestatus, count(*) AS line_count, avg(l_discount) AS avg_discount "
            "FROM lineitem_view WHERE l_quantity >= :floor GROUP BY l_returnflag, l_linestatus",
            {"floor": 10.0},
        )
    )


# ----------------------------------------------------------- features


def tenure_weeks(s, d):
    o = a.table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("hire_date"))
    return features.tenure_weeks(o, a.AS_OF).select("o_orderkey", "tenure_weeks")


def survey_sentiment(s, d):
    return r6(_scored(s, d).select("response_id", "sentiment_score", "normalized_rating", "survey_sentiment"))


def monthly_sentiment(s, d):
    return r6(features.monthly_sentiment(a.surveys(s, d), **LEXICON).select("response_id", "month", "avg_monthly_sentiment"))


def workload_ratio(s, d):
    return r6(features.workload_ratio(a.timesheets(s, d)).select("employee_id", "week", "workload_ratio"))


def one_on_one_cadence(s, d):
    marked = features.one_on_one_cadence(a.surveys(s, d), a.KEYWORDS)
    return r6(marked.select("response_id", "manager_meeting_mention", "manager_1on1_cadence"))


def pto_spike(s, d):
    return r6(features.pto_spike(a.timesheets(s, d)).select("employee_id", "week", "pto_spike", "pto_spike_rate"))


def internal_moves(s, d):
    return features.internal_moves(a.role_history(s, d), tie="o_orderkey")


def skills_pivot(s, d):
    return r6(features.skills_wide(a.skills(s, d), a.EVENT_TYPES))


def skill_gap(s, d):
    people = a.employees(s, d)
    return r6(features.skill_gap_score(people, a.skills(s, d), a.REQUIREMENTS).select("employee_id", "role", "skill_gap_score"))


def employee_features(s, d):
    return r6(_features(s, d))


def risk_score(s, d):
    return r6(features.risk_score(_features(s, d)).select("employee_id", "practice", "risk_score"))


def team_risk(s, d):
    return r6(risk.team_risk(_features(s, d)))


def risk_rollup(s, d):
    return r6(risk.risk_drilldown(_features(s, d)).select("practice", "role", "level", "people", "avg_risk", "avg_skill_gap"))


def top_teams(s, d):
    return r6(risk.top_teams(risk.team_risk(_features(s, d))).select("team", "avg_risk"))


def team_drivers(s, d):
    return risk.drivers_of(risk.team_risk(_features(s, d)), "BUILDING")


def risk_decisions(s, d):
    scored = features.risk_score(_features(s, d)).withColumnRenamed("risk_score", "attrition_risk")
    decided = risk.decide(scored.withColumn("attrition_risk", F.round("attrition_risk", 6)), threshold=0.3)
    return decided.select("employee_id", F.col("at_risk").cast("int").alias("at_risk"))


# ----------------------------------------------------------- batch risk and next steps


def batch_person_risk(s, d):
    return r6(_people(s, d))


def batch_team_risk(s, d):
    return batch_risk.team_risk(_people(s, d))


def next_steps_records(s, d):
    made = next_steps.next_steps(_people(s, d), a.skills(s, d))
    return r6(
        made.select(
            "employee_id", "attrition_risk", F.array_join("recommendations", "|").alias("steps"),
            "owner", "suggested_check_in_weeks", "workload_ratio", F.array_join("top_drivers", ",").alias("top_drivers"),
        )
    )


def person_prompts(s, d):
    made = next_steps.person_prompts(_people(s, d), a.skills(s, d))
    skills_line = F.regexp_extract("prompt", r"- skills: (.*)", 1)
    drivers_line = F.regexp_extract("prompt", r"- top_drivers: (.*)", 1)
    return made.select("employee_id", skills_line.alias("skills_line"), drivers_line.alias("drivers_line"))


def parsed_replies(s, d):
    # every third event gets text that is not JSON; of the others some lack a type, and some say more than is asked for
    n = F.col("event_id")
    weeks = F.when(n % 4 == 0, '"soon"').otherwise((n % 9).cast("string"))
    advice = F.when(n % 5 == 0, '"rest"').otherwise(F.concat(F.lit('["a", "'), "event_type", F.lit('"]')))
    said = F.concat(
        F.lit('{"owner": "'), "event_type", F.lit('", "attrition_risk": 0.5, "suggested_check_in_weeks": '), weeks,
        F.lit(', "recommendations": '), advice, F.lit(', "mood": {"score": '), (n % 7).cast("string"), F.lit("}}"),
    )
    e = a.table(s, d, "events").select("event_id", F.when(n % 3 == 0, F.concat(F.lit("note "), "props")).otherwise(said).alias("response"))
    parsed = e.withColumn("reply", next_steps.parse_reply(F.col("response")))
    others = F.array_sort(F.transform(F.map_entries("reply.other_fields"), lambda x: F.concat(x["key"], F.lit("="), F.to_json(x["value"]))))
    return parsed.select(
        "event_id", F.col("reply.owner").alias("owner"), F.col("reply.attrition_risk").alias("attrition_risk"),
        F.col("reply.suggested_check_in_weeks").alias("weeks"), F.array_join("reply.recommendations", "|").alias("recommendations"),
        F.array_join(others, "|").alias("others"), F.when(F.col("reply").isNull(), F.col("response")).alias("model_response"),
    ).fillna("", subset=["owner", "model_response", "recommendations", "others"]).fillna(-1.0, subset=["attrition_risk"]).fillna(-1, subset=["weeks"])


def _order_rows(s, d):
    return a.table(s, d, "orders").select(
        F.col("o_custkey").alias("employee_id"), "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("attrition_risk"),
        F.col("o_orderdate").alias("created_at"),
    )


def _shown(df):
    return r6(df.select("employee_id", "o_orderkey", "attrition_risk", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")))


def latest_per_key(s, d):
    newest = [F.col("created_at").desc(), F.col("o_orderkey").desc()]
    return _shown(next_steps.latest_per_key(_order_rows(s, d), "employee_id", newest))


def upsert_next_steps(s, d):
    newest = [F.col("created_at").desc(), F.col("o_orderkey").desc()]
    rows = _order_rows(s, d)
    old = next_steps.latest_per_key(rows.where("o_orderstatus = 'F'"), "employee_id", newest)
    new = next_steps.latest_per_key(rows.where("o_orderstatus <> 'F'"), "employee_id", newest)
    return _shown(next_steps.upsert(old, new, "employee_id"))


# ----------------------------------------------------------- text


def lexicon_sentiment(s, d):
    scored = sentiment.lexicon_sentiment(a.surveys(s, d), **LEXICON)
    return r6(scored.select("response_id", "sentiment_score"))


def weighted_sentiment(s, d):
    return r6(sentiment.weighted_sentiment(a.surveys(s, d), "response_id", "free_text", a.WEIGHTS))


def team_sentiment(s, d):
    return r6(sentiment.team_sentiment(_scored(s, d), a.employees(s, d)))


def keyword_mentions(s, d):
    text = F.col("text")
    return a.table(s, d, "conversations").select(
        "conv_id", "turn", tx.mentions_any(text, a.KEYWORDS).alias("mention"), tx.not_blank(text).cast("int").alias("spoken")
    )


def tfidf_terms(s, d):
    corpus = tfidf.survey_terms(a.surveys(s, d), ["response_id"], "free_text", a.STOP_WORDS)
    return r6(tfidf.weights(corpus.vectors, corpus.vocab, ["response_id"]))


def theme_summary(s, d):
    scored = _scored(s, d).select(
        "employee_id", F.round("sentiment_score", 3).alias("theme_1_score"), (F.col("rating") / 40.0).alias("theme_2_score"),
        (F.length("free_text") / 16384.0).alias("theme_3_score"),
    )
    return r6(themes.theme_summary(scored, a.employees(s, d), 3))


def theme_terms(s, d):
    fitted, _ = themes.fit_themes(
        a.surveys(s, d), "response_id", n_themes=5, stop_words=a.STOP_WORDS
    )
    return fitted.term_table(s)


def theme_fit(s, d):
    """Whether the error never rose while themes were fitted, and whether it ended below that of no themes at all."""
    fitted, vecs = themes.fit_themes(a.surveys(s, d), "response_id", n_themes=5, stop_words=a.STOP_WORDS)
    falls = all(later <= before * (1 + 1e-9) for before, later in zip(fitted.losses, fitted.losses[1:]))
    squares = F.sum(F.aggregate("weights", F.lit(0.0), lambda acc, w: acc + w * w))
    return vecs.agg(
        F.count("*").alias("responses"), F.lit(fitted.n_themes).alias("themes"), F.lit(int(falls)).alias("never_rises"),
        (F.lit(fitted.losses[-1]) < squares).cast("int").alias("explains"),
    )


def team_themes(s, d):
    """The dominant fitted theme of each team, and over how many responses."""
    scored = themes.survey_themes(a.surveys(s, d), "response_id", 5, stop_words=a.STOP_WORDS)
    teams = themes.theme_summary(scored, a.employees(s, d), 5)
    best = F.greatest(*[f"theme_{i}_score" for i in range(1, 6)])
    return teams.select(
        "team", "response_count", F.col("dominant_theme").rlike("^Topic [1-5]$").cast("int").alias("named"),
        (F.col("dominant_theme_score") == best).cast("int").alias("greatest"),
    )


def themes_nmf(s, d):
    return themes.survey_themes(
        a.surveys(s, d), "response_id", 5, stop_words=a.STOP_WORDS
    ).drop("free_text")


# ----------------------------------------------------------- model


def auc_exact(s, d):
    return r6(evaluate.auc_exact(a.scored_labels(s, d), "score", "quality"))


def classification_report(s, d):
    return r6(evaluate.classification_report(a.scored_labels(s, d), "quality", "predicted"))


def _document_features(s, d):
    docs = sentiment.lexicon_sentiment(a.table(s, d, "documents"), "text", **LEXICON)
    made = docs.select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(tx.words(F.col("text"))).cast("double").alias("n_words"),
        "sentiment_score",
    )
    return made.join(a.table(s, d, "labels").select("doc_id", F.col("quality").alias("left_company")), "doc_id", "left")


def _trained(s, d, kind):
    rows = _document_features(s, d)
    return model.train(rows, kind, key="doc_id", numeric=["n_chars", "n_words", "sentiment_score"]), rows


def attrition_scores(s, d):
    trained, rows = _trained(s, d, model.LINEAR)
    return model.predict(trained, rows)


def boosted_scores(s, d):
    trained, rows = _trained(s, d, model.BOOSTED)
    return model.predict(trained, rows)


def linear_importance(s, d):
    return explain.linear_importance(_trained(s, d, model.LINEAR)[0], s)


def permutation_importance(s, d):
    return explain.permutation_importance(*_trained(s, d, model.LINEAR))


def _balances(s, d):
    """Customers that "leave" where they have money: one feature decides, two say nothing."""
    c = a.table(s, d, "customer")
    return c.select(
        "c_custkey", F.col("c_acctbal").cast("double").alias("balance"), (F.col("c_custkey") % 7).cast("double").alias("week"),
        F.col("c_nationkey").cast("double").alias("nation"), (F.col("c_acctbal") > 0).cast("int").alias("left_company"),
    )


def _balance_model(s, d):
    rows = _balances(s, d)
    return model.train(rows, key="c_custkey", numeric=["balance", "week", "nation"], evaluate=False), rows


def importance_order(s, d):
    """Which features matter when they are shuffled: the first one, and those that do not."""
    found = explain.permutation_importance(*_balance_model(s, d))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("importance").desc()))  # one row for each feature
    return found.select(
        "feature", (rank == 1).cast("int").alias("first"), (F.col("importance") > 0.1).cast("int").alias("matters"),
        (F.abs("importance") < 0.03).cast("int").alias("idle"),
    )


def explained_people(s, d):
    """The first driver of every customer from a trained model, by shuffled importance and by median."""
    trained, rows = _balance_model(s, d)
    told = explain.explain_model(trained, rows, method="permutation")
    first = F.get("top_drivers", F.lit(0))
    return r6(told.select("c_custkey", first["feature"].alias("feature"), first["value"].alias("value"), first["description"].alias("description")))


def person_lookup(s, d):
    return selection.lookup(a.employees(s, d), "employee_id", "42").select("employee_id", "role", "practice")


def csv_round_trip(s, d):
    """Customers as CSV files and back, by declared types."""
    rows = a.table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    path = scratch_folder(s)
    files.write_csv(rows, path)
    return files.read_csv(s, path, rows.schema, multiline=False)


def catalog_table(s, d):
    a.table(s, d, "lineitem").createOrReplaceTempView("shipped")
    return tables.read_table(s, "shipped").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


def stratified_split(s, d):
    labels = a.table(s, d, "labels")
    train, test = model.stratified_split(labels, "quality", "doc_id")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("quality", "part").agg(F.count("*").alias("n"))


def explain_levels(s, d):
    rows = features.risk_score(_features(s, d)).withColumnRenamed("risk_score", "attrition_risk")
    made = explain.explain(rows, IMPORTANCE)
    described = F.array_join(F.transform("top_drivers", lambda x: x["description"]), ", ")
    return r6(made.select("employee_id", "attrition_risk", "risk_level", described.alias("drivers")))


# ----------------------------------------------------------- retrieval


def chunks(s, d):
    return retrieval.chunks(a.policies(s, d)).select("doc_id", "chunk_index", F.md5("text").alias("text_md5"))


def small_chunks(s, d):
    return retrieval.chunks(a.policies(s, d), 512, 50).select("doc_id", "chunk_index", F.md5("text").alias("text_md5"))


def chunk_ids(s, d):
    made = retrieval.with_chunk_ids(a.policies(s, d))
    return made.agg(
        F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids"), F.min("chunk_id").alias("lowest"), F.max("chunk_id").alias("highest")
    )


def _vectors(s, d):
    e = a.table(s, d, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("vector"))


def knn_l2(s, d):
    v = _vectors(s, d)
    return r6(nn.knn(v, v, key=["vec_id"], query_key="vec_id", k=4, metric="l2"))


def knn_l2_similarity(s, d):
    v = _vectors(s, d)
    return r6(nn.with_similarity(nn.knn(v, v, key=["vec_id"], query_key="vec_id", k=4, metric="l2")))


def knn_cosine(s, d):
    v = _vectors(s, d)
    return r6(nn.knn(v, v, key=["vec_id"], query_key="vec_id", k=4))


def _approximate(s, d):
    v = _vectors(s, d)
    index = buckets.build(v, key=["vec_id"], tables=3, bits=6)
    return v, index, buckets.search(index, v, query_key="vec_id", k=4, visits=20)


def knn_approximate(s, d):
    """Every row's distance to the row itself, which every bucket index must find first, and how many rows were found."""
    found = _approximate(s, d)[2]
    return found.groupBy("query_id").agg(
        F.count("*").alias("found"), F.min_by("vec_id", "rank").alias("first"), F.round(F.min("score"), 6).alias("least"),
    )


def knn_approximate_recall(s, d):
    """The share of the true neighbours found, against the exact search, and whether pairs were left out."""
    v, index, found = _approximate(s, d)
    exact = nn.knn(v, v, key=["vec_id"], query_key="vec_id", k=4, metric="l2")
    hits = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    counts = hits.agg(F.count("*").alias("neighbours"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    pairs = buckets.compared(index, v, query_key="vec_id", visits=20)
    all_pairs = F.lit(v.count()) ** 2 * index.tables
    return counts.select(
        "neighbours", (F.col("recall") >= 0.9).cast("int").alias("recall_reached"),
        (pairs.scalar() < all_pairs * 0.5).cast("int").alias("pruned"),
    )


def sparse_retrieval(s, d):
    return r6(retrieval.retrieve(a.passages(s, d), retrieval.build_index(a.policies(s, d))))


def context_prompt(s, d):
    asked, index = a.passages(s, d), retrieval.build_index(a.policies(s, d))
    context = retrieval.contexts(retrieval.retrieve(asked, index), index.chunks)
    made = retrieval.prompts(asked, context)
    return made.join(context, "query_id").select(
        "query_id", F.md5("context").alias("context_md5"), F.md5("prompt").alias("prompt_md5")
    )


def citations(s, d):
    index = retrieval.build_index(a.policies(s, d))
    hits = retrieval.retrieve(a.questions(s, d), index)
    return retrieval.citations(a.answers(s, d), hits, index.chunks).withColumn("preview", F.md5("preview"))


def ask(s, d):
    made = retrieval.ask(a.questions(s, d), retrieval.build_index(a.policies(s, d)), a.answers(s, d))
    cited = F.array_join(F.transform("citations", lambda c: F.concat(c["id"].cast("string"), F.lit(":"), c["source"])), ",")
    return made.select("query_id", F.coalesce(F.md5("answer"), F.lit("")).alias("answer_md5"), cited.alias("cited"))


def hit_at_k(s, d):
    v = _vectors(s, d)
    hits = nn.knn(v, v, key=["vec_id"], query_key="vec_id", k=4, metric="l2")
    relevant = nn.knn(v, v, key=["vec_id"], query_key="vec_id", k=2).where("rank = 2")
    return r6(evaluate.hit_at_k(hits, relevant, ["vec_id"], 4))


# ----------------------------------------------------------- career


def _targets(s, d):
    return career.career_targets(a.employees(s, d), a.skills(s, d), a.REQUIREMENTS, a.PATHS)


def employee_skills(s, d):
    made = career.employee_skills(a.skills(s, d))
    entries = F.transform(F.map_entries("skills"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("int").cast("string")))
    return made.select("employee_id", F.array_join(F.sort_array(entries), ",").alias("skills"))


def career_target(s, d):
    return r6(_targets(s, d).select("employee_id", "role", "target_role", "skill_gap_score", F.array_join("wanted_skills", ",").alias("wanted")))


def target_gaps(s, d):
    goals = a.employees(s, d).select("employee_id", F.col("role").alias("target_role"))
    made = career.skill_gaps(goals, a.skills(s, d), a.REQUIREMENTS)
    total = F.aggregate(F.map_values("skill_gaps"), F.lit(0.0), lambda x, y: x + y)
    return r6(made.select("employee_id", "target_role", "skill_gap_score", F.size("skill_gaps").alias("skills"), total.alias("total_gap")))


def career_courses(s, d):
    made = career.recommend_courses(_targets(s, d), a.catalog(s, d), ref.vocabulary(a.REQUIREMENTS))
    general = F.filter("recommended_courses", lambda c: c["reason"] == "General professional development")
    return made.select(
        "employee_id", F.array_join(F.transform("recommended_courses", lambda c: c["course_id"]), ",").alias("courses"),
        F.size(general).cast("bigint").alias("padded"),
    )


def fallback_courses(s, d):
    made = career.recommend_courses(
        career.career_targets(a.employees(s, d), a.skills(s, d)), career.fallback_catalog(s), ref.vocabulary(ref.CAREER_REQUIREMENTS)
    )
    return made.select(
        "employee_id", "target_role", F.array_join(F.transform("recommended_courses", lambda c: c["course_id"]), ",").alias("courses")
    )


def career_mentor(s, d):
    made = career.recommend_mentors(a.employees(s, d))
    return made.select("employee_id", F.coalesce("recommended_mentor.mentor_id", F.lit("none")).alias("mentor_id"))


def career_project(s, d):
    made = career.recommend_projects(_targets(s, d), a.PROJECTS)
    return made.select("employee_id", F.col("recommended_project_rotation.title").alias("title"), F.col("recommended_project_rotation.reason").alias("reason"))


def career_plan(s, d):
    made = career.career_plans(a.employees(s, d), a.skills(s, d), a.catalog(s, d), a.REQUIREMENTS, a.PATHS, a.PROJECTS)
    return r6(
        made.select(
            "employee_id", "current_role", "target_role", "skill_gap_score",
            F.array_join(F.transform("recommended_courses", lambda c: c["course_id"]), ",").alias("courses"),
            F.coalesce("recommended_mentor.mentor_id", F.lit("none")).alias("mentor_id"),
            F.col("recommended_project_rotation.title").alias("project"),
        )
    )


def skill_demand(s, d):
    return r6(career.skill_demand(a.employees(s, d), a.skills(s, d), a.REQUIREMENTS))


QUERIES = [
    mask_ids, bucket_dates, month_buckets, week_buckets, event_weeks, active_members, unknown_members, sql_parameters,
    tenure_weeks, survey_sentiment, monthly_sentiment, workload_ratio, one_on_one_cadence, pto_spike, internal_moves,
    skills_pivot, skill_gap, employee_features, risk_score, team_risk, risk_rollup, top_teams, team_drivers, risk_decisions,
    batch_person_risk, batch_team_risk, next_steps_records, person_prompts, parsed_replies, latest_per_key, upsert_next_steps,
    lexicon_sentiment, weighted_sentiment, team_sentiment, keyword_mentions, tfidf_terms, theme_summary, themes_nmf, theme_terms, theme_fit, team_themes,
    auc_exact, classification_report, attrition_scores, boosted_scores, linear_importance, permutation_importance,
    stratified_split, importance_order, explained_people, person_lookup, csv_round_trip, catalog_table, explain_levels, chunks, small_chunks, chunk_ids, knn_l2, knn_l2_similarity, knn_cosine, knn_approximate, knn_approximate_recall,
    sparse_retrieval, context_prompt, citations, ask, hit_at_k, employee_skills, career_target, target_gaps, career_courses, fallback_courses,
    career_mentor, career_project, career_plan, skill_demand,
]
BY_NAME = {q.__name__.removesuffix("_records"): q for q in QUERIES}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return team_risk(spark, folder)
