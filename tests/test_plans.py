"""Shapes of physical plans, and results under heavy skew."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from crewmetrics import reference as ref
from crewmetrics.operators import batch_risk, career, features, next_steps, retrieval, risk, selection
from crewmetrics.plans import skew
from verification import adapters as a
from verification import queries as q

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_no_python_no_cross_join_in_relational_queries(spark):
    for name in ("employee_features", "team_risk", "batch_team_risk", "career_plan", "next_steps", "upsert_next_steps",
                 "weighted_sentiment", "team_sentiment", "chunks", "skill_demand", "internal_moves", "week_buckets"):
        text = plan(q.BY_NAME[name](spark, DIR))
        for node in ("BatchEvalPython", "ArrowEvalPython", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert node not in text, (name, node)


def test_no_window_without_partition(spark):
    for name in ("chunk_ids", "auc_exact", "internal_moves", "latest_per_key"):
        assert "SinglePartition" not in plan(q.BY_NAME[name](spark, DIR)).split("Window")[-1] or name in ("chunk_ids", "auc_exact")


def test_lookup_is_pushed_to_the_scan(spark):
    c = a.table(spark, DIR, "customer")
    assert "EqualTo(c_custkey,5)" in plan(selection.lookup(c, "c_custkey", 5))
    narrow = plan(selection.lookup(c, "c_custkey", 5).select("c_name"))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in narrow


def test_period_filter_is_pushed_to_the_scan(spark, tmp_path):
    a.timesheets(spark, DIR).write.parquet(str(tmp_path / "t"))
    sheets = spark.read.parquet(str(tmp_path / "t"))
    text = plan(batch_risk.person_risk(a.employees(spark, DIR), a.surveys(spark, DIR), sheets, as_of=a.AS_OF))
    assert "In(week, [2024-W01" in text


def test_latest_row_is_limited_before_the_shuffle(spark):
    text = plan(q.latest_per_key(spark, DIR))
    assert text.count("WindowGroupLimit") >= 2


def test_employees_are_shuffled_once_for_all_features(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(q.employee_features(spark, DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # three exchanges by employee for the means and levels, one for the employees, two for the
    # role history, and one for each adapter aggregation (timesheets, skills)
    assert text.split("\n\n")[0].count("Exchange") <= 9


def hot_employee(spark, rows=30_000):
    """One employee holds about a third of all rows; many rows are exact copies."""
    ids = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), (F.col("id") % 500).cast("string")))
    return spark.range(rows).select(ids.alias("employee_id"), (F.col("id") % 61).cast("double").alias("hours"), F.col("id").alias("n"))


@pytest.mark.parametrize("salts", [1, 64])
def test_rates_of_a_hot_employee(spark, salts, monkeypatch):
    monkeypatch.setattr(skew, "SALTS", salts)
    sheets = hot_employee(spark).drop("n").unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS employee_id, 1.0D AS hours"))
    got = features.pto_spike(sheets)
    assert got.where("employee_id IS NULL").first().pto_spike_rate is None
    exact = sheets.groupBy("employee_id").agg(F.avg((F.col("hours") < 20).cast("int")).alias("r")).join(got, "employee_id")
    assert exact.count() == 30_000 and exact.where("abs(r - pto_spike_rate) > 1e-12").isEmpty()
    got = got.where("employee_id IS NOT NULL")
    assert got.count() == 30_000
    rate = got.where("employee_id = 'hot'").select("pto_spike_rate").distinct().collect()
    plain = sheets.where("employee_id = 'hot'").agg(F.avg((F.col("hours") < 20).cast("int"))).first()[0]
    assert [r[0] for r in rate] == [pytest.approx(plain)]


def test_moves_and_latest_of_a_hot_employee(spark):
    base = hot_employee(spark)
    history = base.select(
        "employee_id", F.expr("timestamp_seconds(n * 3600)").alias("changed_at"), (F.col("hours") % 3).cast("string").alias("role"), "n"
    )
    got = {r.employee_id: r.internal_moves for r in features.internal_moves(history, tie="n").collect()}
    rows = [r.role for r in history.where("employee_id = 'hot'").orderBy("changed_at", "n").collect()]
    assert got["hot"] == sum(x != y for x, y in zip(rows, rows[1:]))
    last = next_steps.latest_per_key(base, "employee_id", [F.col("n").desc()])
    assert last.count() == 501 and last.where("employee_id = 'hot'").first().n == base.where("employee_id = 'hot'").agg(F.max("n")).first()[0]


def test_copies_of_one_text(spark):
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "leave policy text").otherwise(F.concat(F.lit("page no"), F.col("id").cast("string"))).alias("text")
    )
    asked = spark.createDataFrame([(1, "leave policy")], "query_id long, question string")
    hits = retrieval.retrieve(asked, retrieval.build_index(docs), k=4).orderBy("rank").collect()
    assert [h.doc_id for h in hits] == [0, 3, 6, 9] and len({round(h.score, 9) for h in hits}) == 1


def test_constants_need_no_join(spark):
    people, skills = a.employees(spark, DIR), a.skills(spark, DIR)
    text = plan(career.career_targets(people, skills, a.REQUIREMENTS, a.PATHS)).split("\n\n")[0]
    assert text.count("Join") == 1
    assert ref.vocabulary({"a": {"x": 1, "y": 1}, "b": {"y": 2, "z": 1}}) == ["x", "y", "z"]


def test_drilldown_to_persons(spark):
    rows = features.risk_score(features.employee_features(a.employees(spark, DIR), a.skills(spark, DIR), as_of=date(2024, 2, 1)))
    levels = {r.level: r["count"] for r in risk.risk_drilldown(rows, ("practice", "role", "employee_id")).groupBy("level").count().collect()}
    assert levels[3] == rows.count() and levels[0] == 1


def test_rows_of_a_hot_group_are_dealt_out(spark):
    """No (key, part) of the join holds more than a few hundredths of the rows, results go only where rows are, and the plan
    does not hang on the size."""
    rows = hot_employee(spark)
    rated = features.pto_spike(rows)
    parts = rows.groupBy("employee_id", F.pmod(F.xxhash64(*rows.columns), F.lit(skew.SALTS)).alias("part")).count()
    assert parts.agg(F.max("count")).first()[0] < 600 and parts.count() < 30_000
    shape = lambda df: [x for x in re.findall(r"^[\s:+-]*(?:\* )?(\w+)", plan(df).split("\n\n")[0], re.M) if x != "Range"]
    assert shape(rated) == shape(features.pto_spike(hot_employee(spark, 300)))
    assert "Window" not in plan(rated).split("\n\n")[0]


def test_weights_and_contexts_do_not_shuffle_the_corpus(spark):
    from crewmetrics.operators import tfidf

    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "source", "text")
    index = retrieval.build_index(docs)
    arrays = tfidf.term_arrays(docs, ["doc_id"], "text")
    assert "Exchange" not in plan(tfidf.vectors(arrays, index.vocab, ["doc_id"])).split("\n\n")[0]
    hits = retrieval.retrieve(a.passages(spark, DIR), index)
    text = plan(retrieval.contexts(hits, index.chunks)).split("\n\n")[0]
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    # the broadcast of the hits, and the found chunks by question
    assert text.count("Exchange") == 2


def test_split_is_a_filter(spark):
    from crewmetrics.operators import model

    train, test = model.stratified_split(a.table(spark, DIR, "labels"), "quality", "doc_id")
    for part in (train, test):
        assert "Exchange" not in plan(part).split("\n\n")[0]


def test_sentiment_is_read_from_the_two_needed_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumnRenamed("text", "free_text")
    text = plan(features.survey_sentiment(docs).select("doc_id", "survey_sentiment"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
