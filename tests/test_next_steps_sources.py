import gzip
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from crewmetrics import schemas
from crewmetrics.functions.masking import hash_id
from crewmetrics.operators import batch_risk, next_steps, selection
from crewmetrics.sources import files, ingest, snapshots, tables
from tests.sample import write


@pytest.fixture(scope="module")
def people(sample):
    return batch_risk.person_risk(sample["employees"], sample["surveys"], sample["timesheets"], as_of=date(2025, 5, 10)).cache()


def test_rule_based_records(people, sample):
    rows = {r.employee_id: r for r in next_steps.next_steps(people, sample["skills"]).collect()}
    assert len(rows) == 10
    r = rows["E_1503"]
    assert r.attrition_risk == 0.265 and r.owner == "manager" and r.suggested_check_in_weeks == 6
    assert r.recommendations[2] == "Enroll in focused upskilling: Airflow, Python (4 weeks)." and len(r.recommendations) == 5
    assert rows["E_1002"].recommendations[2] == "Enroll in focused upskilling:  (4 weeks)."
    assert r.top_drivers == ["tenure_transition", "workload_ratio", "low_sentiment"]


def test_model_replies(spark, people, sample):
    replies = spark.createDataFrame(
        [("E_1001", '{"recommendations": ["a", "b"], "owner": "hr", "suggested_check_in_weeks": 3, "attrition_risk": 0.9}'),
         ("E_1002", "not json"), ("E_1042", ""), ("E_1111", "[1]"), ("E_1205", ' {"owner": "employee"}')],
        "employee_id string, response string",
    )
    rows = {r.employee_id: r for r in next_steps.next_steps(people, sample["skills"], replies).collect()}
    a = rows["E_1001"]
    assert (a.recommendations, a.owner, a.suggested_check_in_weeks, a.attrition_risk) == (["a", "b"], "hr", 3, 0.9)
    assert rows["E_1002"].model_response == "not json" and rows["E_1002"].recommendations is None
    assert rows["E_1111"].model_response == "[1]" and rows["E_1205"].owner == "employee"
    assert len(rows["E_1042"].recommendations) == 5 and len(rows["E_1704"].recommendations) == 5
    saved = next_steps.saved_rows(next_steps.next_steps(people, sample["skills"], replies), F.lit("2025-05-10 08:00:00"))
    assert [f.name for f in saved.schema] == schemas.NEXT_STEPS.fieldNames()
    assert [f.dataType for f in saved.schema] == [f.dataType for f in schemas.NEXT_STEPS]
    stored = {r.employee_id: r for r in saved.collect()}
    assert json.loads(stored["E_1001"].recommendations_json) == ["a", "b"]
    assert json.loads(stored["E_1002"].recommendations_json) == ["not json"]
    assert stored["E_1001"].top_drivers == "low_1on1,low_growth,low_recognition"


def test_prompt(people, sample):
    prompts = {r.employee_id: r.prompt for r in next_steps.person_prompts(people, sample["skills"]).collect()}
    lines = prompts["E_1503"].split("\n")
    assert "- skills: [{'skill': 'SQL', 'level': 4}, {'skill': 'Airflow', 'level': 3}, {'skill': 'Python', 'level': 3}]" in lines
    assert "- avg_hours_last_12w: 38.0" in lines and "- workload_ratio: 0.95" in lines and "- attrition_risk: 0.265" in lines
    assert "- skills: []" in prompts["E_1002"].split("\n")


def test_prompt_keeps_equal_skill_rows(spark, people):
    twice = spark.createDataFrame([("E_1001", "x", 1.5), ("E_1001", "x", 1.5)], "employee_id string, skill string, level double")
    prompt = next_steps.person_prompts(people, twice).where("employee_id = 'E_1001'").first().prompt
    assert "[{'skill': 'x', 'level': 1.5}, {'skill': 'x', 'level': 1.5}]" in prompt


def test_latest_and_upsert(spark):
    ddl = "employee_id string, v int, created_at string"
    rows = spark.createDataFrame([("a", 1, "2024"), ("a", 2, "2025"), ("b", 3, "2023"), ("a", 4, "2025")], ddl)
    newest = [F.col("created_at").desc(), F.col("v").desc()]
    assert {tuple(r)[:2] for r in next_steps.latest_per_key(rows, "employee_id", newest).collect()} == {("a", 4), ("b", 3)}
    old = spark.createDataFrame([("a", 0, "x"), ("c", 9, "y"), (None, 5, "z")], ddl)
    once = next_steps.upsert(old, rows.where("v in (2, 3)"), "employee_id")
    assert {tuple(r)[:2] for r in once.collect()} == {("a", 2), ("b", 3), ("c", 9), (None, 5)}
    twice = next_steps.upsert(once, rows.where("v in (2, 3)"), "employee_id")
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_snapshots(spark, tmp_path):
    ddl, path = "employee_id string, v int", str(tmp_path / "steps")
    assert snapshots.read_snapshot(spark, path) is None
    snapshots.upsert_snapshot(spark.createDataFrame([("a", 1), ("b", 2)], ddl), path)
    source = spark.createDataFrame([("b", 3), ("b", 5), ("c", 4)], ddl)
    for _ in range(2):
        got = snapshots.upsert_snapshot(source, path, newest_first=[F.col("v").desc()])
        assert {tuple(r) for r in got.collect()} == {("a", 1), ("b", 5), ("c", 4)}
    # a run that died before its success marker does not count, nor is its folder written again
    unfinished = tmp_path / "steps" / "snapshot-00000007"
    unfinished.mkdir()
    assert snapshots.read_snapshot(spark, path).count() == 3
    snapshots.upsert_snapshot(spark.createDataFrame([("d", 1)], ddl), path)
    assert (tmp_path / "steps" / "snapshot-00000008").exists() and snapshots.read_snapshot(spark, path).count() == 4


def test_only_touched_buckets_are_written(spark, tmp_path):
    ddl, path = "employee_id string, v int", str(tmp_path / "steps")
    assert snapshots.read_buckets(spark, path) is None
    snapshots.upsert_buckets(spark.createDataFrame([(f"e{i}", i) for i in range(40)], ddl), path, buckets=16)
    names = lambda: {f.parent.name: f.name for f in (tmp_path / "steps" / "rows").glob("_bucket=*/*.parquet")}
    before = names()
    source = spark.createDataFrame([("e3", 300), ("new", 1), (None, 7)], ddl)
    got = {(r.employee_id, r.v) for r in snapshots.upsert_buckets(source, path, buckets=99).collect()}
    assert got == {(f"e{i}", 300 if i == 3 else i) for i in range(40)} | {("new", 1), (None, 7)}
    after = names()
    changed = {b for b in after if before.get(b) != after[b]}
    touched = {f"_bucket={r[0]}" for r in source.select(F.pmod(F.xxhash64("employee_id"), F.lit(16))).collect()}
    assert changed == touched and set(before) - touched
    with pytest.raises(Exception, match="more than once"):
        snapshots.upsert_buckets(spark.createDataFrame([("e4", 1), ("e4", 2)], ddl), path)
    assert names() == after and snapshots.read_buckets(spark, path).count() == 42
    newest = snapshots.upsert_buckets(spark.createDataFrame([("e4", 1), ("e4", 2)], ddl), path, newest_first=[F.col("v").desc()])
    assert newest.where("employee_id = 'e4'").first().v == 2 and newest.count() == 42
    assert snapshots.upsert_buckets(source.limit(0), path).count() == 42


def test_a_repeated_source_key_fails(spark):
    ddl = "employee_id string, v int"
    old = spark.createDataFrame([("a", 0)], ddl)
    with pytest.raises(Exception, match="employee_id occurs more than once"):
        next_steps.upsert(old, spark.createDataFrame([("b", 1), ("b", 2)], ddl), "employee_id").collect()
    assert next_steps.upsert(old, spark.createDataFrame([(None, 1), (None, 2)], ddl), "employee_id").count() == 3


def test_one_bad_field_spoils_no_other(spark):
    said = [
        '{"owner": "hr", "suggested_check_in_weeks": "soon", "recommendations": [1, "b"], "mood": {"x": [1, null]}, "attrition_risk": "0.25"}',
        '{"owner": null, "recommendations": "rest", "employee_id": 7}', "{}", "[1]", "5", "null", "{bad", "", None, '{"owner": 1, "owner": 2}',
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").withColumn("r", next_steps.parse_reply(F.col("t")))
    got = {r.i: r.j and json.loads(r.j) for r in rows.select("i", F.to_json("r").alias("j")).collect()}
    assert got[0] == {
        "owner": "hr", "recommendations": ["1", "b"], "attrition_risk": 0.25,
        "other_fields": {"mood": {"x": [1, None]}, "suggested_check_in_weeks": "soon"},
    }
    assert got[1] == {"employee_id": "7", "other_fields": {"recommendations": "rest"}}
    assert got[2] == {"other_fields": {}} and all(got[i] is None for i in range(3, 10))


def test_selection(spark, sample):
    people = sample["employees"]
    assert selection.lookup(people, "employee_id", "E_1042").first().role == "Data Engineer"
    assert selection.lookup(people, "employee_id", "nobody").isEmpty()
    with pytest.raises(selection.UnknownKey):
        selection.lookup(people, "employee_id", "nobody", missing="error")
    assert selection.among(people, "employee_id", ["E_1042", "x"]).count() == 1
    assert selection.among(people, "employee_id", None).count() == 10
    ids = spark.createDataFrame([("E_1042",), ("x",), ("E_1042",)], "employee_id string")
    assert selection.among(people, "employee_id", ids).count() == 1
    assert [r.employee_id for r in selection.unknown(ids, people, "employee_id").collect()] == ["x"]


def test_ingest(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    write(source, "employees", "surveys", "ld_catalog")
    (source / "skills.csv").write_text("employee_id,nonsense\nE_1,x\n")
    status = ingest.ingest(spark, str(source), target, "s")
    got = {r.table: r.status for r in status.collect()}
    assert got == {"employees": "created", "surveys": "created", "timesheets": "skipped", "skills": "failed", "ld_catalog": "created"}
    assert ingest.succeeded(status)
    people = files.read_parquet(spark, f"{target}/employees")
    assert people.count() == 10
    expected = people.sparkSession.range(1).select(hash_id(F.lit("E_1001"), "s")).first()[0]
    assert people.where(F.col("employee_id") == expected).count() == 1
    catalog = files.read_parquet(spark, f"{target}/ld_catalog").orderBy("ordinal").collect()
    assert catalog[1].title == "Advanced dbt: Testing & CI" and {c.provider for c in catalog} == {"Internal", "External"}
    nothing = ingest.ingest(spark, str(tmp_path / "void"), target, "s")
    assert not ingest.succeeded(nothing)


def test_ingest_of_hire_dates_and_extra_columns(spark, tmp_path):
    from crewmetrics.operators import features

    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "employees.csv").write_text("role,practice,employee_id,hire_date,site\nAnalyst,AI,E_1,2024-01-01,Pune\n")
    assert ingest.succeeded(ingest.ingest(spark, str(source), target, "s"))
    people = files.read_parquet(spark, f"{target}/employees")
    assert people.first().site == "Pune" and people.first().employee_id.startswith("H_")
    assert features.tenure_weeks(people, date(2024, 1, 22)).first().tenure_weeks == 3


def test_csv_patterns_and_gzip(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    body = "employee_id,month,free_text,rating\nE_1,2025-05,\"a, b\",4\n"
    (tmp_path / "x_employees.csv").write_text(body)
    with gzip.open(tmp_path / "sub" / "employees_2.csv.gz", "wt") as f:
        f.write(body)
    (tmp_path / "other.csv").write_text(body)
    got = files.read_csv_matching(spark, str(tmp_path), "*employees*{csv,csv.gz}", schemas.SURVEYS)
    assert got.count() == 2 and {r.free_text for r in got.collect()} == {"a, b"}
    inferred = files.read_csv(spark, str(tmp_path / "other.csv"))
    assert dict(inferred.dtypes)["rating"] == "int"


def test_csv_keeps_quoted_line_breaks_and_hash_values(spark, tmp_path):
    (tmp_path / "s.csv").write_text('employee_id,month,free_text,rating\n#7,2025-05,"first line\nsecond ""line""",4\n')
    got = files.read_csv(spark, str(tmp_path / "s.csv"), schemas.SURVEYS).collect()
    assert [tuple(r) for r in got] == [("#7", "2025-05", 'first line\nsecond "line"', 4.0)]
    declared = files.read_declared_csv(spark, str(tmp_path / "s.csv"), schemas.SURVEYS).collect()
    assert got == declared


def test_csv_of_another_header_is_refused(spark, tmp_path):
    (tmp_path / "employees.csv").write_text("month,employee_id,free_text,rating\n2025-05,E_1,x,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv_matching(spark, str(tmp_path), "*employees*", schemas.SURVEYS).collect()


def test_only_lines_before_the_header_are_comments(spark, tmp_path):
    body = "# exported, today\n# by \"someone\"\nemployee_id,month,free_text,rating\n#7,2025-05,hello,5\nE_1,2025-05,#x,4\n# last,,,\n"
    (tmp_path / "s.csv").write_text(body)
    want = [("#7", "2025-05", "hello", 5.0), ("E_1", "2025-05", "#x", 4.0), ("# last", None, None, None)]
    for multiline in (None, True, False):
        got = files.read_csv(spark, str(tmp_path / "s.csv"), schemas.SURVEYS, multiline=multiline).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    (tmp_path / "t.csv").write_text("employee_id,month,free_text,rating\n#8,2025-06,x,1\n")
    both = files.read_csv(spark, [str(tmp_path / "s.csv"), str(tmp_path / "t.csv")], schemas.SURVEYS)
    assert both.count() == 4 and files.read_csv_matching(spark, str(tmp_path), "*.csv", schemas.SURVEYS).count() == 4


def test_rows_are_numbered_in_the_order_of_files(spark, tmp_path):
    """Spark reads the larger file first, and splits it; the numbers follow names and rows all the same."""
    (tmp_path / "a.csv").write_text("# small\nn,x\n1,a\n2,a\n")
    (tmp_path / "b.csv").write_text("n,x\n" + "".join(f"{i},{'b' * 50}\n" for i in range(3, 3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = files.read_csv(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")], ordinal=True)
        assert got.rdd.getNumPartitions() > 1
        assert [r.n for r in got.orderBy("ordinal").collect()] == list(range(1, 3000))
        assert [r.ordinal for r in got.orderBy("ordinal").collect()] == list(range(2999))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_unreadable_values_are_counted(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "timesheets.csv").write_text("employee_id,week,hours\nE_1,2025-W01,forty\nE_2,2025-W01,38.5\nE_3,2025-W01\nE_4,2025-W01,,\nE_5,2025-W01, 40 \n")
    (source / "surveys.csv").write_text('employee_id,month,free_text,rating\nE_1,2025-05,"a\nb",4\n')
    status = {r.table: (r.status, r.message) for r in ingest.ingest(spark, str(source), target, "s").collect()}
    assert status["timesheets"] == ("created", "1 unreadable values in hours; 2 rows with another number of fields")
    assert status["surveys"] == ("created", "")
    assert sorted(r.hours or 0 for r in files.read_parquet(spark, f"{target}/timesheets").collect()) == [0, 0, 0, 38.5, 40.0]
    assert files.read_parquet(spark, f"{target}/surveys").first().free_text == "a\nb"


def test_types_are_inferred(spark, tmp_path):
    (tmp_path / "x.csv").write_text("i,l,d,day,at,yes,t,e\n1,5000000000,1.5,2024-01-02,2024-01-02 03:04:05,true,x,\n,2,3,,,False,4,\n")
    got = files.read_csv(spark, str(tmp_path / "x.csv"))
    assert dict(got.dtypes) == {"i": "int", "l": "bigint", "d": "double", "day": "date", "at": "timestamp", "yes": "boolean", "t": "string", "e": "string"}
    assert got.where("i = 1").first().day == date(2024, 1, 2)
    (tmp_path / "none.csv").write_text("# nothing\n")
    with pytest.raises(ValueError, match="header"):
        files.read_csv(spark, str(tmp_path / "none.csv"))


def test_tables(spark, sample, tmp_path):
    sheets = write(tmp_path, "timesheets") + "/timesheets.csv"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS crew LOCATION '{tmp_path}/crew'")
    tables.table_from_csv(spark, "crew.sheets", sheets, schemas.TIMESHEETS)
    tables.table_from_csv(spark, "crew.sheets", sheets, schemas.TIMESHEETS)
    assert tables.read_table(spark, "crew.sheets").count() == 12
    assert tables.query(spark, "SELECT * FROM crew.sheets WHERE hours > :h", {"h": 50}).count() == 4
    assert tables.query(spark, "SELECT * FROM crew.sheets WHERE hours > ?", [50]).count() == 4
    assert tables.query(spark, "SELECT count(*) AS n FROM crew.sheets").first().n == 12
    spark.sql("DROP DATABASE crew CASCADE")


def test_exports(spark, sample, tmp_path):
    teams = sample["employees"].groupBy("practice").count()
    files.write_csv(teams, str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    assert (tmp_path / "one").glob("part-*").__next__().read_text().startswith("practice,count")
    files.write_csv(sample["employees"].repartition(3), str(tmp_path / "many"), file_rows=2)
    assert len(list((tmp_path / "many").glob("part-*"))) > 1
    files.write_json(sample["employees"], str(tmp_path / "json"), ["employee_id"])
    assert (tmp_path / "json" / "employee_id=E_1001").exists()
    assert spark.read.json(str(tmp_path / "json")).count() == 10


def test_documents(spark, tmp_path):
    (tmp_path / "leave + policy.txt").write_text("twenty\nweeks")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.txt").write_text("no")
    docs = files.read_documents(spark, str(tmp_path)).collect()
    assert [(d.title, d.text) for d in docs] == [("leave + policy", "twenty\nweeks")]
    shout = files.read_documents(spark, str(tmp_path), "*.pdf", lambda b: b.decode().upper()).collect()
    assert [(d.title, d.text) for d in shout] == []
    shout = files.read_documents(spark, str(tmp_path), "*.txt", lambda b: b.decode().upper()).collect()
    assert [(d.title, d.text) for d in shout] == [("leave + policy", "TWENTY\nWEEKS")]


def test_schema_checks(sample):
    with pytest.raises(ValueError):
        schemas.validate(sample["employees"].drop("role"), schemas.EMPLOYEES)
    assert schemas.validate(sample["employees"], schemas.EMPLOYEES).columns[-1] == "ordinal"
