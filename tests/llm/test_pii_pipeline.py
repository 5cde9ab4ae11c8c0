"""Surrogates, language-model scores, SQL beside queries, and the pipeline."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crewmetrics.llm import pii, queries


def people(shared):
    texts = [
        None, "", "no entity", "Write to Ann.Lee@example.com or ann.lee@example.com, not bob@example.com.", "Mr Alan Smith met Mrs Alan Smith; MR. X.",
        "Call +1 415-555-0100 or +1 (415) 555 0100; card 4111 1111 1111 1111, not 4111 1111 1111 1112; 10.0.0.7", "api_key = abcDEF123456ghi", "Call +1 415-555-0100",
    ]
    return shared.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kind string")


def test_surrogates(shared):
    table = people(shared)
    out = {r.doc_id: r for r in pii.replace_entities(table, "key").collect()}
    assert len(out) == 8 and out[0].text is None and out[1].text == "" and out[2].text == "no entity" and out[2].kind == "k"
    mails = re.findall(r"\S+@\S+?(?=[,. ]* |[,.]*$)", out[3].text)
    assert len(mails) == 3 and mails[0].lower() == mails[1].lower() != mails[2].lower() and "lee" not in out[3].text.lower()
    assert "Smith" not in out[4].text and out[4].text.startswith("Mr ") and " met Mrs " in out[4].text
    assert "4111 1111 1111 1111" not in out[5].text and "4111 1111 1111 1112" in out[5].text
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", out[5].text)[1]
    assert shared.range(1).select(F.call_function("luhn_check", F.lit(card.replace(" ", "")))).first()[0]
    digits = [re.sub(r"\D", "", x) for x in re.findall(r"\+1[ \d()\-]+\d", out[5].text)]
    assert digits[0] == digits[1] == re.sub(r"\D", "", out[7].text) != "14155550100"
    assert re.fullmatch(r"api_key = [a-z]{3}[A-Z]{3}\d{6}[a-z]{3}", out[6].text) and "abcDEF" not in out[6].text
    again = {r.doc_id: r.text for r in pii.replace_entities(table, "key").collect()}
    assert again == {k: r.text for k, r in out.items()}
    assert pii.replace_entities(table.limit(0), "key").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_beside_their_sql(shared, folder, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    got = queries.QUERIES[name](shared, folder).select(columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(result.fetchall(), key=repr)


def test_pipeline(shared, folder):
    kept = [documents := shared.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(shared, kept[-1], folder))
        assert kept[-1].columns == documents.columns
    ids = [{r.doc_id for r in table.select("doc_id").collect()} for table in kept]
    assert all(after <= before for before, after in zip(ids, ids[1:])) and ids[3] == ids[4]
    packed = corpus_pipeline.run(shared, folder)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids[4]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_scores(shared, folder):
    rows = queries.op5_lm_scoring(shared, folder).collect()
    table = {r.doc_id: r.text or "" for r in shared.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(table)
    assert all(r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", table[r.doc_id])) + 1 and r.score < 0 and r.base_score < 0 for r in rows)
